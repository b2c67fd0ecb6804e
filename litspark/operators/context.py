"""Prompt context blocks and conversation history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.citations import card_header, prompt_header


def context_blocks(ranked: DataFrame, style: str = "prompt") -> DataFrame:
    """Add ``block``: the numbered header line and the chunk text."""
    n = F.col("rank")
    header = (
        card_header(n, F.col("title"), F.col("year"), F.col("study_design"), F.col("sample_size"))
        if style == "card"
        else prompt_header(n, F.col("title"), F.col("year"), F.col("section"), F.col("study_design"))
    )
    return ranked.withColumn("block", F.concat(header, F.lit("\n"), F.coalesce("text", F.lit(""))))


def fit_budget(blocks: DataFrame, max_chars: int = K.CONTEXT_CHARS) -> DataFrame:
    """One ``context`` per query from its blocks in rank order.

    Blocks are added while their lengths, plus two for each separator, stay
    inside ``max_chars``. The first block that does not fit is cut if more than
    100 characters remain, and everything after it is left out.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    size = F.length("block") + 2
    total = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    sized = blocks.withColumn("_before", total - size).withColumn("_over", total > max_chars)
    overflow = F.min(F.when(F.col("_over"), F.col("rank"))).over(Window.partitionBy("query_id"))
    room = (F.lit(max_chars - 2) - F.col("_before")).cast("int")
    piece = (
        F.when(~F.col("_over"), F.col("block"))
        .when(room > K.CONTEXT_MIN_TAIL, F.concat(F.left("block", room), F.lit("…")))
    )
    kept = (
        sized.withColumn("_first", overflow)
        .where(F.col("_first").isNull() | (F.col("rank") <= F.col("_first")))
        .withColumn("_piece", piece).where(F.col("_piece").isNotNull())
    )
    return kept.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_piece"))),
                                 lambda x: x["_piece"]), "\n\n").alias("context"),
        F.count("*").alias("n_blocks"))


def history(turns: DataFrame, limit: int = 10, mode: str = "first", last: int = 10,
            order: list[str] | None = None) -> DataFrame:
    """Turns of each conversation handed to the next answer.

    ``first`` takes the earliest ``limit`` rows and of those the last ``last``;
    ``last`` takes the most recent ``limit`` rows. Both come back oldest first
    as ``pos``. Group-limit pruning keeps hot conversations off the shuffle.
    """
    keys = order or ["created_at", "id"]
    by = Window.partitionBy("conversation_id")
    oldest_first, newest_first = by.orderBy(*keys), by.orderBy(*[F.col(c).desc() for c in keys])
    if mode == "first":
        kept = turns.withColumn("_n", F.row_number().over(oldest_first)).where(F.col("_n") <= limit)
    else:
        kept = turns.withColumn("_n", F.row_number().over(newest_first)).where(F.col("_n") <= limit)
    newest = kept.withColumn("_n", F.row_number().over(newest_first)).where(F.col("_n") <= last)
    return newest.withColumn("pos", F.row_number().over(oldest_first)).drop("_n")


def attach_history(queries: DataFrame, turns: DataFrame, **options) -> DataFrame:
    """Left-join each query with the history of its conversation as ordered messages."""
    messages = history(turns, **options).groupBy("conversation_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))),
                    lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))
    return queries.join(messages, "conversation_id", "left")


def conversation_turns(answered: DataFrame) -> DataFrame:
    """Two rows per answered question, user then assistant, ready to append."""
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return answered.where(F.col("conversation_id").isNotNull()).select(
        "query_id", "conversation_id", F.posexplode(pair).alias("ordinal", "turn")
    ).select(
        F.concat_ws("-", "query_id", "ordinal").alias("id"), "conversation_id", "ordinal",
        "turn.role", "turn.content")
