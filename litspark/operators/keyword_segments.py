"""Keyword index in segments: added to and deleted from without a rebuild, searched with upper bounds.

Every step writes a segment through :mod:`litspark.sources.runs` and counts once it
is committed. A step holds ``parts`` (:mod:`litspark.operators.keyword_parts`: the
postings of some thousand chunks each), signed ``terms`` and ``totals``, and the places
``gone`` from earlier segments. Statistics are sums of signed counts, so they are those of
the live chunks. A chunk added again replaces its earlier self. :func:`compact` writes the
live chunks as one segment and readers start from there.

Inside a part a term's postings lie in blocks of ``BLOCK``, best first, with the largest
term frequency and the smallest chunk length, which bound the weight of any posting in
them. A search scores every term's first blocks and then the best chunks found there
by all their terms; the ``k``-th of these scores is a
threshold per question. A block counts only if its bound and the best
of the question's other terms reach the threshold; a chunk above it lies in
such blocks with all its terms, so the result is exact.

Steps are numbered in commit order: one writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark import constants as K
from litspark.functions.scores import idf
from litspark.operators import keyword_parts as parts
from litspark.operators.keyword import MAX_QUERY_TERMS, best_in_task, query_terms, top_ranked
from litspark.operators.topk import OUT
from litspark.session import store
from litspark.sizing import LITERAL_ROWS, join_small
from litspark.sources import runs

#: Postings of a block, and of a part, whose postings are put in order together; chunks per wanted one that give the threshold.
BLOCK, SALT_POSTINGS, FIRST = 128, 500_000, 4
PARTS = f"{parts.PARTS}, step bigint"
TERMS, TOTALS, GONE, BASES = "term string, df bigint, step bigint", "n_chunks bigint, tokens bigint, step bigint", f"{parts.PLACES}, step bigint", "step bigint"
_SCHEMAS = {"parts": PARTS, "terms": TERMS, "totals": TOTALS, "gone": GONE, "bases": BASES}
#: A part is one or two megabytes, already compressed: row groups of few parts, so that tasks share a file and hold little of it.
_WRITTEN = {"parts": {"compression": "none", "parquet.block.size": str(8 << 20), "parquet.block.row.count.limit": "8", "parquet.enable.dictionary": "false"}}


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Committed rows since the last compaction."""
    rows = runs.read(spark, path, name, _SCHEMAS[name]).drop("run_id", "batch_id")
    base = runs.read(spark, path, "bases", BASES).agg(F.max("step")).first()[0] if name != "bases" else None
    return rows if base is None else rows.where(F.col("step") >= base)


def _live(spark: SparkSession, path: str) -> DataFrame:
    """All parts, with the bitmap ``dead`` of the chunks deleted by a later step."""
    found, gone = _table(spark, path, "parts"), _table(spark, path, "gone")
    if gone.isEmpty():
        return found.withColumn("dead", F.lit(None).cast("binary"))
    return join_small(found, store(parts.bitmaps(gone, "dead"), "segment-dead"), ["step", "part"], "left")


def _next_step(spark: SparkSession, path: str) -> int:
    last = runs.read(spark, path, "totals", TOTALS).agg(F.max("step")).first()[0]
    return 0 if last is None else last + 1


def _once(chunks: DataFrame) -> DataFrame:
    """One row of every id; only rows whose id comes again meet."""
    again = store(chunks.groupBy(F.xxhash64("chunk_id").alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"), "segment-again")
    if again.isEmpty():
        return chunks
    keyed = chunks.withColumn("_key", F.xxhash64("chunk_id"))
    several = join_small(keyed, again, ["_key"], "left_semi").dropDuplicates(["chunk_id"])
    return join_small(keyed, again, ["_key"], "left_anti").unionByName(several).drop("_key")


def _counts(rows: DataFrame, n: Column, tokens: Column, sign: int = 1) -> DataFrame:
    return rows.agg((F.coalesce(n, F.lit(0)) * sign).alias("n_chunks"), (F.coalesce(tokens, F.lit(0)) * sign).alias("tokens"))


def _put(path: str, run_id: str, step: int, name: str, df: DataFrame) -> DataFrame:
    return runs.put(df.withColumn("step", F.lit(step).cast("long")).select(*_names(_SCHEMAS[name])), path, name, run_id, step, **_WRITTEN.get(name, {}))


def _put_statistics(path: str, run_id: str, step: int, terms: DataFrame, totals: DataFrame) -> None:
    _put(path, run_id, step, "terms", terms.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"))
    _put(path, run_id, step, "totals", _counts(totals, F.sum("n_chunks"), F.sum("tokens")))


def change(spark: SparkSession, path: str, run_id: str, add: DataFrame | None = None, remove: DataFrame | None = None) -> None:
    """One committed step: chunks to add or replace (``chunk_id, text``) and ids to delete (``chunk_id``)."""
    step = _next_step(spark, path)
    empty = spark.createDataFrame([], "chunk_id string, text string")
    add = empty if add is None else add.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text")
    ids = add.select("chunk_id") if remove is None else add.select("chunk_id").unionByName(remove.select(F.col("chunk_id").cast("string").alias("chunk_id")))
    earlier = _table(spark, path, "parts")
    old = store(parts.places(_live(spark, path)).join(ids, "chunk_id", "left_semi").select(*_names(parts.PLACES)), "segment-old") if step else None
    written = _put(path, run_id, step, "parts", parts.of_chunks(_once(add), SALT_POSTINGS, BLOCK))
    terms, totals = parts.frequencies(written), _counts(written, F.sum("n"), F.sum("tokens"))
    if old is not None:
        removed = _put(path, run_id, step, "gone", old)
        marked = join_small(earlier, store(parts.bitmaps(removed, "removed"), "segment-removed"), ["step", "part"])
        terms = terms.unionByName(parts.frequencies(marked, F.col("removed")).withColumn("df", -F.col("df")))
        totals = totals.unionByName(_counts(removed, F.count("*"), F.sum("dl"), -1))
    _put_statistics(path, run_id, step, terms, totals)
    runs.commit(spark, path, run_id, step)


def compact(spark: SparkSession, path: str, run_id: str) -> None:
    """All live chunks as one segment; earlier segments are no longer read."""
    step = _next_step(spark, path)
    _put(path, run_id, step, "parts", parts.repacked(_live(spark, path), SALT_POSTINGS, BLOCK))
    # The sums of the segments so far are those of the live chunks.
    _put_statistics(path, run_id, step, _table(spark, path, "terms"), _table(spark, path, "totals"))
    _put(path, run_id, step, "bases", spark.range(1).select())
    runs.commit(spark, path, run_id, step)


@dataclass(frozen=True)
class Found:
    """``top(query_id, chunk_id, score, rank)``, and per question the blocks of its terms and how many were skipped."""

    top: DataFrame
    blocks: DataFrame


def statistics(spark: SparkSession, path: str, terms: DataFrame) -> tuple[DataFrame, int, float]:
    """Document frequency of the asked terms, chunks, and mean length, over the live chunks."""
    totals = _table(spark, path, "totals").agg(F.sum("n_chunks").alias("n"), F.sum("tokens").alias("t")).first()
    df = _asked_rows(_table(spark, path, "terms"), terms).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return df, totals["n"] or 0, (totals["t"] or 0) / (totals["n"] or 1)


def _asked_rows(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of the asked terms; few enough terms become a filter that reaches the scan."""
    few = [r["term"] for r in terms.limit(LITERAL_ROWS + 1).collect()]
    return rows.where(F.col("term").isin(few)) if len(few) <= LITERAL_ROWS else join_small(rows, terms, ["term"], "left_semi")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = K.TOP_K_RETRIEVAL, text: str = "question", digits: int = 9) -> Found:
    """The ``k`` best live chunks of every question by BM25, exact.

    More query terms than a task holds are searched for in several turns, each with some of the questions.
    """
    asked = store(query_terms(queries, text), "segment-questions")
    df, n, mean = statistics(spark, path, asked.select("term").distinct())
    wanted = asked.join(df.withColumn("idf", idf(F.lit(n), F.col("df"))), "term").where("idf > 0")
    live = _live(spark, path)
    turns = -(-asked.count() // MAX_QUERY_TERMS) or 1
    found = [_search(live, wanted if turns == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn), mean, k, digits) for turn in range(turns)]
    top, counts = (reduce(DataFrame.unionByName, some) for some in zip(*found))
    return Found(top if n else top_ranked(spark.createDataFrame([], OUT), k), counts)


def _search(live: DataFrame, wanted: DataFrame, mean: float, k: int, digits: int) -> tuple[DataFrame, DataFrame]:
    """Top chunks and counts of blocks for the wanted terms of questions that a task holds."""
    spark = live.sparkSession
    rows = sorted(wanted.select("term", "query_id", "qtf", "idf").collect(), key=lambda r: r["term"])
    names, terms, start = {}, [], []
    for i, r in enumerate(rows):
        names.setdefault(r["query_id"], len(names))
        if not terms or terms[-1] != r["term"]:
            terms.append(r["term"])
            start.append(i)
    shared = spark.sparkContext.broadcast(parts.Asked(
        terms, np.array([*start, len(rows)]), np.array([names[r["query_id"]] for r in rows], dtype=np.int64),
        np.array([r["qtf"] * r["idf"] for r in rows], dtype=float), len(names), mean or 1.0))
    asking = F.broadcast(spark.createDataFrame(
        [(i, q) for q, i in names.items()], T.StructType([T.StructField("_q", T.IntegerType()), wanted.schema["query_id"]])))
    # Scores here and rounded ones differ by less than this.
    step = 2 * 10.0**-digits
    found = live.select("block", "chunks", "words", "terms", "postings", "blocks", "dead")
    best = found.mapInArrow(lambda batches: parts.best_scores(batches, shared.value, k, k * FIRST), "_q int, score double")
    floors = np.zeros(len(names))
    for r in top_ranked(best, k, group="_q", key="score").where(F.col("rank") == k).collect():
        floors[r["_q"]] = r["score"]
    limits = spark.sparkContext.broadcast(floors)
    scored = found.mapInArrow(lambda batches: parts.top_scores(batches, shared.value, limits.value, k, step), "_q int, chunk_id string, score double")
    scored = scored.join(asking, "_q").select("query_id", "chunk_id", F.round("score", digits).alias("score")).where("score > 0")
    top = top_ranked(best_in_task(scored, k), k).select("query_id", "chunk_id", "score", "rank")
    counts = live.select("block", "words", "terms", "blocks").mapInArrow(
        lambda batches: parts.skipped_blocks(batches, shared.value, limits.value, step), "_q int, blocks bigint, skipped bigint")
    counts = counts.groupBy("_q").agg(F.sum("blocks").alias("blocks"), F.sum("skipped").alias("skipped"))
    return top, counts.join(asking, "_q").select("query_id", "blocks", "skipped")
