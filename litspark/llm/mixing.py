"""Mixing sources to target weights, by hash-random keys, prefix sums and one exact cut per source.

Every document gets a hash-random key. Keys fall into equal key ranges, so
(source, range) sums are small and even however hot a source is; their prefix
sums per source name the range in which its budget ends, and only that range is
sorted to find the cut. A document is then taken whole, in part or not at all by
comparing its key with its source's cut: no text moves, no source meets in one
task. A budget above a source's size repeats the whole source first.

Null texts and texts without words have size 0 and are taken 0 times. The null
source is a source of its own, last in order. Rows that agree in source and id
share the cut between them in proportion to their sizes; ids may be null (they
come first). An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from litspark.llm.common import first_words, n_words, small
from litspark.session import store

SHARE = 1.5
WEIGHTS = (3, 1, 2)
MAX_EPOCHS = 2
#: Key ranges per source, as a power of two.
RANGE_BITS = 10
SEED = 20


@dataclass(frozen=True)
class Cuts:
    """One row per source: ``_source, source_size, target, epochs, cut_key, cut_id, left, group_size``."""

    cuts: DataFrame
    sized: DataFrame


def _keyed(docs: DataFrame, id_col: str, source: str, text: str) -> dict[str, Column]:
    return {
        "_source": F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")),
        "_key": F.xxhash64(F.lit(SEED), F.col(id_col)),
        "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))),
        "_size": n_words(F.col(text)),
    }


def budgets(totals: DataFrame, share: float, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``totals(_source, source_size)`` with ``target``: weights level out under caps of ``max_epochs`` sizes.

    Sources in order of cap per weight fill up first; from the first that stays
    below its cap on, all get the same level per weight. One row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("_source") == "n", "_source")) - 1
    weighed = totals.select("*", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).alias("_w"))
    by = Window.orderBy(F.col("source_size") / F.col("_w"), "_source")
    every = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    level = (F.sum("source_size").over(every) * share - F.coalesce(
        F.sum(cap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("_w").over(
        by.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("_level", level).withColumn(
        "_open", F.when(F.col("_level") * F.col("_w") <= cap, F.col("source_size") / F.col("_w")))
    first = F.min(F.when(F.col("_open").isNotNull(), F.struct("_open", "_source", "_level"))).over(every)
    return leveled.withColumn("_l", first["_level"]).select(
        "_source", "source_size",
        F.least(cap.cast("double"), F.coalesce(F.col("_l") * F.col("_w"), cap.cast("double"))).alias("target"))


def find_cuts(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
              id_col: str = "doc_id", source: str = "source", text: str = "text") -> Cuts:
    """Each source's target and the key at which its budget ends."""
    keyed = _keyed(docs, id_col, source, text)
    sized = store(docs.select(F.col(id_col).alias("_doc"), *[c.alias(n) for n, c in keyed.items()]), "mix-sizes")
    ranged = sized.withColumn("_range", F.shiftright("_key", 64 - RANGE_BITS))
    sums = store(ranged.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum")), "mix-ranges")
    plan = budgets(sums.groupBy("_source").agg(F.sum("_sum").alias("source_size")), share, weights, max_epochs)
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("long")).withColumn(
        "_rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = store(plan, "mix-plan")
    run = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("_to", F.sum("_sum").over(run)).join(small(plan.where("_rest > 0")), "_source").where(
        (F.col("_to") >= F.col("_rest")) & (F.col("_to") - F.col("_sum") < F.col("_rest"))).select(
        "_source", "_range", "_rest", (F.col("_to") - F.col("_sum")).alias("_before"))
    groups = ranged.join(small(ends), ["_source", "_range"]).groupBy("_source", "_key", "_id").agg(
        F.sum("_size").alias("_sum"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before"))
    run = Window.partitionBy("_source").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, 0)
    to = F.col("_before") + F.sum("_sum").over(run)
    cut = groups.withColumn("_to", to).where(
        (F.col("_to") >= F.col("_rest")) & (F.col("_to") - F.col("_sum") < F.col("_rest"))).select(
        "_source", F.col("_key").alias("cut_key"), F.col("_id").alias("cut_id"),
        (F.col("_rest") - F.col("_to") + F.col("_sum")).alias("left"), F.col("_sum").alias("group_size"))
    return Cuts(store(plan.drop("_rest").join(cut, "_source", "left"), "mix-cuts"), sized)


def _part() -> Column:
    """Words taken besides whole repeats."""
    key, cut = F.struct("_key", "_id"), F.struct(F.col("cut_key").alias("_key"), F.col("cut_id").alias("_id"))
    shared = F.floor(F.col("left").cast("decimal(38,0)") * F.col("_size") / F.col("group_size")).cast("long")
    return F.when(F.col("cut_key").isNull() | (key > cut), 0).when(key < cut, F.col("_size")).otherwise(shared)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``."""
    found = find_cuts(docs, **options)
    return found.sized.join(small(found.cuts), "_source").select(
        F.col("_doc").alias(options.get("id_col", "doc_id")), F.col("_size").alias("size"), "source_size", "target",
        (F.col("epochs") * F.col("_size") + _part()).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed documents themselves: whole repeats as rows, the document at a cut up to its last taken word.

    Columns are those of ``docs``; ``n_chars``, where present, follows the text.
    """
    cuts = find_cuts(docs, id_col=id_col, source=source, text=text, **options).cuts
    keyed = docs.withColumns(_keyed(docs, id_col, source, text)).join(small(cuts), "_source")
    part = keyed.withColumn("_part", _part()).withColumn("_rows", (F.col("epochs") + (F.col("_part") > 0).cast("long")).cast("int"))
    rows = part.where("_rows > 0").withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    body = F.when((F.col("_row") > F.col("epochs")) & (F.col("_part") < F.col("_size")), first_words(F.col(text), F.col("_part"))).otherwise(F.col(text))
    cut = rows.withColumn(text, body)
    if "n_chars" in docs.columns and text == "text":
        cut = cut.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])
