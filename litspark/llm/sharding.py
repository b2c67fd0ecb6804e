"""Sharding by sampled splitters: near-equal bytes per shard, whatever the keys.

A record's key is the hash of its text, with the hash of its id in the lowest
bits: equal texts lie side by side, and yet a group of copies is itself a range
that splitters can cut. Keys are drawn with chances in proportion to size; their
quantiles are the range boundaries. Ranges that turn out overfull are subdivided
by quantiles of all their own keys. Exact byte and row counts per range, summed
in order, place every record on a line from 0 to all bytes, and equal stretches
of that line are the shards. Law: ``bytes``.

Null texts count as one byte, as empty ones do, and have the checksum of the
empty text. Null ids come first. Rows that agree in every column lie next to
each other in any order. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from litspark.llm.common import small
from litspark.session import store

SHARDS = 16
#: Ranges are a square: a key finds its row of splitters, then its place in that row.
SIDE = 16
RANGES = SIDE * SIDE
#: Keys drawn per range, and cuts of an overfull range.
DRAWN, CUTS = 64, 63
#: A range is overfull above this multiple of the mean, or above so many rows.
OVERFULL, RANGE_ROWS = 2, 100_000
ID_BITS = 20


def _key(id_col: str, text: str) -> Column:
    high = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(-(1 << ID_BITS)))
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit(6), F.col(id_col)), 64 - ID_BITS))


def _splitters(base: DataFrame, total: int) -> list[int]:
    """Quantiles of about DRAWN keys per range, drawn by size; a number fixed in advance."""
    chance = F.pmod(F.xxhash64(F.lit(61), "_key", "_id"), F.lit(1 << 30)) / float(1 << 30)
    hits = F.col("size") * (RANGES * DRAWN / max(total, 1))
    drawn = base.withColumn("_hits", F.floor(hits + chance).cast("long")).where("_hits > 0")
    # A document drawn several times counts as often: all draws are about RANGES * DRAWN rows.
    drawn = drawn.select("_key", F.explode(F.array_repeat(F.lit(0), F.col("_hits").cast("int"))))
    at = [(i + 1) / RANGES for i in range(RANGES - 1)]
    found = drawn.agg(F.percentile_approx("_key", at, 20 * RANGES).alias("q")).first()["q"] if total else None
    # One key may be several quantiles; the first drawn keys pad a short list.
    return sorted(found) if found else [0] * (RANGES - 1)


def _range_no(splitters: list[int]) -> Column:
    """How many splitters are at most the key, in two short scans instead of one long one."""
    padded = [*splitters, (1 << 63) - 1]
    rows = [padded[i:i + SIDE] for i in range(0, RANGES, SIDE)]
    heads = F.array(*[F.lit(r[-1]) for r in rows[:-1]])
    row = F.size(F.filter(heads, lambda x: x <= F.col("_key")))
    within = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in rows]), row + 1)
    return row * SIDE + F.size(F.filter(within, lambda x: x <= F.col("_key")))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``size, text_crc32, law, shard, slot, grown_shard``; slots are gapless in every shard.

    Every shard's bytes are within one document of all bytes over ``shards``.
    """
    base = store(docs.select(
        F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), _key(id_col, text).alias("_key")), "shard-keys")
    whole = base.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total, rows = whole["bytes"] or 0, whole["rows"]
    # Ranges are stored: every later step sees the same ones.
    ranged = store(base.withColumn("_range", _range_no(_splitters(base, total))), "shard-ranges")
    loads = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    over = loads.where((F.col("_bytes") > OVERFULL * total / RANGES) | (F.col("_rows") > min(RANGE_ROWS, max(OVERFULL * rows // RANGES, 1))))
    over = store(over.select("_range"), "shard-overfull")
    cuts = ranged.join(F.broadcast(over), "_range").groupBy("_range").agg(
        F.percentile_approx("_key", [(i + 1) / (CUTS + 1) for i in range(CUTS)], 10_000).alias("_cuts"))
    placed = ranged.join(F.broadcast(cuts), "_range", "left").withColumn(
        "_sub", F.coalesce(F.size(F.filter("_cuts", lambda x: x <= F.col("_key"))), F.lit(0))).drop("_cuts")
    placed = store(placed.withColumn("_sub", F.when(F.col("_sub") > 0, F.col("_sub")).otherwise(0)), "shard-placed")
    # At most RANGES * (CUTS + 1) rows, a bound of the method.
    before = Window.orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range", "_sub").agg(F.sum("size").alias("_b"), F.count("*").alias("_n")).select(
        "_range", "_sub", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_row0"))
    order = Window.partitionBy("_range", "_sub").orderBy("_key", "_id", "size", "text_crc32")
    sums = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = placed.join(F.broadcast(starts), ["_range", "_sub"]).select(
        "_id", "size", "text_crc32", (F.col("_row0") + F.row_number().over(order) - 1).alias("_row"),
        (F.col("_byte0") + F.sum("size").over(sums) - F.col("size")).alias("_byte"))
    middle = F.floor((2 * F.col("_byte") + F.col("size")).cast("decimal(38,0)") * shards / (2 * max(total, 1)))
    lined = store(lined.withColumn("shard", F.least(middle.cast("int"), F.lit(shards - 1))), "shard-line")
    firsts = lined.groupBy("shard").agg(F.min("_row").alias("_first"))
    return lined.join(small(firsts), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
