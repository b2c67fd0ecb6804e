"""Keyed merges: latest wins, protected rows, upserts, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.text import strip
from litspark.operators.filters import valid_entries


def merge_protected(existing: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Merge reference entries per (lower drug, upper jurisdiction).

    Existing duplicates collapse to their last row. A new entry replaces the
    current row unless that row is ``manual``. Since a manual row can never be
    replaced, the result is the first manual row of [surviving existing row, new
    rows in order], else the last row. Both are aggregates with map-side
    combination; no group is collected. ``action`` counts come from
    :func:`merge_counts`.
    """
    keyed = _keyed_union(existing, new, order)
    row = F.struct(*[c for c in keyed.columns if not c.startswith("_")])
    pos = F.struct("_side", order)
    manual = F.coalesce(F.col("source") == "manual", F.lit(False))
    return keyed.groupBy("_drug", "_jurisdiction").agg(
        F.coalesce(
            F.min_by(F.when(manual, row), F.when(manual, pos)), F.max_by(row, pos)).alias("r")
    ).select("r.*")


def _keyed_union(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    last = existing.withColumn("_drug", F.lower(F.coalesce("drug", F.lit("")))).withColumn(
        "_jurisdiction", F.upper(F.coalesce("jurisdiction", F.lit(""))))
    row = F.struct(*existing.columns)
    survivors = last.groupBy("_drug", "_jurisdiction").agg(F.max_by(row, order).alias("r")).select(
        "_drug", "_jurisdiction", F.lit(0).alias("_side"), "r.*")
    incoming = valid_entries(new).withColumn("_drug", F.lower(strip(F.col("drug")))).withColumn(
        "_jurisdiction", F.upper(strip(F.coalesce("jurisdiction", F.lit(""))))).withColumn("_side", F.lit(1))
    return survivors.unionByName(incoming, allowMissingColumns=True)


def merge_counts(existing: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """How many new entries were protected against, updated a row, or were added.

    For each key, with ``a`` the position of its first manual row: a new row
    after ``a`` is protected, any other new row updates if it is not the key's
    first row, and adds otherwise.
    """
    keyed = _keyed_union(existing, new, order).select("_drug", "_jurisdiction", "_side", order, "source")
    pos = F.struct("_side", order)
    manual = F.coalesce(F.col("source") == "manual", F.lit(False))
    marks = keyed.groupBy("_drug", "_jurisdiction").agg(
        F.min(F.when(manual, pos)).alias("first_manual"), F.min(pos).alias("first"))
    fresh = keyed.where("_side = 1").join(marks, ["_drug", "_jurisdiction"])
    protected = F.col("first_manual").isNotNull() & (pos > F.col("first_manual"))
    return fresh.agg(
        F.count_if(protected).alias("protected"),
        F.count_if(~protected & (pos > F.col("first"))).alias("updated"),
        F.count_if(~protected & (pos == F.col("first"))).alias("added"))


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Union keeping the newest version per key; incoming wins a tie."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(
        incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("_side").desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_side")


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is new; known keys are never updated.

    The first row per key is kept, by the whole row, so the choice is stable.
    """
    fresh = incoming.join(existing.select(key), key, "left_anti")
    row = F.struct(*incoming.columns)
    return existing.unionByName(
        fresh.groupBy(key).agg(F.min(row).alias("r")).select("r.*"), allowMissingColumns=True)


def update_columns(existing: DataFrame, incoming: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """Full-outer upsert in which a known key only changes the named ``columns``.

    Of repeated incoming keys the last by ``order`` counts, by the whole row if no order is given.
    """
    others = [c for c in existing.columns if c != key]
    last = F.max_by(F.struct(*incoming.columns), F.struct(*([order] if order else []), *incoming.columns))
    right = incoming.groupBy(F.col(key).alias("_k")).agg(last.alias("_r")).select("_r.*").select(key, *[F.col(c).alias(f"_new_{c}") for c in others], F.lit(True).alias("_hit"))
    left = existing.withColumn("_had", F.lit(True))

    def merged(c: str):
        if c in columns:
            return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_had"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)

    return left.join(right, key, "full_outer").select(key, *map(merged, others))


def delete_keys(existing: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the delete list."""
    return existing.join(doomed.select(key), key, "left_anti")


def merge_into_partitions(existing: DataFrame, incoming: DataFrame, path: str, keys: list[str],
                          version: str, partition: str) -> None:
    """Write an upsert back, rewriting only the partitions ``incoming`` touches.

    The distinct partition values prune the scan of ``existing``, and dynamic
    overwrite replaces just those directories.
    """
    touched = incoming.select(partition).distinct()
    merged = upsert_latest(existing.join(touched, partition, "left_semi"), incoming, keys, version)
    merged.repartition(partition, *keys).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
