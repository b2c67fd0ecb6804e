"""Exact order statistics by position, without sorting a whole column in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.sizing import join_small


def positional_quantiles(df: DataFrame, value: str, fractions: dict[str, float],
                         by: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """``sorted(values)[min(int(n * q), n - 1)]`` per group for every named fraction.

    A sketch brackets each position; its rank error is bounded, so the wanted
    value lies inside the bracket. Only rows inside the brackets, a share of
    about ``8 / accuracy``, are then counted per distinct value and walked in
    order. Exact for any distribution, repeated values included. Also returns
    ``n`` and ``mean``. A group has one row; groups are joined by key.
    """
    by = by or []
    keys = by or ["_all"]
    src = df.where(F.col(value).isNotNull())
    src = src.select(*by, F.col(value).alias("_v")) if by else src.select(
        F.lit(0).alias("_all"), F.col(value).alias("_v"))
    slack = 4.0 / accuracy
    ends = [p for q in fractions.values() for p in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = src.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean"),
        F.percentile_approx("_v", ends, accuracy).alias("_ends"))
    wanted = F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1).alias("k"),
            F.get("_ends", F.lit(2 * i)).alias("lo"), F.get("_ends", F.lit(2 * i + 1)).alias("hi"),
        ) for i, (name, q) in enumerate(fractions.items())])
    marks = sketch.select(*keys, F.explode(wanted).alias("w")).select(*keys, "w.*")
    bounds = marks.groupBy(*keys).agg(F.collect_list(F.struct("name", "k", "lo", "hi")).alias("_w"))
    # Every group has one small row of bounds: broadcast when the groups are few, else
    # met by key and salt, so that no group's rows gather in one task.
    placed = join_small(src, bounds, keys, spread=F.col("_v")) if by else src.withColumn("_w", bounds.select("_w").scalar())
    counted = (
        placed.select(*keys, "_v", F.explode(F.filter("_w", lambda w: F.col("_v") <= w["hi"])).alias("w"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("w.lo"), F.col("_v")))
        .groupBy(*keys, "w", "_v").agg(F.count("*").alias("c"))
    )
    # A null value stands for all rows below the bracket; nulls sort first.
    upto = Window.partitionBy(*keys, "w").orderBy(F.col("_v").asc_nulls_first())
    found = (
        counted.withColumn("_upto", F.sum("c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_upto") > F.col("w.k"))
        .groupBy(*keys, F.col("w.name").alias("name")).agg(F.min("_v").alias("value"))
    )
    named = found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in fractions])
    if by:
        return join_small(sketch.select(*keys, "n", "mean"), named, keys)
    return sketch.select("n", "mean", *[named.select(name).scalar().alias(name) for name in fractions])


