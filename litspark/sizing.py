"""Size checks in front of everything that is broadcast or collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
#: Bytes of the values of a table that is broadcast; with those of its hash table several times that.
BROADCAST_BYTES = 64 << 20
LITERAL_ROWS = 2_000


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, reading no more than needed."""
    return df.limit(max_rows + 1).count() <= max_rows


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes a value takes in a row: eight for a number or null, more for what has a length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(value).cast("long"), F.lit(0))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            inner = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + value_bytes(x, kind.elementType))
        else:
            inner = F.when(value.isNotNull(), F.size(value) * F.lit(8).cast("long"))
        return F.lit(16) + F.coalesce(inner, F.lit(0))
    if isinstance(kind, T.MapType):
        return value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((value_bytes(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.VariantType):
        return value_bytes(value.cast("string"), T.StringType())
    return F.lit(8).cast("long")


def fits_bytes(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes, reading no more rows than needed and only columns whose width varies."""
    width = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    found = df.select(width.alias("_width")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum("_width").alias("bytes")).first()
    return found["n"] <= max_rows and (found["bytes"] or 0) <= max_bytes


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash ``df`` over all cores when its scan has fewer partitions than that.

    A small table in one file would otherwise be processed by one task. A large
    scan already has more partitions than cores and comes back unchanged, so no
    shuffle is added where it would cost anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def join_small(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
    spread: Column | None = None, salts: int = 32, max_rows: int = BROADCAST_ROWS,
    bounded_by: DataFrame | None = None,
) -> DataFrame:
    """Equi-join ``small`` into ``big`` without moving ``big`` when size allows.

    Up to ``max_rows`` rows and ``BROADCAST_BYTES`` the small side is broadcast. Beyond that both sides
    shuffle, and with ``spread`` (a high-cardinality expression over ``big``)
    every key is split over ``salts`` tasks, so one hot key does not make one
    long task. ``left`` joins need every salt present, so they salt as well.
    ``bounded_by`` is a cheaper table with at least as many rows as ``small``, whose own rows are narrow.
    """
    if fits_bytes(small if bounded_by is None else bounded_by, max_rows):
        return big.join(F.broadcast(small), on, how)
    if spread is None:
        return big.join(small, on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Spark estimates the copies as one: it would broadcast what is ``salts`` times its bound.
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
