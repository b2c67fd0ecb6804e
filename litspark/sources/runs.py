"""Tables written in committed steps, so that a crash or a second run neither loses nor doubles rows.

Every step of a run owns one folder per table, ``<table>/run_id=…/batch_id=…``,
and overwrites it when it is repeated. A step counts once its row in ``commits``
stands, which is written last; readers see committed steps only. Runs have ids
of their own, so batch numbers that start again never meet an earlier run's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_STEP = "run_id string, batch_id bigint"


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def put(df: DataFrame, path: str, name: str, run_id: str, batch_id: int, **options: str) -> DataFrame:
    """Write one step's rows of a table and read them back with the same schema, however many there are."""
    at = f"{path}/{name}/run_id={run_id}/batch_id={batch_id}"
    df.write.mode("overwrite").options(**{"compression": "zstd", **options}).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def commit(spark: SparkSession, path: str, run_id: str, batch_id: int) -> None:
    put(spark.range(1).select(F.current_timestamp().alias("committed_at")), path, "commits", run_id, batch_id)


def read(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """The committed rows of a table, with their ``run_id`` and ``batch_id``.

    ``schema`` is needed only where the table may not exist yet.
    """
    steps = table(spark, f"{path}/commits", f"committed_at timestamp, {_STEP}").select("run_id", "batch_id")
    if schema is not None:
        rows = table(spark, f"{path}/{name}", f"{schema}, {_STEP}")
    else:
        found = spark.read.parquet(f"{path}/{name}")
        plain = found.drop("run_id", "batch_id").schema
        rows = spark.read.schema(plain.add("run_id", "string").add("batch_id", "long")).parquet(f"{path}/{name}")
    return rows.join(steps, ["run_id", "batch_id"], "left_semi")
