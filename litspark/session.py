"""Session defaults, and tables written to the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "litspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join handling on."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on a local master, where all tasks share one disk, may name
    none and gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="litspark-")
    return _LOCAL[app]


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, max_bytes: int) -> Iterator[None]:
    """Python tasks of jobs that run inside get Arrow batches of about ``max_bytes``, whatever the size of a row."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(max_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor and still prunes
    columns and row groups; every call writes a new folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/litspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Write several results of one schema one after the other and read them back as one table, which needs no plan of all."""
    path = schema = spark = None
    for i, df in enumerate(parts):
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_dir(spark)}/litspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/part={i}")
    if path is None:
        raise ValueError("no parts")
    return spark.read.schema(schema).parquet(path).select(*schema.names)
