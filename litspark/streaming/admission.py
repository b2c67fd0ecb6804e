"""Admission of new papers by state that the stream itself keeps, one entry per paper.

The batch form (:func:`litspark.streaming.jobs.ingest_stream`) joins every
micro-batch with all ids committed so far. Here the ids lie in the query's state
store, by paper: a micro-batch reads and writes the ids it holds and no others.
The first start takes over the ids of the committed table. Sources that run at
the same time belong into one query, as a union: each sees what the other let in.
Ids lie in a fixed number of hashed buckets, each a map in the state store, so that
a call of Python settles many papers; an entry is read and written by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from litspark import constants as K
from litspark.operators import quality
from litspark.sources import runs
from litspark.streaming import jobs

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Fixed, since checkpoints depend on it.
BUCKETS = 1 << 12


def _in_bucket(key: str = "paper_key") -> list[Column]:
    """Bucket and entry of an id; a null id is an entry like others."""
    return [F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"),
            F.coalesce(F.concat(F.lit("s"), F.col(key).cast("string")), F.lit("n")).alias("entry")]


class _FirstAdmitted(StatefulProcessor):
    """Per paper: the topic it was admitted under. Of a micro-batch's copies the one of the first topic counts."""

    def init(self, handle) -> None:
        self._admitted = handle.getMapState("admitted", "entry string", "topic string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for entry, topic in zip(initialState["entry"], initialState["topic"]):
            self._admitted.updateValue((entry,), (topic,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        for frame in rows:
            for row in zip(frame["entry"], frame["place"], frame["topic"], frame["passed"], frame["paper"]):
                # A topic that is null goes before all of its place, as in the batch form.
                order = (row[1], row[2] is not None, row[2] or "")
                if row[0] not in best or order < best[row[0]][0]:
                    best[row[0]] = (order, row)
        papers = []
        for entry, (_, (_, _, topic, passed, paper)) in best.items():
            if self._admitted.containsKey((entry,)):
                continue
            if passed:
                self._admitted.updateValue((entry,), (topic,))
            papers.append(paper)
        if papers:
            yield pd.DataFrame({"paper": papers})

    def close(self) -> None:
        pass


def admit(papers: DataFrame, known: DataFrame) -> DataFrame:
    """Stream of scored papers whose id is neither in ``known(paper_key, topic)`` nor admitted before.

    Papers that fail the gate pass through too, for the log, but leave no state:
    a mended copy may come later. ``known`` is read at the first start of a
    checkpoint only. A null id is an id like others. The papers travel as JSON,
    since their sections are nested.
    """
    scored = quality.score_papers(papers)
    place = F.array_position(F.array(*map(F.lit, K.TOPICS)), F.col("topic"))
    packed = scored.select(
        *_in_bucket(), F.when(place > 0, place).otherwise(F.lit((1 << 31) - 1)).cast("long").alias("place"),
        "topic", "passed", F.to_json(F.struct(*scored.columns)).alias("paper"))
    kept = packed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_FirstAdmitted(), outputStructType="paper string", outputMode="append", timeMode="none",
        initialState=known.select(*_in_bucket(), "topic").groupBy("bucket"))
    return kept.select(F.from_json("paper", scored.schema).alias("p")).select("p.*")


def ingest_stateful(papers: DataFrame, path: str, checkpoint: str, embedder: Callable[[list], list], table_cap: int | None = None):
    """Stream of parsed papers into the tables of :func:`jobs.ingest_stream`, in the same committed steps.

    A paper whose embedding fails was admitted: it stands in ``failed`` until
    :func:`jobs.retry_failed` takes it, and copies that come later are left out.
    A restart goes on from the checkpoint's state. The session must keep state in
    RocksDB (``STORE``), whose size is the disk's, not the heap's.
    """
    spark = papers.sparkSession
    if spark.conf.get(STORE, "") != ROCKSDB:
        raise ValueError(f"set {STORE} to {ROCKSDB}")

    def settle(batch: DataFrame, batch_id: int) -> None:
        jobs.settle_scored(batch, path, jobs.run_id_of(batch.sparkSession, checkpoint), batch_id, embedder, table_cap)

    known = runs.read(spark, path, "state", jobs.STATE).dropDuplicates(["paper_key"])
    return admit(papers, known).writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The session keeps the state of stream queries started inside in RocksDB."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
