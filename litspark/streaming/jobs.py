"""Incremental ingest, audit stream and request limits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from litspark import constants as K
from litspark.operators import corpus, quality
from litspark.operators.scorers import BATCH_BYTES, embed_papers
from litspark.session import arrow_batches
from litspark.sources import runs
from litspark.sources.records import audit_rows


STATE = "paper_key string, topic string"


def run_id_of(spark: SparkSession, checkpoint: str) -> str:
    """The query's own id, which its checkpoint keeps across restarts."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def ingest_stream(papers: DataFrame, path: str, checkpoint: str, embedder: Callable[[list], list], table_cap: int | None = None):
    """Stream of parsed papers into ``papers``, ``chunks``, ``failed``, ``rejected``, ``progress`` and ``state``.

    Each micro-batch is a step of :mod:`litspark.sources.runs`: it skips what any
    other committed step holds, writes its own folders and commits last. A
    repeated batch replaces itself; a new checkpoint is a new run and leaves
    earlier ones alone. Only papers whose chunks all have a vector enter
    ``chunks`` and ``state``; the others stand in ``failed`` for :func:`retry_failed`.
    Read the tables with ``runs.read``.
    """
    def settle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run_id = run_id_of(spark, checkpoint)
        state = runs.read(spark, path, "state", STATE).where((F.col("run_id") != run_id) | (F.col("batch_id") != batch_id))
        scored = quality.score_papers(corpus.new_papers(batch, state))
        settle_scored(scored, path, run_id, batch_id, embedder, table_cap)

    return papers.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint)


def settle_scored(scored: DataFrame, path: str, run_id: str, batch_id: int, embedder: Callable[[list], list], table_cap: int | None) -> None:
    """One step of new papers, each at most once: gate, chunks, log and state, committed last."""
    spark = scored.sparkSession

    def put(df: DataFrame, name: str) -> DataFrame:
        return runs.put(df, path, name, run_id, batch_id)

    # Scored once and read back: gate, chunks, log and state all use this table.
    scored = put(scored, "papers")
    ready = corpus.attach_metadata(quality.passed(scored), corpus.no_metadata(spark))
    put(quality.rejections(scored), "rejected")
    _settle(ready, put, embedder, table_cap)
    runs.commit(spark, path, run_id, batch_id)


def _settle(ready: DataFrame, put: Callable[[DataFrame, str], DataFrame], embedder: Callable[[list], list], table_cap: int | None) -> None:
    """Embed a step's papers: complete ones into ``chunks`` and ``state``, the others into ``failed``.

    Chunks of a paper lie together, so the embedding pass tells which papers are
    complete; no text is shuffled. ``staged`` holds the incomplete papers whole.
    """
    chunks = corpus.with_embedding_text(corpus.chunk_papers(ready, table_cap=table_cap, whole=True))
    with arrow_batches(ready.sparkSession, BATCH_BYTES):
        staged = put(embed_papers(chunks, embedder), "staged")
    names = [c for c in chunks.columns if c != "_paper"]
    put(corpus.with_embedding_text(staged.where("complete")).select(*names, "embedding"), "chunks")
    put(staged.where("_paper is not null").select("_paper.*"), "failed")
    failed = staged.where("not complete").select("paper_key").distinct()
    done = put(ready.select("paper_key", "topic").join(failed, "paper_key", "left_anti"), "state")
    put(batch_progress(done, staged), "progress")


def retry_failed(spark: SparkSession, path: str, embedder: Callable[[list], list], run_id: str, table_cap: int | None = None) -> int:
    """Papers that failed in committed steps and are in no later state, embedded again as one committed step; how many there were."""
    failed = runs.read(spark, path, "failed").drop("run_id", "batch_id")
    todo = corpus.skip_known(failed.dropDuplicates(["paper_key"]), runs.read(spark, path, "state", STATE).where(F.col("run_id") != run_id))

    def put(df: DataFrame, name: str) -> DataFrame:
        return runs.put(df, path, name, run_id, 0)

    ready = put(todo, "retried")
    _settle(ready, put, embedder, table_cap)
    runs.commit(spark, path, run_id, 0)
    return ready.count()


def batch_progress(done: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counters per topic and in total (null topic) after one batch."""
    p = done.groupBy("topic").agg(F.count("*").alias("papers_fetched"))
    c = chunks.groupBy("topic").agg(F.count("*").alias("chunks_produced"),
                                    F.count_if(F.col("embedding").isNotNull()).alias("chunks_embedded"))
    names = ["papers_fetched", "chunks_produced", "chunks_embedded"]
    return p.join(c, "topic", "full_outer").na.fill(0, names).rollup("topic").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def progress_totals(progress: DataFrame) -> DataFrame:
    """Running totals over all batches so far, per topic and overall."""
    return progress.groupBy("topic").agg(*[F.sum(n).alias(n) for n in (
        "papers_fetched", "chunks_produced", "chunks_embedded")])


def audit_stream(answered: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One audit row per answered query; repeats of a query id inside the watermark are dropped."""
    return audit_rows(answered.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["query_id"]))


def request_keys(requests: DataFrame) -> DataFrame:
    """Counter key and limit per request; health paths are exempt.

    ``requests(ts, path, api_key, ip)``.
    """
    named = F.coalesce("api_key", F.lit("")) != ""
    return requests.where(~F.col("path").startswith("/health")).select(
        "ts",
        F.when(named, F.concat(F.lit("key:"), "api_key")).otherwise(
            F.concat(F.lit("ip:"), F.coalesce("ip", F.lit("unknown")))).alias("key"),
        F.when(named, K.KEY_LIMIT).otherwise(K.ANON_LIMIT).alias("limit"))


def minute_counts(keyed: DataFrame, delay: str = "2 minutes", seconds: int = K.WINDOW_SECONDS) -> DataFrame:
    """Requests per key and clock minute with the number over the limit."""
    return keyed.withWatermark("ts", delay).groupBy(
        "key", F.window("ts", f"{seconds} seconds").alias("w")
    ).agg(F.count("*").alias("requests"), F.max("limit").alias("limit")).select(
        "key", F.col("w.start").alias("window_start"), "requests",
        F.greatest(F.col("requests") - F.col("limit"), F.lit(0)).alias("rejected"))


def closing_request(requests: DataFrame, delay: str = "2 minutes", seconds: int = K.WINDOW_SECONDS) -> DataFrame:
    """One request so late that it moves the watermark past every window of ``requests``; its own window stays open.

    Add it to the stream's input once no more requests come; no row for empty input.
    """
    named = F.lit(None).cast("string")
    return requests.agg(F.max("ts").alias("ts")).where("ts is not null").select(
        (F.col("ts") + F.expr(f"interval {2 * seconds} seconds") + F.expr(f"interval {delay}")).alias("ts"),
        F.lit("/closing").alias("path"), named.alias("api_key"), named.alias("ip")).select(*requests.columns)


class _FixedWindow(StatefulProcessor):
    """Per key: start of the current window and requests admitted in it."""

    def init(self, handle) -> None:
        self._state = handle.getValueState("window", "start double, used int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._state.get() if self._state.exists() else None
        start, used = (state[0], state[1]) if state else (None, 0)
        for frame in rows:
            at = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64") / 1e6
            verdicts = []
            for now, limit in zip(at, frame["limit"]):
                if start is None or now - start >= K.WINDOW_SECONDS:
                    start, used = float(now), 0
                admitted = used < limit
                verdicts.append((admitted, int(limit) - used - 1 if admitted else 0))
                used += admitted
            yield pd.DataFrame({
                "key": key[0], "ts": frame["ts"].to_numpy(), "allowed": [v[0] for v in verdicts],
                "remaining": [v[1] for v in verdicts]})
        if start is not None:
            self._state.update((float(start), int(used)))

    def close(self) -> None:
        pass


def limit_requests(keyed: DataFrame) -> DataFrame:
    """Admit or reject every request in windows that start at a key's first request.

    Constant state per key; rows of a key stream through the task, they are
    never collected. Runs on a stream, where requests count in arrival order, and
    on a batch for replay, where they are put in time order first.
    """
    if not keyed.isStreaming:
        keyed.sparkSession.streams  # starts the session's state coordinator, which batches also use
        keyed = keyed.repartition("key").sortWithinPartitions("key", "ts")
    return keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_FixedWindow(), outputStructType="key string, ts timestamp, allowed boolean, remaining int",
        outputMode="append", timeMode="none")
