"""Corpus build: from parsed papers to chunk, vector and state tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.operators import corpus, quality, stats
from litspark.operators.scorers import BATCH_BYTES, embed
from litspark.session import arrow_batches, store
from litspark.sources import runs


@dataclass(frozen=True)
class CorpusBuild:
    """Lazy outputs of a corpus build; only ids have been read.

    ``outputs`` gives papers, chunks and rejected papers of a table of scored ones.
    """

    papers: DataFrame
    chunks: DataFrame
    rejected: DataFrame
    found: DataFrame
    new: DataFrame
    scored: DataFrame
    outputs: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]

    def would_fetch(self) -> DataFrame:
        """Dry run: how many papers per topic a build would take."""
        return self.new.groupBy("topic").agg(F.count("*").alias("would_fetch"))


def build_corpus(papers: DataFrame, state: DataFrame, meta: DataFrame | None = None,
                 skip_low_quality: bool = True, max_papers_per_topic: int | None = None,
                 size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, table_cap: int | None = None) -> CorpusBuild:
    """Skip known papers, settle topics, gate quality, attach metadata, chunk.

    Which papers are new, and under which topic, is decided on ids alone; whole
    papers move only to meet their own copies. Gate and chunking are row-local.
    Give it a stored table: the ids and the papers are read separately.
    """
    # The per-topic cap limits what a search offers, before known ids are skipped.
    offered = papers if max_papers_per_topic is None else corpus.cap_per_topic(papers, max_papers_per_topic)
    found = offered.select("paper_key", "topic")
    new = corpus.skip_known(corpus.first_topic_wins(found), state)
    fresh = corpus.new_papers(offered, state).where("paper_key is not null and topic is not null")
    scored = quality.score_papers(fresh)

    def outputs(scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        kept = quality.passed(scored) if skip_low_quality else scored.drop("score", "passed", "reasons")
        ready = corpus.attach_metadata(kept, corpus.no_metadata(kept.sparkSession) if meta is None else meta)
        return ready, corpus.with_embedding_text(corpus.chunk_papers(ready, size, overlap, table_cap)), quality.rejections(scored)

    ready, chunks, rejected = outputs(scored)
    return CorpusBuild(papers=ready, chunks=chunks, rejected=rejected, found=found, new=new, scored=scored, outputs=outputs)


def ingest(build: CorpusBuild, embedder: Callable[[list], list], path: str, run_id: str | None = None) -> DataFrame:
    """Embed and write a build as one committed step; returns the ingest summary.

    The commit goes last and readers (``runs.read``) see committed steps only, so
    a run that breaks off at any write leaves nothing behind that counts, and
    its repetition doubles nothing. Only papers whose chunks all have a vector
    enter ``chunks`` and ``state``; a failed batch leaves them to the next run.
    The written table, not a cached plan, feeds everything after the write, so
    the embedder runs once however many executors come and go.
    """
    spark = build.chunks.sparkSession
    run_id = run_id or uuid.uuid4().hex

    def put(df: DataFrame, name: str) -> DataFrame:
        return runs.put(df, path, name, run_id, 0)

    # Scored once and read back, as in the stream.
    papers, chunks, rejected = build.outputs(put(build.scored, "scored"))
    accepted = put(papers.select("paper_key", "topic"), "accepted")
    with arrow_batches(spark, BATCH_BYTES):
        written = put(embed(chunks, embedder), "staged")
    ids = store(written.groupBy("paper_key").agg(F.bool_and(F.col("embedding").isNotNull()).alias("ok")), "ingest-ids")
    done = ids.where("ok").select("paper_key")
    order = [c for c in ("topic", "year") if c in written.columns]
    put(corpus.only(written, ids, F.col("ok")).sortWithinPartitions(*order), "chunks")
    put(rejected, "rejected")
    # A paper that yields no chunk at all is complete as well.
    empty = accepted.join(ids, "paper_key", "left_anti")
    finished = accepted.join(done, "paper_key", "left_semi").unionByName(empty)
    put(finished.select("paper_key", "topic", F.current_timestamp().alias("committed_at")), "state")
    summary = put(stats.ingest_summary(
        build.found, build.new, accepted, written.withColumn("embedded", F.col("embedding").isNotNull())), "summary")
    runs.commit(spark, path, run_id, 0)
    return summary
