"""Corpus, ingestion, processing and session statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.scores import embedding_cost
from litspark.functions.text import word_count


def corpus_stats(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows ``(facet, value, n)``: totals, and papers by topic, year and design without nulls.

    One pass over the papers: the grouping sets are counted together.
    """
    slim = papers.select("topic", F.col("year").cast("string").alias("year"), "study_design")
    sets = slim.groupingSets([["topic"], ["year"], ["study_design"], []], "topic", "year", "study_design").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"))
    facet = F.when(F.col("gid") == 3, "topic").when(F.col("gid") == 5, "year").when(
        F.col("gid") == 6, "study_design").otherwise("papers")
    by_facet = sets.select(facet.alias("facet"), F.coalesce("topic", "year", "study_design").alias("value"), "n")
    kept = by_facet.where((F.col("facet") == "papers") | F.col("value").isNotNull())
    total = chunks.agg(F.count("*").alias("n")).select(
        F.lit("chunks").alias("facet"), F.lit(None).cast("string").alias("value"), "n")
    return kept.unionByName(total)


def collection_stats(vectors: DataFrame) -> DataFrame:
    """Row count and vector length."""
    return vectors.agg(F.count("*").alias("point_count"), F.max(F.size("embedding")).alias("dense_vector_size"))


def ingest_summary(found: DataFrame, new: DataFrame, fetched: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per topic and in total: papers fetched and skipped, chunks, embedded chunks, cost.

    ``found(paper_key, topic)`` is what the search offered, ``new`` what was left
    after known ids and ids of earlier topics, ``fetched`` the papers that passed
    the gate; ``chunks(topic, embed_text, embedded)`` come from those. The total
    row has a null topic.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("topic").agg(F.count("*").alias(name))

    by_paper = counted(found, "_found").join(counted(new, "_new"), "topic", "left").join(
        counted(fetched, "papers_fetched"), "topic", "left").withColumn(
        "papers_skipped", F.col("_found") - F.coalesce("_new", F.lit(0))).drop("_found", "_new")
    by_chunk = chunks.groupBy("topic").agg(
        F.count("*").alias("chunks_produced"), F.count_if("embedded").alias("chunks_embedded"),
        F.sum(F.when(F.col("embedded"), word_count(F.col("embed_text")))).alias("_words"))
    counters = ["papers_fetched", "papers_skipped", "chunks_produced", "chunks_embedded", "_words"]
    topics = by_paper.join(by_chunk, "topic", "left").na.fill(0, counters)
    return topics.rollup("topic").agg(*[F.sum(c).alias(c) for c in counters]).select(
        "topic", *counters[:4], embedding_cost(F.col("_words")).alias("estimated_cost_usd"))


def embedding_costs(chunks: DataFrame) -> DataFrame:
    """Per topic: chunks, words handed to the embedder, estimated cost."""
    return chunks.groupBy("topic").agg(
        F.count("*").alias("chunks"), F.sum(word_count(F.col("embed_text"))).alias("words")
    ).withColumn("estimated_cost_usd", embedding_cost(F.col("words")))


def processing_stats(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per topic and overall: papers, sections, chunks and their averages to one digit.

    ``papers(topic, num_sections)``, ``chunks(topic, text)``.
    """
    p = papers.groupBy("topic").agg(F.count("*").alias("papers"), F.sum("num_sections").alias("sections"))
    c = chunks.groupBy("topic").agg(F.count("*").alias("chunks"), F.sum(word_count(F.col("text"))).alias("_words"))
    counts = ["papers", "sections", "chunks", "_words"]
    both = p.join(c, "topic", "left").na.fill(0, counts)
    rolled = both.rollup("topic").agg(*[F.sum(x).alias(x) for x in counts])
    return rolled.select(
        "topic", "papers", "sections", "chunks",
        F.round(F.col("sections") / F.col("papers"), 1).alias("avg_sections_per_paper"),
        F.round(F.col("chunks") / F.col("papers"), 1).alias("avg_chunks_per_paper"),
        F.round(F.col("_words") / F.nullif(F.col("chunks"), F.lit(0)), 1).alias("avg_chunk_length"))


def session_trend(rows: DataFrame, block: int = 100_000) -> DataFrame:
    """Per session in query order: overall quality in percent and running mean latency.

    ``rows(session_id, seq, faithfulness, relevance, precision, latency)``. Running
    values are taken inside blocks of ``block`` positions and shifted by the totals
    of the blocks before, so one hot session is spread over many tasks.
    """
    cut = rows.withColumn("_b", F.floor(F.col("seq") / block))
    totals = cut.groupBy("session_id", "_b").agg(F.count("*").alias("_n"), F.sum("latency").alias("_s"))
    before = Window.partitionBy("session_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("session_id", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
                            F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s"))
    order = Window.partitionBy("session_id", "_b").orderBy("seq")
    n = F.row_number().over(order) + F.col("_n")
    running = F.sum("latency").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_s")
    return cut.join(offsets, ["session_id", "_b"]).select(
        "session_id", "seq", n.alias("n"),
        ((F.col("faithfulness") + F.col("relevance") + F.col("precision")) / 3 * 100).alias("overall"),
        (running / n).alias("avg_latency"))


def session_summary(rows: DataFrame, fast: float = 0.5) -> DataFrame:
    """Per session: queries, mean, fastest and slowest latency, share answered under ``fast``."""
    return rows.groupBy("session_id").agg(
        F.count("*").alias("queries"), F.avg("latency").alias("avg_latency"),
        F.min("latency").alias("fastest"), F.max("latency").alias("slowest"),
        (F.count_if(F.col("latency") < fast) / F.count("*")).alias("cache_rate"))


def request_counts(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """Requests per key and fixed minute, with how many exceeded the limit."""
    return requests.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count("*").alias("requests")).select(
        "key", F.col("w.start").alias("window_start"), "requests",
        F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))


def stat_deltas(before: DataFrame, after: DataFrame, before_chunks: DataFrame, after_chunks: DataFrame) -> DataFrame:
    """Signed counts ``(facet, value, n)`` of one step, for the papers and chunks it removes and adds."""
    def counted(papers: DataFrame, chunks: DataFrame, sign: int) -> DataFrame:
        return corpus_stats(papers, chunks).withColumn("n", F.col("n") * sign)

    return counted(after, after_chunks, 1).unionByName(counted(before, before_chunks, -1)).groupBy("facet", "value").agg(
        F.sum("n").alias("n")).where("n <> 0")


def stats_of_deltas(deltas: DataFrame) -> DataFrame:
    """``corpus_stats`` from the signed counts of all committed steps; facets that sum to nothing are left out, totals stay."""
    total = F.col("facet").isin("papers", "chunks")
    return deltas.groupBy("facet", "value").agg(F.sum("n").alias("n")).where((F.col("n") != 0) | total)
