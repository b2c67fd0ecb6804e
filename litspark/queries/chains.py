"""Model seams, refresh, migration, sinks and open metadata over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.operators import scorers, stats
from litspark.plans.migrate import run_migration
from litspark.plans.regulatory import merge_withdrawals
from litspark.queries import chunking, tables
from litspark.queries import papers as P
from litspark.queries import views as V
from litspark.queries.views import sql
from litspark.session import shared_dir
from litspark.sources import formats, records, runs
from litspark.streaming import jobs
from litspark.streaming.progress import ProgressTable


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def relevance_scored(spark, sf_dir):
    """Answered turns scored against their evidence by a caller's model, which fails on batches without a text."""
    pairs = V.answered(spark, sf_dir).select("query_id", "question").join(V.evidence(spark, sf_dir).select("query_id", "rank", "text"), "query_id")
    scored = scorers.score_relevance(pairs, lambda rows: [len(t) / (len(t) + len(q)) for q, t in rows], batch=1)
    return scored.groupBy("query_id").agg(F.count("relevance_score").alias("scored"), F.round(F.sum("relevance_score"), 6).alias("relevance"))


def extractor_seam(spark, sf_dir):
    """Raw extractor answers per paper; the model fails on abstracts of a length divisible by seven."""
    def model(texts):
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("refused")
        return [f"n={len(t)}" for t in texts]

    p = V.papers(spark, sf_dir).select("pmid", "abstract")
    return scorers.extract_responses(p, model, batch=1)


def judge_override(spark, sf_dir):
    """Answered turns with a caller's judgements; where the judge fails the columns are null."""
    def judge(pairs):
        if any(len(a) % 5 == 0 for _, a in pairs):
            raise ValueError("no verdict")
        return [[1.0, len(a) % 4 / 4, 0.5, 0.25, 1.0] for _, a in pairs]

    out = scorers.judge_with(V.answered(spark, sf_dir).select("query_id", "question", "answer"), judge, batch=1)
    return out.select("query_id", "judge_faithfulness", "judge_answer_relevance", "judge_clinical_safety")


def regulatory_refresh(spark, sf_dir):
    """Enforcement records merged into a reference table with manual entries: the refresh as a whole."""
    d = F.col("doc_id")
    docs = V.table(spark, sf_dir, "documents")
    enforcement = docs.select(
        d.alias("seq"), F.concat(F.lit("DRUG"), (d % 20).cast("string")).alias("drug"), F.concat(F.lit("bladder "), "source").alias("product_description"),
        F.lit("defect").alias("reason_for_recall"), F.lit("voluntary").alias("voluntary_mandated"), F.lit("Ongoing").alias("status"), F.lit("20210305").alias("recall_initiation_date"))
    old = spark.range(40).select(
        (F.col("id") - 100).alias("seq"), F.concat(F.lit("drug"), (F.col("id") % 25).cast("string")).alias("drug"), F.lit("FDA").alias("jurisdiction"),
        F.concat(F.lit("old "), F.col("id").cast("string")).alias("warning"), F.when(F.col("id") % 3 == 0, "manual").otherwise("feed").alias("source"))
    merged, _ = merge_withdrawals(old, enforcement)
    return merged.select("seq", "drug", "source", F.left("warning", F.lit(5)).alias("head"))


def feed_union(spark, sf_dir):
    """Two feeds of different columns as one table."""
    d = F.col("doc_id")
    docs = V.table(spark, sf_dir, "documents")
    feeds = records.union_feeds(docs.select(d.alias("seq"), F.col("source").alias("drug")), docs.where(d % 2 == 0).select(d.alias("seq"), F.col("lang").alias("jurisdiction")))
    return feeds.groupBy("drug", "jurisdiction").agg(F.count("*").alias("n"))


def migration_counts(spark, sf_dir):
    """The older collection migrated as a whole; the model fails on some batches of one."""
    def model(texts):
        return [None if len(t) % 6 == 0 else [float(len(t))] for t in texts]

    out = run_migration(*P._eav(spark, sf_dir), model, _folder(spark, "migrated"))
    return out.withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 9))


def report_sink(spark, sf_dir):
    """Evaluation rows written as two runs and read back: rows, the longest stored answer, and whose summary is the latest."""
    path = _folder(spark, "report")
    rows = V.answered(spark, sf_dir).select("query_id", "answer")
    for run_id, cut in (("first", 500), ("second", None)):
        records.write_report(rows, rows.agg(F.count("*").alias("n")), path, run_id, cut)
    read = lambda at: spark.read.json(f"{path}/{at}")
    longest = lambda run_id: read(f"{run_id}/detailed").agg(F.max(F.length("answer")).cast("bigint").alias("x"))
    return read("latest").select("run_id", "n").crossJoin(longest("first").withColumnRenamed("x", "cut")).crossJoin(longest("second").withColumnRenamed("x", "whole"))


def ingest_progress(spark, sf_dir):
    """Progress totals after papers were streamed in two parts."""
    out, land = _folder(spark, "corpus"), _folder(spark, "papers")
    p = V.papers(spark, sf_dir).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    mark = _folder(spark, "mark")
    for part in (0, 1):
        p.where(F.pmod(F.col("paper_key").cast("bigint"), F.lit(2)) == part).write.mode("append").parquet(land)
        src = spark.readStream.schema(p.schema).parquet(land)
        jobs.ingest_stream(src, out, mark, lambda texts: [[float(len(t))] for t in texts], K.TABLE_WORD_CAP).trigger(availableNow=True).start().awaitTermination()
    return jobs.progress_totals(runs.read(spark, out, "progress")).where("papers_fetched > 0")


def eav_variant(spark, sf_dir):
    """Open metadata of every record as one VARIANT, known keys read by path and unknown keys kept, with the schema seen."""
    wide = records.open_metadata(*P._eav(spark, sf_dir))
    seen = wide.agg(F.schema_of_variant_agg("meta").alias("s")).first()[0]
    get = lambda key, kind: F.try_variant_get("meta", f"$.{key}", kind)
    return wide.select("embedding_id", get("pmc_id", "string").alias("pmc_id"), get("year", "bigint").alias("year"), get("title", "string").alias("title"),
                       F.lit("chroma:document" in (seen or "")).alias("document_seen"))


def corpus_stats_incremental(spark, sf_dir):
    """Corpus statistics as the sum of signed counts of three steps: half the papers with wrong years, the rest, and a correction."""
    path = _folder(spark, "deltas")
    p, c = V.papers(spark, sf_dir).select("paper_key", "topic", "year", "study_design"), V.chunk_table(spark, sf_dir).select("paper_key")
    half = F.crc32("paper_key") % 2 == 0
    wrong = p.where(half).withColumn("year", F.col("year") - 3)
    chunks = lambda df: c.join(df.select("paper_key"), "paper_key", "left_semi")
    none, no_chunks = p.limit(0), c.limit(0)
    for step, (before, after, old, new) in enumerate((
            (none, wrong, no_chunks, chunks(wrong)), (none, p.where(~half), no_chunks, chunks(p.where(~half))), (wrong, p.where(half), chunks(wrong), chunks(wrong)))):
        runs.put(stats.stat_deltas(before, after, old, new), path, "deltas", "run", step)
        runs.commit(spark, path, "run", step)
    return stats.stats_of_deltas(runs.read(spark, path, "deltas"))


def jats_source(spark, sf_dir):
    """Documents as XML files, read back with the ``jats`` format: paper fields."""
    folder = _folder(spark, "xml")
    formats.register(spark)
    formats.write_xml_files(chunking._xml(spark, sf_dir), folder)
    return chunking.paper_fields(spark.read.format("jats").load(folder))


def jats_source_stream(spark, sf_dir):
    """XML files that arrive in two parts, streamed with the ``jats`` format under one checkpoint and ledger; a third run adds nothing."""
    folder, ledger, out, mark = (_folder(spark, n) for n in ("xml", "ledger", "papers", "mark"))
    formats.register(spark)
    xml = chunking._xml(spark, sf_dir)
    for part in ("pmod(hash(doc_key), 2) = 0", "pmod(hash(doc_key), 2) = 1", None):
        if part:
            formats.write_xml_files(xml.where(part), folder)
        spark.readStream.format("jats").option("ledger", ledger).load(folder).writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return chunking.paper_fields(spark.read.schema("doc_key string, xml string").parquet(out))


def report_format(spark, sf_dir):
    """Answered turns written twice as a report with the ``report`` format and read back."""
    path = _folder(spark, "report")
    rows = V.answered(spark, sf_dir).select("query_id", "answer")
    for kept in (rows.where("length(answer) % 2 = 0"), rows):
        formats.write_report(kept, path, "run")
    found = spark.read.schema("query_id string, answer string").json(f"{path}/run/part-*.json")
    return found.select("query_id", F.md5("answer").alias("answer_md5"))


def stream_progress(spark, sf_dir):
    """Requests counted by a watermarked stream whose progress a listener writes as rows: rows read, late rows, windows left in state."""
    land, out, mark, log = (_folder(spark, n) for n in ("requests", "counts", "mark", "progress"))
    tables._requests(spark, sf_dir).write.parquet(land)
    listener = ProgressTable(spark, log, names=(land,))
    spark.streams.addListener(listener)
    try:
        src = spark.readStream.schema(spark.read.parquet(land).schema).parquet(land)
        query = jobs.minute_counts(jobs.request_keys(src), seconds=3600).writeStream.queryName(land).format("parquet").option(
            "path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        if not listener.wait(query.runId):
            raise TimeoutError("the listener got no end of the query")
    finally:
        spark.streams.removeListener(listener)
    return listener.read().agg(
        F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"),
        F.max_by("state_rows", "batch_id").alias("open_windows"))


QUERIES = {f.__name__: f for f in (
    relevance_scored, extractor_seam, judge_override, regulatory_refresh, feed_union, migration_counts, report_sink, ingest_progress, eav_variant,
    corpus_stats_incremental, jats_source, jats_source_stream, report_format, stream_progress)}

_COST = f"round(coalesce(sum(CASE WHEN ok THEN len({V.WORDS.format('e')}) END), 0) * {K.TOKENS_PER_WORD} / 1000 * {K.COST_PER_1K_TOKENS}, 9)"
ORACLE = {
    "relevance_scored": sql("qa_v ev_v", """
        SELECT q.query_id, count(e.text) AS scored, round(sum(length(e.text) / (length(e.text) + length(q.question))), 6) AS relevance
        FROM qa_v q JOIN ev_v e USING (query_id) GROUP BY q.query_id"""),
    "extractor_seam": sql("papers_v", "SELECT pmid, CASE WHEN length(abstract) % 7 <> 0 THEN 'n=' || length(abstract) END AS response FROM papers_v"),
    "judge_override": sql("qa_v", """
        SELECT query_id, CASE WHEN length(answer) % 5 <> 0 THEN 1.0::DOUBLE END AS judge_faithfulness,
               CASE WHEN length(answer) % 5 <> 0 THEN (length(answer) % 4 / 4)::DOUBLE END AS judge_answer_relevance,
               CASE WHEN length(answer) % 5 <> 0 THEN 1.0::DOUBLE END AS judge_clinical_safety FROM qa_v"""),
    "regulatory_refresh": """
        WITH o AS (SELECT id - 100 AS seq, 'drug' || (id % 25) AS drug, 'old ' || id AS warning, CASE WHEN id % 3 = 0 THEN 'manual' ELSE 'feed' END AS source FROM range(40) t(id)),
        last AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY drug ORDER BY seq DESC) = 1),
        new AS (SELECT max(doc_id) AS seq, 'drug' || (doc_id % 20) AS drug, 'Drug' || (doc_id % 20) AS warning, 'openfda_api' AS source FROM documents GROUP BY doc_id % 20),
        both_ AS (SELECT *, 0 AS side FROM last UNION ALL SELECT *, 1 FROM new)
        SELECT seq, drug, source, left(warning, 5) AS head FROM both_
        QUALIFY row_number() OVER (PARTITION BY drug ORDER BY source = 'manual' DESC, side DESC) = 1""",
    "feed_union": """
        SELECT source AS drug, NULL::VARCHAR AS jurisdiction, count(*) AS n FROM documents GROUP BY source
        UNION ALL SELECT NULL, lang, count(*) FROM documents WHERE doc_id % 2 = 0 GROUP BY lang""",
    "migration_counts": f"""
        WITH r AS (SELECT CASE WHEN event_id % 3 <> 0 THEN event_type || ' | ' || chr(10) ELSE '' END || 'doc ' || props AS e FROM events),
        d AS (SELECT e, length(e) % 6 <> 0 AS ok FROM r)
        SELECT count(*) AS source_count, count(*) FILTER (ok) AS migrated, count(*) FILTER (NOT ok) AS failed, {_COST} AS estimated_cost_usd FROM d""",
    "report_sink": sql("qa_v", """
        SELECT 'second' AS run_id, count(*) AS n, least(500, max(length(answer))) AS cut, max(length(answer)) AS whole FROM qa_v"""),
    "ingest_progress": P._with("papers_v kept_v chunks_v", P._SCORED, """
        , c AS (SELECT c.topic, count(*) AS n FROM chunks_v c JOIN (SELECT doc_id FROM verdict_v WHERE passed) USING (doc_id) GROUP BY c.topic),
        p AS (SELECT topic, count(*) AS papers FROM verdict_v WHERE passed GROUP BY topic),
        t AS (SELECT topic, papers, coalesce(n, 0) AS n FROM p LEFT JOIN c USING (topic))
        SELECT topic, papers AS papers_fetched, n AS chunks_produced, n AS chunks_embedded FROM t
        UNION ALL SELECT NULL, sum(papers)::BIGINT, sum(n)::BIGINT, sum(n)::BIGINT FROM t"""),
    "eav_variant": """
        SELECT 'e' || event_id AS embedding_id, 'P' || user_id AS pmc_id, event_id % 30 + 1995 AS year, CASE WHEN event_id % 3 <> 0 THEN event_type END AS title,
               true AS document_seen FROM events""",
    "corpus_stats_incremental": P.ORACLE.get("corpus_stats", ""),
    "jats_source": chunking.ORACLE["jats_papers"],
    "jats_source_stream": chunking.ORACLE["jats_papers"],
    "report_format": sql("qa_v", "SELECT query_id, md5(answer) AS answer_md5 FROM qa_v"),
    "stream_progress": f"""
        WITH w AS (SELECT key, date_trunc('hour', ts) + INTERVAL 1 HOUR AS closes, max(ts) AS last FROM ({tables._KEYED}) GROUP BY ALL)
        SELECT (SELECT count(*) FROM events) AS input_rows, 0::BIGINT AS late_rows,
               count(*) FILTER (closes > (SELECT max(last) FROM w) - INTERVAL 2 MINUTE) AS open_windows FROM w""",
}
