"""Events as request, latency and run logs; sessions; streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.operators import evaluate, stats
from litspark.operators.keyword import top_ranked
from litspark.operators.quantiles import positional_quantiles
from litspark.operators.scorers import embed
from litspark.plans import corpus as corpus_plan
from litspark.queries import views as V
from litspark.queries.papers import _SCORED
from litspark.queries.papers import _with as _quality_sql
from litspark.session import shared_dir, store
from litspark.sources import runs
from litspark.streaming import admission, jobs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp, as watermarks need."""
    return V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def latency_percentiles(spark, sf_dir):
    """Positional percentiles and mean over all events."""
    out = evaluate.latency_stats(_events(spark, sf_dir), "value")
    return out.select("p50", "p95", "p99", F.round("mean", 10).alias("mean"), "n")


def latency_by_type(spark, sf_dir):
    """The same per event type."""
    out = positional_quantiles(_events(spark, sf_dir), "value", evaluate.LATENCY, ["event_type"], accuracy=50)
    return out.select("event_type", "p50", "p95", "p99", F.round("mean", 10).alias("mean"), "n")


def _requests(spark, sf_dir):
    u = F.col("user_id")
    e = _events(spark, sf_dir)
    return e.select(
        "ts", F.when(F.col("event_type") == "signup", "/health/live").otherwise(F.concat(F.lit("/"), "event_type")).alias("path"),
        F.when(u % 3 != 0, F.concat(F.lit("k"), u.cast("string"))).alias("api_key"), F.concat(F.lit("10.0.0."), u.cast("string")).alias("ip"))


def rate_limit_minute(spark, sf_dir):
    """Requests per counter key and clock hour, with how many went over a limit of 2."""
    keyed = jobs.request_keys(_requests(spark, sf_dir))
    out = stats.request_counts(keyed, limit=2, seconds=3600)
    return out.select("key", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", "rejected")


def rate_limit_exact(spark, sf_dir):
    """Every request admitted or rejected in windows anchored at a key's first request."""
    keyed = jobs.request_keys(_requests(spark, sf_dir))
    out = jobs.limit_requests(keyed)
    return out.groupBy("key").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))


def _sessions(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 11 / 10).alias("faithfulness"),
        (F.col("event_id") % 7 / 6).alias("relevance"), (F.col("event_id") % 5 / 4).alias("precision"), (F.col("value") / 10).alias("latency"))


def session_trend(spark, sf_dir):
    """Overall quality and running mean latency of every query of every session."""
    t = stats.session_trend(_sessions(spark, sf_dir), block=500)
    return t.select("session_id", "seq", F.col("n").cast("bigint").alias("n"), F.round("overall", 10).alias("overall"),
                    F.round("avg_latency", 10).alias("avg_latency"))


def session_metrics(spark, sf_dir):
    """Queries, latency range and share of fast answers per session."""
    s = stats.session_summary(_sessions(spark, sf_dir))
    return s.select("session_id", "queries", F.round("avg_latency", 10).alias("avg_latency"), "fastest", "slowest",
                    F.round("cache_rate", 10).alias("cache_rate"))


def latest_run(spark, sf_dir):
    """The last purchase event as the latest completed run."""
    e = V.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("finished_at"), "value",
        F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"))
    return evaluate.latest_completed(e).select("run_id", "status", "value")


def candidate_ranks(spark, sf_dir):
    """The 20 best events per user by value with their ranks."""
    top = top_ranked(V.table(spark, sf_dir, "events"), 20, F.col("value"), "user_id", "event_id")
    return top.select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def audit_stream(spark, sf_dir):
    """Answered turns streamed twice into the audit table; repeats are dropped."""
    land, out, mark = (_folder(spark, n) for n in ("landing", "audit", "mark"))
    rows = V.answered(spark, sf_dir).select(
        "query_id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"), "question", "answer")
    for part in ("first", "again"):
        rows.write.mode("overwrite").parquet(f"{land}/{part}")
    none = lambda kind: F.lit(None).cast(kind)
    chunk = "array<struct<pmid:string,title:string,section:string,relevance_score:double>>"
    src = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(land).withColumns({
        "rewritten_query": none("string"), "confidence": none("double"), "gate_decision": none("string"), "model": none("string"),
        "provider": none("string"), "input_tokens": none("int"), "output_tokens": none("int"), "retrieval_ms": none("double"),
        "generation_ms": none("double"), "user_id": none("string"), "session_id": none("string"),
        "hallucinated_citations": none("array<bigint>"), "chunks": F.array().cast(chunk)})
    query = jobs.audit_stream(src).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select("query_id", F.md5("answer").alias("answer_md5"), "flagged")


def minute_stream(spark, sf_dir):
    """Requests counted per key and hour by a watermarked stream; a closing event at the end of the input ends all windows."""
    land, out, mark = (_folder(spark, n) for n in ("requests", "counts", "mark"))
    requests = _requests(spark, sf_dir)
    requests.write.mode("overwrite").parquet(land)
    schema = spark.read.parquet(land).schema

    def drain() -> None:
        counts = jobs.minute_counts(jobs.request_keys(spark.readStream.schema(schema).parquet(land)), seconds=3600)
        counts.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    drain()
    jobs.closing_request(spark.read.parquet(land), seconds=3600).write.mode("append").parquet(land)
    drain()
    return spark.read.schema("key string, window_start timestamp, requests bigint, rejected bigint").parquet(out).groupBy("key").agg(
        F.count("*").alias("windows"), F.sum("requests").alias("requests"))


def ingest_stream(spark, sf_dir):
    """Papers streamed into chunks twice; the second pass adds nothing."""
    land, out, mark, mark2 = (_folder(spark, n) for n in ("papers", "corpus", "mark", "mark"))
    p = V.papers(spark, sf_dir).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    p.write.mode("overwrite").parquet(land)
    embedder = lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]
    for checkpoint in (mark, mark2):
        src = spark.readStream.schema(p.schema).parquet(land)
        jobs.ingest_stream(src, out, checkpoint, embedder, K.TABLE_WORD_CAP).trigger(availableNow=True).start().awaitTermination()
    return _by_topic(runs.read(spark, out, "chunks"))


def ingest_state(spark, sf_dir):
    """Two folders with the same papers streamed at the same time in one query that keeps the ids as state, half of them known before."""
    half, one, two, out = (_folder(spark, n) for n in ("half", "one", "two", "corpus"))
    p = V.papers(spark, sf_dir).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    p.where(F.pmod(F.col("paper_key").cast("bigint"), F.lit(2)) == 0).write.parquet(half)
    src = spark.readStream.schema(p.schema).parquet(half)
    jobs.ingest_stream(src, out, _folder(spark, "mark"), _word_counts, K.TABLE_WORD_CAP).trigger(availableNow=True).start().awaitTermination()
    for land in (one, two):
        p.write.parquet(land)
    both = [spark.readStream.schema(p.schema).parquet(land) for land in (one, two)]
    with admission.rocksdb_state(spark):
        admission.ingest_stateful(both[0].unionByName(both[1]), out, _folder(spark, "mark"), _word_counts, K.TABLE_WORD_CAP).trigger(
            availableNow=True).start().awaitTermination()
    return _by_topic(runs.read(spark, out, "chunks"))


def ingest_retry(spark, sf_dir):
    """Papers streamed while the model fails on some texts, once more under a second checkpoint, then the failed ones retried."""
    land, out = _folder(spark, "papers"), _folder(spark, "corpus")
    p = V.papers(spark, sf_dir).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    p.write.parquet(land)

    def ailing(texts):
        return [None if len(t) % 5 == 0 else v for t, v in zip(texts, _word_counts(texts))]

    for _ in range(2):
        src = spark.readStream.schema(p.schema).parquet(land)
        jobs.ingest_stream(src, out, _folder(spark, "mark"), ailing, K.TABLE_WORD_CAP).trigger(availableNow=True).start().awaitTermination()
    for run_id in ("retry", "again"):
        jobs.retry_failed(spark, out, _word_counts, run_id, K.TABLE_WORD_CAP)
    return _by_topic(runs.read(spark, out, "chunks").where(F.col("embedding").isNotNull()))


def _by_topic(chunks):
    return chunks.groupBy("topic").agg(F.count("*").alias("chunks"), F.count_distinct("paper_key").alias("papers"))


def _word_counts(texts):
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def ingest_two_sources(spark, sf_dir):
    """Two folders streamed under two checkpoints into one table, the first once more under a third."""
    even, odd, out = (_folder(spark, n) for n in ("even", "odd", "corpus"))
    p = V.papers(spark, sf_dir).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    for part, land in ((0, even), (1, odd)):
        p.where(F.pmod(F.col("paper_key").cast("bigint"), F.lit(2)) == part).write.parquet(land)
    for land in (even, odd, even):
        src = spark.readStream.schema(p.schema).parquet(land)
        jobs.ingest_stream(src, out, _folder(spark, "mark"), _word_counts, K.TABLE_WORD_CAP).trigger(availableNow=True).start().awaitTermination()
    return _by_topic(runs.read(spark, out, "chunks"))


def ingest_rerun(spark, sf_dir):
    """A batch build that breaks off before its commit, the same again, and a third that finds nothing new."""
    out = _folder(spark, "corpus")
    p = store(V.papers(spark, sf_dir).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id"), "papers")
    for commits in (False, True, True):
        build = corpus_plan.build_corpus(p, runs.read(spark, out, "state", jobs.STATE), table_cap=K.TABLE_WORD_CAP)
        if commits:
            corpus_plan.ingest(build, _word_counts, out)
        else:
            runs.put(embed(build.chunks, _word_counts), out, "chunks", "broken", 0)
    return _by_topic(runs.read(spark, out, "chunks"))


QUERIES = {f.__name__: f for f in (
    latency_percentiles, latency_by_type, rate_limit_minute, rate_limit_exact, session_trend, session_metrics, latest_run,
    candidate_ranks, audit_stream, minute_stream, ingest_stream, ingest_two_sources, ingest_rerun, ingest_retry, ingest_state)}
#: The name under which all windows were counted first.
QUERIES["minute_stream_closed"] = minute_stream

_PCT = "list(value ORDER BY value)[least(CAST(floor(count(*) * {0}::DOUBLE) AS BIGINT), count(*) - 1) + 1]"
_PCTS = ", ".join(f"{_PCT.format(q)} AS {n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
_KEYED = """
SELECT ts, CASE WHEN user_id % 3 <> 0 THEN 'key:k' || user_id ELSE 'ip:10.0.0.' || user_id END AS key FROM events WHERE event_type <> 'signup'"""

ORACLE = {
    "latency_percentiles": f"SELECT {_PCTS}, round(avg(value), 10) AS mean, count(*) AS n FROM events",
    "latency_by_type": f"SELECT event_type, {_PCTS}, round(avg(value), 10) AS mean, count(*) AS n FROM events GROUP BY event_type",
    "rate_limit_minute": f"""
        SELECT key, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, greatest(count(*) - 2, 0) AS rejected
        FROM ({_KEYED}) GROUP BY ALL""",
    # Window starts chain from one request to the first one a minute or more later.
    "rate_limit_exact": f"""
        WITH RECURSIVE k AS MATERIALIZED ({_KEYED}),
        w AS (SELECT key, min(ts) AS s FROM k GROUP BY key
              UNION ALL
              SELECT w.key, (SELECT min(ts) FROM k WHERE k.key = w.key AND k.ts >= w.s + INTERVAL 60 SECOND) AS s FROM w
              WHERE EXISTS (SELECT 1 FROM k WHERE k.key = w.key AND k.ts >= w.s + INTERVAL 60 SECOND)),
        c AS (SELECT w.key, w.s, count(*) AS n FROM w JOIN k ON k.key = w.key AND k.ts >= w.s AND k.ts < w.s + INTERVAL 60 SECOND GROUP BY ALL)
        SELECT key, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(least(n, CASE WHEN key LIKE 'key:%' THEN 60 ELSE 10 END)) AS BIGINT) AS allowed
        FROM c GROUP BY key""",
    "session_trend": """
        SELECT user_id AS session_id, event_id AS seq, row_number() OVER w AS n,
               round((event_id % 11 / 10 + event_id % 7 / 6 + event_id % 5 / 4) / 3 * 100, 10) AS overall, round(avg(value / 10) OVER w, 10) AS avg_latency
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
    "session_metrics": """
        SELECT user_id AS session_id, count(*) AS queries, round(avg(value / 10), 10) AS avg_latency, min(value / 10) AS fastest, max(value / 10) AS slowest,
               round(count(*) FILTER (value / 10 < 0.5) / count(*), 10) AS cache_rate FROM events GROUP BY user_id""",
    "latest_run": """
        SELECT event_id AS run_id, 'completed' AS status, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1""",
    "candidate_ranks": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 20",
    "minute_stream": f"""
        SELECT key, count(*) AS windows, CAST(sum(n) AS BIGINT) AS requests FROM (
          SELECT key, date_trunc('hour', ts) AS h, count(*) AS n FROM ({_KEYED}) GROUP BY ALL) GROUP BY key""",
    "ingest_stream": _quality_sql("papers_v kept_v chunks_v", _SCORED, """
        SELECT c.topic, count(*) AS chunks, count(DISTINCT doc_id) AS papers FROM chunks_v c JOIN (SELECT doc_id FROM verdict_v WHERE passed) USING (doc_id) GROUP BY c.topic"""),
    "audit_stream": V.sql("qa_v", "SELECT query_id, md5(answer) AS answer_md5, false AS flagged FROM qa_v"),
}
ORACLE["ingest_two_sources"] = ORACLE["ingest_rerun"] = ORACLE["ingest_retry"] = ORACLE["ingest_state"] = ORACLE["ingest_stream"]
ORACLE["minute_stream_closed"] = ORACLE["minute_stream"]
