"""Stored indexes: inverted vector lists, keyword segments with bounds, name automata, harvest windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.operators import corpus, keyword_segments, names, safety, vector_index
from litspark.operators.dense import dense_topk as nearest
from litspark.queries import retrieval as R
from litspark.queries import views as V
from litspark.queries.answers import ORACLE as ANSWERS
from litspark.queries.answers import withdrawals
from litspark.session import shared_dir
from litspark.sources.records import enforcement_entries


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _ints(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def _centres(spark, sf_dir):
    return R._centroids(spark, sf_dir).select(F.col("label").cast("string").alias("query_id"), "embedding")


def dense_topk_index(spark, sf_dir):
    """The 20 vectors nearest to each label's mean vector, from a stored index that reads every list its bounds leave open."""
    index = vector_index.build(R._points(spark, sf_dir), _folder(spark, "vectors"))
    return _ints(vector_index.search(index, _centres(spark, sf_dir), exact=True), "rank")


def dense_index_recall(spark, sf_dir):
    """Whether the index finds at least nine in ten of the 20 nearest when it probes half its lists, and scores them right."""
    points, asked = R._points(spark, sf_dir), _centres(spark, sf_dir)
    found = vector_index.search(vector_index.build(points, _folder(spark, "vectors")), asked)
    want = nearest(asked, points).select("query_id", "chunk_id", F.col("score").alias("want"))
    met = want.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id")
    return met.agg(F.count("*").alias("wanted"), (F.count("score") >= 0.9 * F.count("*")).alias("recall_reached"),
                   F.coalesce(F.bool_and(F.col("score") == F.col("want")), F.lit(True)).alias("scores_equal"))


def keyword_topk_bounded(spark, sf_dir):
    """Best 20 chunks per question from a segment index that skips blocks by their bounds."""
    path = _folder(spark, "segments")
    keyword_segments.change(spark, path, "build", V.chunk_table(spark, sf_dir).select("chunk_id", "text"))
    return _ints(keyword_segments.search(spark, path, R._questions(spark, sf_dir)).top, "rank")


def keyword_topk_segments(spark, sf_dir):
    """The same after adding in three steps, replacing stale texts, deleting chunks that don't belong, and compaction."""
    path = _folder(spark, "segments")
    chunks = V.chunk_table(spark, sf_dir).select("chunk_id", "text")
    odd = F.pmod(F.crc32("chunk_id"), F.lit(2)) == 1
    strange = chunks.select(F.concat(F.lit("strange "), "chunk_id").alias("chunk_id"), "text")
    keyword_segments.change(spark, path, "first", chunks.withColumn("text", F.when(odd, F.concat(F.lit("stale "), F.reverse("text"))).otherwise(F.col("text"))))
    keyword_segments.change(spark, path, "second", strange)
    keyword_segments.compact(spark, path, "compaction")
    keyword_segments.change(spark, path, "third", chunks.where(odd), strange)
    return _ints(keyword_segments.search(spark, path, R._questions(spark, sf_dir)).top, "rank")


def regulatory_join_automaton(spark, sf_dir):
    """Documents that mention each withdrawn drug in its withdrawn use, by one pass of an automaton over each text."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    entries = safety.withdrawal_entries(withdrawals(spark))
    matched = names.match_names(docs, F.col("text"), F.col("text"), entries).select("entries")
    return names.entry_counts(matched, entries, ["drug", "jurisdiction"]).groupBy("drug", "jurisdiction").agg(F.sum("n").alias("documents"))


#: Words of the driver's texts, watched for beside the drugs.
WATCHED = [*K.WATCH_DRUGS, "thand", "heit", "lich", "in", "with", "orantion", "pour"]


def watchlist_match(spark, sf_dir):
    """Documents as enforcement records, attributed to every watched name in their description, as withdrawal entries."""
    d = F.col("doc_id")
    named = F.concat_ws(" ", V.pick(K.WATCH_DRUGS, d), F.when(d % 3 == 0, "bladder kit;"), F.when(d % 5 == 0, F.concat(V.pick(K.WATCH_DRUGS, d + 7), F.lit("x"))), "text")
    rec = V.table(spark, sf_dir, "documents").select(
        d.alias("seq"), named.alias("product_description"), F.lit("defect.").alias("reason_for_recall"),
        F.when(d % 2 == 0, "Voluntary: Firm Initiated").otherwise("FDA Mandated").alias("voluntary_mandated"),
        F.lit("Ongoing").alias("status"), F.lit("20210305").alias("recall_initiation_date"))
    watch = spark.createDataFrame([(w,) for w in WATCHED], "drug string")
    found = enforcement_entries(names.attribute(rec, watch, F.col("product_description")))
    return found.groupBy("drug", "status", "date").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def harvest_windows(spark, sf_dir):
    """Date windows of at most 9,999 hits, where every event stands for some fifty."""
    hits = V.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), (F.col("user_id") % 100 + 1).cast("bigint").alias("hits"))
    return corpus.harvest_windows(hits)


QUERIES = {f.__name__: f for f in (
    dense_topk_index, dense_index_recall, keyword_topk_bounded, keyword_topk_segments, regulatory_join_automaton, watchlist_match, harvest_windows)}

_TEXT = "concat_ws(' ', " + V.sql_pick(K.WATCH_DRUGS, "doc_id") + ", CASE WHEN doc_id % 3 = 0 THEN 'bladder kit;' END, CASE WHEN doc_id % 5 = 0 THEN " + V.sql_pick(
    K.WATCH_DRUGS, "doc_id + 7") + " || 'x' END, text)"
ORACLE = {
    "dense_topk_index": R.ORACLE["dense_topk"],
    "dense_index_recall": """
        SELECT CAST(label AS VARCHAR) AS query_id, least(20, (SELECT count(*) FROM embeddings)) AS wanted, true AS recall_reached, true AS scores_equal
        FROM embeddings GROUP BY label""",
    "keyword_topk_bounded": R.ORACLE["keyword_topk"],
    "keyword_topk_segments": R.ORACLE["keyword_topk"],
    "regulatory_join_automaton": ANSWERS["regulatory_join"],
    "watchlist_match": f"""
        WITH r AS (SELECT doc_id, lower({_TEXT}) AS t FROM documents WHERE doc_id % 2 = 0),
        w AS (SELECT unnest({V.sql_list(WATCHED)}) AS drug)
        SELECT drug, 'recalled' AS status, '2021-03' AS date, count(*) AS entries, min(doc_id) AS first_seq, max(doc_id) AS last_seq
        FROM r JOIN w ON regexp_matches(t, '(^|[^\\pL\\pN])' || drug || '([^\\pL\\pN]|$)')
        WHERE {' OR '.join(f"contains(t, '{k}')" for k in K.ONCOLOGY_KEYWORDS)} GROUP BY drug""",
    "harvest_windows": f"""
        WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(user_id % 100 + 1) AS hits FROM events GROUP BY 1),
        m AS (SELECT *, sum(hits) OVER (PARTITION BY date_trunc('year', day)) AS y, sum(hits) OVER (PARTITION BY date_trunc('month', day)) AS mo, sum(hits) OVER () AS t FROM d),
        l AS (SELECT day, hits, CASE WHEN t <= {K.HARVEST_LIMIT} THEN 0 WHEN y <= {K.HARVEST_LIMIT} THEN 1 WHEN mo <= {K.HARVEST_LIMIT} THEN 2 ELSE 3 END AS l FROM m),
        w AS (SELECT l, CASE l WHEN 0 THEN NULL WHEN 1 THEN date_trunc('year', day) WHEN 2 THEN date_trunc('month', day) ELSE day END AS k, day, hits FROM l)
        SELECT CASE l WHEN 0 THEN min(day) ELSE CAST(k AS DATE) END AS start,
               CASE l WHEN 1 THEN CAST(k + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) WHEN 2 THEN last_day(CAST(k AS DATE)) ELSE max(day) END AS "end",
               CAST(sum(hits) AS BIGINT) AS hits, sum(hits) > {K.HARVEST_LIMIT} AS over FROM w GROUP BY l, k""",
}
