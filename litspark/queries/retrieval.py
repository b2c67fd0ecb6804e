"""Keyword index, dense search, fusion, reranking, confidence, context."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions import citations as C
from litspark.functions import scores
from litspark.operators import context, fusion
from litspark.operators.confidence import answer_confidence
from litspark.operators.dense import dense_topk as nearest
from litspark.operators.filters import ChunkFilter, request_filters, suppress_weak
from litspark.operators.keyword import build_keyword_index, keyword_scores, prune_index, top_ranked
from litspark.operators.keyword import keyword_topk as search
from litspark.plans.retrieval import META, keyword_search, retrieve
from litspark.queries import views as V
from litspark.queries.views import NOW_YEAR, sql
from litspark.session import shared_dir, store
from litspark.sizing import join_small
from litspark.sources import tables as sources
from litspark.sources.records import external_evidence


def _ints(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# --- keyword ---------------------------------------------------------------------

def keyword_index_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and weight of every term of the corpus."""
    terms = build_keyword_index(V.chunk_table(spark, sf_dir)).terms
    return terms.select("term", "df", F.round("idf", 9).alias("idf"))


def keyword_doc_stats(spark, sf_dir):
    """Corpus size and mean length, with the size of the index."""
    index = build_keyword_index(V.chunk_table(spark, sf_dir))
    posted = index.postings.agg(F.struct(F.count("*").alias("postings"), F.sum("tf").alias("tokens")).alias("p")).scalar()
    return index.stats.select("n_chunks", F.round("avgdl", 10).alias("avgdl"), posted["postings"].alias("postings"),
                              posted["tokens"].alias("tokens"))


def _questions(spark, sf_dir):
    return V.questions(spark, sf_dir).select("query_id", "question")


def keyword_topk(spark, sf_dir):
    """Best 20 chunks per question by keyword score, over the whole corpus."""
    q = _questions(spark, sf_dir)
    return _ints(keyword_search(q, V.chunk_table(spark, sf_dir)), "rank")


def keyword_topk_index(spark, sf_dir):
    """The same through an index of the query vocabulary."""
    q = _questions(spark, sf_dir)
    return _ints(search(prune_index(V.chunk_table(spark, sf_dir), q), q), "rank")


def keyword_topk_stored(spark, sf_dir):
    """The same from an index written to the shared folder and read back, of which only the asked terms' buckets are read."""
    index = build_keyword_index(V.chunk_table(spark, sf_dir)).write(f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return _ints(search(index, _questions(spark, sf_dir)), "rank")


def chunk_paper_join(spark, sf_dir):
    """Chunks written by topic, read back and joined with their papers."""
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    sources.write_chunks(V.chunk_table(spark, sf_dir).select("chunk_id", "paper_key", "topic", "section"), path)
    papers = V.papers(spark, sf_dir).select("paper_key", "journal", "year")
    return sources.chunk_papers_join(sources.read_chunks(spark, path), papers).groupBy("journal", "section").agg(
        F.count("*").alias("chunks"), F.count_distinct("paper_key").alias("papers"), F.max("year").cast("bigint").alias("latest"))


def keyword_matches(spark, sf_dir):
    """How many chunks each question matches and the sum of their scores."""
    q = _questions(spark, sf_dir)
    scored = keyword_scores(prune_index(V.chunk_table(spark, sf_dir), q), q)
    return scored.groupBy("query_id").agg(F.count("*").alias("chunks"), F.round(F.sum("score"), 4).alias("total"))


def keyword_topk_filtered(spark, sf_dir):
    """As above under each question's own filter, where missing values pass."""
    return _ints(keyword_search(V.questions(spark, sf_dir), V.chunk_table(spark, sf_dir)), "rank")


def keyword_topk_filtered_index(spark, sf_dir):
    """The same through an index that carries the filter columns."""
    q, c = V.questions(spark, sf_dir), V.chunk_table(spark, sf_dir)
    return _ints(keyword_search(q, c, prune_index(c, q, META)), "rank")


# --- dense -----------------------------------------------------------------------

def _centroids(spark, sf_dir):
    """One query vector per label: the mean of its vectors."""
    e = V.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def embedding_cosine(spark, sf_dir):
    """Cosine of every vector with the mean vector of its label."""
    c = _centroids(spark, sf_dir).withColumnRenamed("embedding", "center")
    return V.table(spark, sf_dir, "embeddings").join(c, "label").select(
        "vec_id", F.round(scores.cosine(F.col("embedding"), F.col("center")), 10).alias("cosine"))


def _points(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")


def dense_topk(spark, sf_dir):
    """The 20 vectors nearest to each label's mean vector."""
    q = _centroids(spark, sf_dir).select(F.col("label").cast("string").alias("query_id"), "embedding")
    return _ints(nearest(q, _points(spark, sf_dir)), "rank")


def dense_topk_filtered(spark, sf_dir):
    """As above among vectors of even labels only; the filter reaches the scan."""
    q = _centroids(spark, sf_dir).select(F.col("label").cast("string").alias("query_id"), "embedding")
    return _ints(nearest(q, _points(spark, sf_dir), condition=F.col("label").isin(0, 2, 4, 6, 8)), "rank")


def dense_topk_blocks(spark, sf_dir):
    """As ``dense_topk`` through the block plan that serves query sides of any size."""
    q = _centroids(spark, sf_dir).select(F.col("label").cast("string").alias("query_id"), "embedding")
    return _ints(nearest(q, _points(spark, sf_dir), max_query_floats=256), "rank")


# --- filters -----------------------------------------------------------------------

_FILTER = ChunkFilter(cancer_type=("prostate", "kidney"), study_design=("rct", "cohort", "review"),
                      year_min=2012, year_max=2022, evidence_level_max=4)


def filter_nulls_dense(spark, sf_dir):
    """Chunks per topic that pass the filter when missing values fail it."""
    return V.chunk_table(spark, sf_dir).where(_FILTER.condition()).groupBy("topic").agg(F.count("*").alias("chunks"))


def filter_nulls_keyword(spark, sf_dir):
    """Chunks per topic that pass the filter when missing values pass it."""
    return V.chunk_table(spark, sf_dir).where(_FILTER.condition(null_passes=True)).groupBy("topic").agg(F.count("*").alias("chunks"))


def request_filter_map(spark, sf_dir):
    """Requests turned into filter columns; empty lists become no condition."""
    i = F.col("item_id")
    none = F.array().cast("array<string>")
    req = V.table(spark, sf_dir, "benchmark").select(
        i.cast("string").alias("query_id"), F.col("text").alias("question"),
        F.when(i % 2 == 0, F.array(V.pick(K.TOPICS, i))).otherwise(none).alias("cancer_types"),
        F.when(i % 3 == 0, F.array(F.lit("results"))).otherwise(none).alias("sections"),
        none.alias("study_designs"), none.alias("chunk_types"),
        F.when(i % 4 == 0, F.lit(2010)).alias("year_from"), F.lit(None).cast("int").alias("year_to"),
        F.lit(None).cast("int").alias("evidence_level_max"))
    f = request_filters(req)
    return f.select("query_id", F.array_join("f_cancer_type", ",").alias("f_cancer_type"),
                    F.array_join("f_section", ",").alias("f_section"), F.col("f_study_design").isNull().alias("no_design"),
                    F.col("f_year_min").cast("bigint").alias("f_year_min"))


# --- fusion and reranking -----------------------------------------------------------

def _run(spark, sf_dir, **options):
    return retrieve(V.questions(spark, sf_dir), V.chunk_table(spark, sf_dir), V.vectors(spark, sf_dir), None,
                    NOW_YEAR, **options)


def rrf_fusion(spark, sf_dir):
    """Fused candidates of every question."""
    f = _run(spark, sf_dir).fused
    return _ints(f.select("query_id", "chunk_id", "dense_rank", "keyword_rank", F.round("score", 9).alias("score"), "rank"),
                 "dense_rank", "keyword_rank", "rank")


def diversity_cap(spark, sf_dir):
    """Candidates per question and design after the cap on reviews."""
    f = _run(spark, sf_dir).fused.join(V.chunk_table(spark, sf_dir).select("chunk_id", "study_design"), "chunk_id")
    return fusion.cap_designs(f).groupBy("query_id", "study_design").agg(
        F.count("*").alias("n"), F.max("rank").cast("bigint").alias("last_rank"))


def hybrid_retrieve(spark, sf_dir):
    """Graded chunks of every question with relevance and weighted score."""
    r = _run(spark, sf_dir).ranked
    return _ints(r.select("query_id", "rank", "chunk_id", F.round("relevance_score", 10).alias("relevance_score"),
                          F.round("final_score", 10).alias("final_score"), F.md5("text").alias("text_md5")), "rank")


def retrieval_confidence(spark, sf_dir):
    """Summary per question: confidence, candidates, chunks."""
    s = _run(spark, sf_dir).summary
    return s.select("query_id", F.round("retrieval_confidence", 10).alias("retrieval_confidence"), "num_chunks", "num_candidates")


def fallback_union(spark, sf_dir):
    """Questions without a graded chunk answered from external abstracts.

    Every document is evidence, dealt over the questions, in id order, of which a
    question keeps the operator's top. Documents whose id is divisible by seven
    stand for records without an abstract, which the operator drops.
    """
    from pyspark.sql import Window

    asked = V.table(spark, sf_dir, "benchmark").select("item_id").distinct()
    slots = asked.select("item_id", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("bigint").alias("slot"))
    i = F.col("doc_id")
    docs = V.table(spark, sf_dir, "documents").where((i % 7 != 0) & (F.coalesce("text", F.lit("")) != "")).withColumn(
        "slot", F.pmod(i, F.lit(max(asked.count(), 1)))).join(slots, "slot").select(
        F.col("item_id").cast("string").alias("query_id"), i.alias("pmid"), F.col("source").alias("title"),
        F.col("text").alias("abstract"), (i % 20 + 2000).cast("string").alias("year"))
    # The last id that a question keeps is found on ids alone; only texts up to it are ranked.
    last = top_ranked(docs.select("query_id", "pmid"), K.TOP_K_RERANK, F.lit(0), "query_id", "pmid").groupBy("query_id").agg(F.max("pmid").alias("_last"))
    near = join_small(docs, store(last, "fallback-last"), ["query_id"]).where(F.col("pmid") <= F.col("_last")).drop("_last")
    ext = top_ranked(near, K.TOP_K_RERANK, F.lit(0), "query_id", "pmid")
    r = _run(spark, sf_dir, external=external_evidence(ext), floor=0.9).ranked
    return r.groupBy("query_id", "used_fallback").agg(
        F.count("*").alias("n"), F.round(F.avg("relevance_score"), 10).alias("mean_relevance"),
        F.md5(F.min("chunk_id")).alias("first_md5"))


def rerank_weights(spark, sf_dir):
    """Design and recency weights and the weighted score of every paper at relevance 0.8."""
    d, y = F.col("study_design"), F.col("year")
    p = V.papers(spark, sf_dir)
    return p.select(
        "paper_key", scores.design_weight(d).alias("design_weight"), scores.recency_weight(y, NOW_YEAR).alias("recency_weight"),
        scores.trial_boost(d, y, NOW_YEAR).alias("trial_boost"),
        F.round(scores.final_score(F.lit(0.8), d, y, NOW_YEAR), 9).alias("final_score"))


def answer_confidence_scores(spark, sf_dir):
    """Confidence of every question from its graded chunks."""
    q = V.questions(spark, sf_dir).select("query_id", F.col("f_cancer_type").alias("query_topics"))
    conf = answer_confidence(q, _run(spark, sf_dir).ranked)
    return conf.withColumn("score", F.round("score", 10)).drop("n_chunks")


def evidence_confidence(spark, sf_dir):
    """Confidence of every answered conversation turn, topic check included."""
    q = V.answered(spark, sf_dir).select("query_id", F.array("cancer_type").alias("query_topics"))
    return answer_confidence(q, V.evidence(spark, sf_dir)).withColumn("score", F.round("score", 10)).drop("n_chunks")


def gate_counts(spark, sf_dir):
    """Conversation turns per gate decision."""
    q = V.answered(spark, sf_dir).select("query_id")
    return answer_confidence(q, V.evidence(spark, sf_dir)).groupBy("gate", "evidence_quality").agg(F.count("*").alias("n"))


def weak_suppressed(spark, sf_dir):
    """Chunks kept per turn when weak retrievals are emptied."""
    ev = V.evidence(spark, sf_dir).groupBy("query_id").agg(
        F.avg(F.col("relevance_score") - 0.4).alias("retrieval_confidence"), F.collect_list("rank").alias("chunks"))
    return suppress_weak(ev).select("query_id", F.size("chunks").cast("bigint").alias("kept"))


# --- context and sources -----------------------------------------------------------

def _ranked_docs(spark, sf_dir):
    """Papers of one journal and topic in key order as the ranked chunks of one prompt, whole texts."""
    from pyspark.sql import Window

    p = V.papers(spark, sf_dir)
    order = Window.partitionBy("query_id").orderBy("doc_id")
    return p.withColumn("query_id", F.concat_ws("/", "journal", "topic")).withColumn(
        "rank", F.row_number().over(order)).join(V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole")), "doc_id").select(
        "query_id", "rank", F.col("paper_key").alias("chunk_id"), F.col("whole").alias("text"), "title", "year",
        F.lit("abstract").alias("section"), "study_design", "sample_size", "authors", "journal", "pmid")


def context_budget(spark, sf_dir):
    """Prompt context of every group within 8000 characters."""
    out = context.fit_budget(context.context_blocks(_ranked_docs(spark, sf_dir)))
    return out.select("query_id", F.length("context").cast("bigint").alias("n_chars"), "n_blocks", F.md5("context").alias("context_md5"))


def context_budget_card(spark, sf_dir):
    """The same in the card layout and a budget of 3000 characters."""
    out = context.fit_budget(context.context_blocks(_ranked_docs(spark, sf_dir), "card"), 3000)
    return out.select("query_id", F.length("context").cast("bigint").alias("n_chars"), "n_blocks", F.md5("context").alias("context_md5"))


def grounded_sources(spark, sf_dir):
    """Source line of every ranked paper from metadata alone."""
    r = _ranked_docs(spark, sf_dir)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), C.source_line(
        F.col("rank"), F.col("authors"), F.col("year"), F.when(F.col("rank") % 5 != 0, F.col("journal")).otherwise(""),
        F.col("title"), F.col("study_design"), F.col("sample_size")).alias("line"))


def source_details(spark, sf_dir):
    """Ten-field source record of every ranked paper."""
    r = _ranked_docs(spark, sf_dir)
    d = r.select("query_id", C.source_detail(F.struct(*r.columns), 150).alias("d")).select("query_id", "d.*")
    return _ints(d, "year", "sample_size")


QUERIES = {f.__name__: f for f in (
    keyword_index_df, keyword_doc_stats, keyword_topk, keyword_topk_index, keyword_topk_stored, chunk_paper_join, keyword_matches, keyword_topk_filtered,
    keyword_topk_filtered_index, embedding_cosine,
    dense_topk, dense_topk_filtered, dense_topk_blocks, filter_nulls_dense, filter_nulls_keyword, request_filter_map,
    rrf_fusion, diversity_cap, hybrid_retrieve, retrieval_confidence, fallback_union, rerank_weights,
    answer_confidence_scores, evidence_confidence, gate_counts, weak_suppressed, context_budget, context_budget_card,
    grounded_sources, source_details)}
#: The name under which all documents were evidence first.
QUERIES["fallback_union_all"] = fallback_union

_CENTER = """
dim_v AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
center_v AS (SELECT label, list(m ORDER BY i) AS c FROM dim_v GROUP BY label)"""
_NEAREST = """
SELECT CAST(q.label AS VARCHAR) AS query_id, CAST(e.vec_id AS VARCHAR) AS chunk_id,
       round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.c), 9) AS score,
       row_number() OVER (PARTITION BY q.label ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.c), 9) DESC, CAST(e.vec_id AS VARCHAR)) AS rank
FROM embeddings e CROSS JOIN center_v q WHERE {0} QUALIFY rank <= 20"""
_PASS = ("topic IN ('prostate', 'kidney') AND study_design IN ('rct', 'cohort', 'review') AND {0} AND evidence_level <= 4")


def _conf(topic_test: str, source: str, queries: str) -> str:
    return f"""
conf_a AS (SELECT query_id, count(*) AS n, avg(CASE WHEN rank <= 3 THEN relevance_score END) AS base, bool_or(evidence_level <= 2) AS strong,
                  bool_and(evidence_level >= 5) AS weak, count(DISTINCT pmcid) AS papers, stddev_pop(relevance_score) AS spread,
                  list(DISTINCT topic) AS topics FROM {source} GROUP BY query_id),
conf_b AS (SELECT q.query_id, n, base, strong AS r1, NOT strong AND weak AS r2, papers = 1 AND n > 1 AS r3, spread > 0.3 AS r4, {topic_test} AS r5
           FROM {queries} q LEFT JOIN conf_a USING (query_id)),
conf_c AS (SELECT *, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE greatest(0, least(1, base + CASE WHEN r1 THEN 0.1 ELSE 0 END - CASE WHEN r2 THEN 0.1 ELSE 0 END
             - CASE WHEN r3 THEN 0.1 ELSE 0 END - CASE WHEN r4 THEN 0.05 ELSE 0 END - CASE WHEN r5 THEN 0.1 ELSE 0 END)) END AS score FROM conf_b),
conf_v AS (SELECT query_id, score, score >= 0.45 AS sufficient, CASE WHEN n IS NULL THEN 'no_chunks' ELSE coalesce(nullif(concat_ws('; ',
             CASE WHEN r1 THEN 'evidence_boost' END, CASE WHEN r2 THEN 'evidence_penalty' END, CASE WHEN r3 THEN 'single_paper_penalty' END,
             CASE WHEN r4 THEN 'spread_penalty' END, CASE WHEN r5 THEN 'topic_mismatch_penalty' END), ''), 'nominal') END AS reason,
             CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'hedged' WHEN score >= 0.2 THEN 'caveated' ELSE 'refused' END AS gate,
             CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'hedged' WHEN score >= 0.2 THEN 'caveated' ELSE 'insufficient' END AS evidence_quality
           FROM conf_c)"""


def _with(base: str, extra: str, body: str) -> str:
    head = sql(base, "").rstrip()
    return (head + ",\n" if head else "WITH ") + extra.strip() + "\n" + body.strip()


_DOCS = """
docs_v AS (SELECT * FROM (SELECT *, journal || '/' || topic AS query_id, row_number() OVER (PARTITION BY journal, topic ORDER BY doc_id) AS rank FROM papers_v)
  JOIN (SELECT doc_id, text AS whole FROM documents) USING (doc_id))"""


def _budget(header: str, limit: int) -> str:
    return _DOCS + f""",
block_v AS (SELECT query_id, rank, {header} || chr(10) || whole AS b FROM docs_v),
run_v AS (SELECT *, sum(length(b) + 2) OVER (PARTITION BY query_id ORDER BY rank) AS t FROM block_v),
cut_v AS (SELECT *, min(CASE WHEN t > {limit} THEN rank END) OVER (PARTITION BY query_id) AS f, {limit} - 2 - (t - length(b) - 2) AS room FROM run_v),
piece_v AS (SELECT query_id, rank, CASE WHEN t <= {limit} THEN b WHEN room > 100 THEN left(b, room::BIGINT) || '…' END AS p
            FROM cut_v WHERE f IS NULL OR rank <= f)"""


_BUDGET_OUT = """
SELECT query_id, length(c) AS n_chars, n AS n_blocks, md5(c) AS context_md5
FROM (SELECT query_id, string_agg(p, chr(10) || chr(10) ORDER BY rank) AS c, count(p) AS n FROM piece_v WHERE p IS NOT NULL GROUP BY query_id)"""
_TOPIC_GRADED = "f_topic IS NOT NULL AND NOT coalesce(list_contains(topics, f_topic), false)"
_GRADED_SRC = "(SELECT *, paper_key AS pmcid FROM graded_v)"
_SUFFIX = ("concat_ws(', ', nullif(study_design, ''), CASE WHEN sample_size <> 0 THEN 'n=' || sample_size END)")

ORACLE = {
    "keyword_index_df": sql("idf_v", "SELECT term, df, round(idf, 9) AS idf FROM idf_v"),
    "keyword_doc_stats": sql("tok_v post_v", """
        SELECT (SELECT count(*) FROM tok_v) AS n_chunks, (SELECT round(avg(dl), 10) FROM tok_v) AS avgdl, count(*) AS postings,
               CAST(sum(tf) AS BIGINT) AS tokens FROM post_v"""),
    "keyword_topk": sql("kw_scored_v", """
        SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM kw_scored_v QUALIFY rank <= 20"""),
    "keyword_matches": sql("kw_scored_v", "SELECT query_id, count(*) AS chunks, round(sum(score), 4) AS total FROM kw_scored_v GROUP BY query_id"),
    "keyword_topk_filtered": sql("kw_v", "SELECT query_id, chunk_id, score, rank FROM kw_v"),
    "embedding_cosine": "WITH " + _CENTER.strip() + """
        SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 10) AS cosine FROM embeddings JOIN center_v USING (label)""",
    "dense_topk": "WITH " + _CENTER.strip() + _NEAREST.format("true"),
    "dense_topk_filtered": "WITH " + _CENTER.strip() + _NEAREST.format("e.label % 2 = 0"),
    "dense_topk_blocks": "WITH " + _CENTER.strip() + _NEAREST.format("true"),
    "filter_nulls_dense": sql("chunks_v", f"SELECT topic, count(*) AS chunks FROM chunks_v WHERE {_PASS.format('year BETWEEN 2012 AND 2022')} GROUP BY topic"),
    "filter_nulls_keyword": sql("chunks_v", f"SELECT topic, count(*) AS chunks FROM chunks_v WHERE {_PASS.format('(year IS NULL OR year BETWEEN 2012 AND 2022)')} GROUP BY topic"),
    "request_filter_map": f"""
        SELECT CAST(item_id AS VARCHAR) AS query_id, CASE WHEN item_id % 2 = 0 THEN {V.sql_pick(K.TOPICS, 'item_id')} END AS f_cancer_type,
               CASE WHEN item_id % 3 = 0 THEN 'results' END AS f_section, true AS no_design,
               (CASE WHEN item_id % 4 = 0 THEN 2010 END)::BIGINT AS f_year_min FROM benchmark""",
    "rrf_fusion": sql("fused_v", "SELECT query_id, chunk_id, dense_rank, keyword_rank, round(score::DOUBLE, 9) AS score, rank FROM fused_v"),
    "diversity_cap": sql("capped_v", "SELECT query_id, study_design, count(*) AS n, max(rank) AS last_rank FROM capped_v GROUP BY ALL"),
    "hybrid_retrieve": sql("graded_v", """
        SELECT query_id, rank, chunk_id, round(relevance_score, 10) AS relevance_score, round(final_score, 10) AS final_score, md5(text) AS text_md5 FROM graded_v"""),
    "retrieval_confidence": sql("graded_v capped_v questions_v", """
        SELECT q.query_id, round(coalesce(c, 0), 10)::DOUBLE AS retrieval_confidence, coalesce(n, 0) AS num_chunks, coalesce(k, 0) AS num_candidates
        FROM questions_v q LEFT JOIN (SELECT query_id, avg(relevance_score) AS c, count(*) AS n FROM graded_v GROUP BY 1) USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS k FROM capped_v GROUP BY 1) USING (query_id)"""),
    "fallback_union": _with("reranked_v questions_v", """
        own AS (SELECT query_id, chunk_id, relevance_score FROM reranked_v WHERE relevance_score >= 0.9),
        slot AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM benchmark)),
        ext AS (SELECT CAST(item_id AS VARCHAR) AS query_id, 'pubmed:' || doc_id AS chunk_id, 0.45::DOUBLE AS relevance_score
                FROM documents JOIN slot ON doc_id % n = slot WHERE doc_id % 7 <> 0 AND text <> ''
                QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id) <= 5)""", """
        SELECT query_id, used_fallback, count(*) AS n, round(avg(relevance_score), 10) AS mean_relevance, md5(min(chunk_id)) AS first_md5
        FROM (SELECT *, false AS used_fallback FROM own UNION ALL SELECT *, true FROM ext WHERE query_id NOT IN (SELECT query_id FROM own)
              AND query_id IN (SELECT query_id FROM questions_v))
        GROUP BY ALL"""),
    "rerank_weights": sql("papers_v", f"""
        SELECT paper_key, dw::DOUBLE AS design_weight, rw::DOUBLE AS recency_weight, tb::DOUBLE AS trial_boost,
               round(pow(0.8, 0.7) * pow(dw, 0.15) * pow(rw * tb, 0.15), 9) AS final_score
        FROM (SELECT *, CASE study_design WHEN 'rct' THEN 0.9 WHEN 'meta_analysis' THEN 1.0 WHEN 'cohort' THEN 0.6 WHEN 'review' THEN 0.3 ELSE 0.5 END AS dw,
                CASE WHEN year IS NULL THEN 0.75 WHEN {NOW_YEAR} - year <= 2 THEN 1.0 WHEN {NOW_YEAR} - year <= 5 THEN 0.9
                     WHEN {NOW_YEAR} - year <= 10 THEN 0.8 WHEN {NOW_YEAR} - year <= 15 THEN 0.7 ELSE 0.6 END AS rw,
                CASE WHEN study_design = 'rct' AND {NOW_YEAR} - year <= 2 THEN 1.1 ELSE 1.0 END AS tb FROM papers_v)"""),
    "answer_confidence_scores": _with("graded_v questions_v", _conf(_TOPIC_GRADED, _GRADED_SRC, "questions_v"),
                                      "SELECT * REPLACE (round(score, 10) AS score) FROM conf_v"),
    "evidence_confidence": _with("ev_v qa_v", _conf("NOT coalesce(list_contains(topics, cancer_type), false)", "ev_v", "qa_v"),
                                 "SELECT * REPLACE (round(score, 10) AS score) FROM conf_v"),
    "gate_counts": _with("ev_v qa_v", _conf("false", "ev_v", "qa_v"), "SELECT gate, evidence_quality, count(*) AS n FROM conf_v GROUP BY ALL"),
    "weak_suppressed": sql("ev_v", """
        SELECT query_id, CASE WHEN avg(relevance_score - 0.4) < 0.2 THEN 0 ELSE count(*) END AS kept FROM ev_v GROUP BY query_id"""),
    "context_budget": _with("papers_v", _budget(
        "concat_ws(' | ', '[Doc ' || rank || ']', title, CASE WHEN year <> 0 THEN CAST(year AS VARCHAR) END, 'abstract', nullif(study_design, ''))", 8000), _BUDGET_OUT),
    "context_budget_card": _with("papers_v", _budget(
        "'[Doc ' || rank || '] ' || title || CASE WHEN year <> 0 THEN ' (' || year || ')' ELSE '' END || CASE WHEN study_design <> '' THEN ' — ' || study_design ELSE '' END"
        " || CASE WHEN sample_size <> 0 THEN ' (n=' || sample_size || ')' ELSE '' END", 3000), _BUDGET_OUT),
    "grounded_sources": _with("papers_v", _DOCS, f"""
        SELECT query_id, rank, '[Doc ' || rank || '] ' || coalesce(nullif(concat_ws(' ', CASE WHEN len(authors) > 0 THEN string_split(authors[1], ' ')[1] || ' et al.' END,
                 CASE WHEN year <> 0 THEN CAST(year AS VARCHAR) END, CASE WHEN rank % 5 <> 0 THEN nullif(journal, '') END), ''), nullif(title, ''), 'Unknown source')
               || CASE WHEN {_SUFFIX} <> '' THEN ' (' || {_SUFFIX} || ')' ELSE '' END AS line FROM docs_v"""),
    "source_details": _with("papers_v", _DOCS, """
        SELECT query_id, paper_key AS chunk_id, coalesce(nullif(title, ''), 'Unknown') AS title,
               array_to_string(authors[1:3], ', ') || CASE WHEN len(authors) > 3 THEN ' et al.' ELSE '' END AS authors, journal, year, study_design,
               sample_size, 'abstract' AS section, left(whole, 150) AS key_finding, pmid FROM docs_v"""),
}
ORACLE["fallback_union_all"] = ORACLE["fallback_union"]
ORACLE["keyword_topk_index"] = ORACLE["keyword_topk_stored"] = ORACLE["keyword_topk"]
ORACLE["chunk_paper_join"] = sql("chunks_v", """
    SELECT journal, section, count(*) AS chunks, count(DISTINCT paper_key) AS papers, max(year)::BIGINT AS latest FROM chunks_v GROUP BY ALL""")
ORACLE["keyword_topk_filtered_index"] = ORACLE["keyword_topk_filtered"]
