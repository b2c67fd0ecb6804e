"""Quality gate, corpus report, statistics, ingestion and merge operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.functions import citations as C
from litspark.functions import text as X
from litspark.functions.records import extraction
from litspark.operators import corpus, filters, merge, quality, report, stats
from litspark.plans.corpus import build_corpus
from litspark.queries import views as V
from litspark.queries.views import WORDS, sql
from litspark.sources import records, tables


def _big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 10) for n in names})


# --- quality -------------------------------------------------------------------

def paper_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, verdict and reasons of every paper."""
    return quality.score_papers(V.papers(spark, sf_dir)).select(
        "paper_key", "score", "passed", F.array_join("reasons", "; ").alias("reasons"))


def rejections_by_reason(spark, sf_dir):
    """Rejected papers per topic and leading word of the reason."""
    rej = quality.rejections(quality.score_papers(V.papers(spark, sf_dir)))
    return rej.select("topic", F.explode("reasons").alias("r")).groupBy(
        "topic", F.regexp_replace("r", r" \(.*", "").alias("reason")).agg(F.count("*").alias("papers"))


def full_text_filter(spark, sf_dir):
    """Papers kept by the full-text filter per topic; single-line papers fall back to the abstract."""
    p = V.legacy_papers(spark, sf_dir)
    body_only = p.withColumn("sections", F.filter("sections", lambda s: s["section_name"] != "Abstract"))
    return filters.full_text_only(body_only).groupBy("topic").agg(
        F.count("*").alias("papers"), F.sum(F.size("sections")).alias("sections"))


# --- report ---------------------------------------------------------------------

def missing_fields(spark, sf_dir):
    return report.missing_fields(V.legacy_papers(spark, sf_dir))


def missing_percent(spark, sf_dir):
    return _rounded(report.missing_fields_long(V.legacy_papers(spark, sf_dir)), "percent")


def section_distribution(spark, sf_dir):
    return report.section_distribution(V.legacy_papers(spark, sf_dir))


def section_coverage(spark, sf_dir):
    df = report.section_coverage(V.legacy_papers(spark, sf_dir))
    return _rounded(df, *[c for c in df.columns if c.endswith("percent") or c == "avg_sections"])


def top_sections(spark, sf_dir):
    return _big(report.top_sections(V.legacy_papers(spark, sf_dir)), "place")


def length_stats(spark, sf_dir):
    df = report.length_stats(V.legacy_papers(spark, sf_dir))
    ints = [c for c in df.columns if c != "topic" and not c.endswith("_avg")]
    return _rounded(_big(df, *ints), "chars_avg", "sections_avg", "abstract_avg")


def problem_papers(spark, sf_dir):
    df = report.problem_papers(V.legacy_papers(spark, sf_dir)).withColumn("issues", F.array_join("issues", "; "))
    return _big(df, "n_issues", "total_text_length", "section_count")


def worst_papers(spark, sf_dir):
    df = report.worst_papers(V.legacy_papers(spark, sf_dir)).select("topic", "pmc_id", "n_issues", "place")
    return _big(df, "n_issues", "place")


def year_distribution(spark, sf_dir):
    return report.year_distribution(V.legacy_papers(spark, sf_dir))


def corpus_grade(spark, sf_dir):
    return _big(report.corpus_grade(V.legacy_papers(spark, sf_dir)), "quality_score")


def corpus_summary(spark, sf_dir):
    return _rounded(report.corpus_summary(report.corpus_grade(V.legacy_papers(spark, sf_dir))), "avg_quality")


# --- statistics -------------------------------------------------------------------

def corpus_stats(spark, sf_dir):
    return stats.corpus_stats(V.papers(spark, sf_dir), V.chunks(spark, sf_dir))


def collection_stats(spark, sf_dir):
    return _big(stats.collection_stats(V.table(spark, sf_dir, "embeddings")), "dense_vector_size")


def processing_stats(spark, sf_dir):
    p = V.legacy_papers(spark, sf_dir)
    return stats.processing_stats(p.select("topic", F.size("sections").alias("num_sections")), corpus.legacy_chunks(p))


def ingest_summary(spark, sf_dir):
    """Counters and cost per topic and in total; labelled documents count as already ingested."""
    p, state = _offered(spark, sf_dir)
    build = build_corpus(p, state, table_cap=V.K.TABLE_WORD_CAP)
    made = build.chunks.withColumn("embedded", F.col("chunk_index") % 10 != 9)
    return _rounded(stats.ingest_summary(build.found, build.new, build.papers, made), "estimated_cost_usd")


def _offered(spark, sf_dir):
    state = V.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("paper_key"))
    return V.papers(spark, sf_dir), state


# --- ingestion ----------------------------------------------------------------------

def incremental_skip(spark, sf_dir):
    """New papers per topic after skipping the known ones."""
    p, state = _offered(spark, sf_dir)
    return corpus.skip_known(p, state).groupBy("topic").agg(F.count("*").alias("new_papers"))


def _found_twice(spark, sf_dir):
    """Papers found again under a second topic."""
    p = V.papers(spark, sf_dir).select("doc_id", "paper_key", "topic")
    again = p.withColumn("topic", V.pick(V.K.TOPICS, F.col("doc_id") * 5 + 1))
    return p.unionByName(again)


def first_topic_wins(spark, sf_dir):
    return corpus.first_topic_wins(_found_twice(spark, sf_dir)).select("paper_key", "topic")


def topic_cap(spark, sf_dir):
    """At most 25 papers per topic, in position order: the search limit itself."""
    p = V.papers(spark, sf_dir).select("doc_id", "paper_key", "topic")
    return corpus.cap_per_topic(p, 25, order="doc_id").select("paper_key", "topic")


def id_harvest(spark, sf_dir):
    """Ids over yearly result pages, repeated ones once at their first position."""
    d = F.col("doc_id")
    p = V.table(spark, sf_dir, "documents").select(
        (2000 + d % 18).alias("window"), d.alias("position"), F.floor(d / 2).alias("id"))
    return corpus.harvest_ids(p)


def metadata_attach(spark, sf_dir):
    """Papers with extraction results attached; papers without a year have none."""
    p = V.papers(spark, sf_dir)
    meta = p.where("year is not null").select(
        "pmid", "study_design", "sample_size", F.concat(F.lit("outcome "), "paper_key").alias("primary_outcome"),
        F.lit(None).cast("string").alias("intervention"), F.lit(None).cast("string").alias("comparator"))
    return _big(corpus.attach_metadata(p, meta).select(
        "paper_key", "study_design", "sample_size", "primary_outcome", F.array_join("cancer_type", ",").alias("cancer_type"),
        "evidence_level"), "sample_size", "evidence_level")


def extraction_work(spark, sf_dir):
    """Papers still to extract: not cached, or without an id."""
    p = V.papers(spark, sf_dir).withColumn("pmid", F.when(F.col("doc_id") % 9 != 0, F.col("pmid")).otherwise(""))
    cache = V.table(spark, sf_dir, "labels").select(F.concat(F.lit("9"), F.col("doc_id").cast("string")).alias("pmid"))
    return corpus.extraction_work(p, cache).select("paper_key", "pmid")


def extraction_normalise(spark, sf_dir):
    """Raw extractor responses of every kind, normalised."""
    d = F.col("doc_id")
    design = V.pick(["rct", "cohort", "RCT", "survey", "review", "unknown"], d)
    size = V.pick(['120', '0', '-5', '"44"', '"many"', 'null'], F.floor(d / 6))
    outcome = V.pick(['"  overall survival "', '"   "', 'null', '"PSA"'], d)
    good = F.concat(F.lit('{"study_design": "'), design, F.lit('", "sample_size": '), size,
                    F.lit(', "primary_outcome": '), outcome, F.lit(', "intervention": "'), F.repeat(F.lit("drug "), (d % 60).cast("int")),
                    F.lit('", "comparator": null}'))
    response = F.when(d % 11 == 0, F.lit("not json {")).when(d % 17 == 0, F.lit(None)).otherwise(good)
    e = V.papers(spark, sf_dir).select("paper_key", extraction(response, F.col("abstract")).alias("e"))
    return _big(e.select("paper_key", "e.*"), "sample_size")


def author_heads(spark, sf_dir):
    """Author line of every paper."""
    return V.papers(spark, sf_dir).select("paper_key", C.author_heads(F.col("authors")).alias("authors"))


# --- keyed writes ----------------------------------------------------------------------

def delete_paper(spark, sf_dir):
    """Chunks left per topic after deleting the papers labelled toxic."""
    doomed = V.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("paper_key"))
    return merge.delete_keys(V.chunks(spark, sf_dir), doomed, "paper_key").groupBy("topic").agg(F.count("*").alias("chunks"))


def upsert_latest(spark, sf_dir):
    """Newest event per user after two loads that overlap."""
    e = V.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    old = e.where("event_type <> 'view'")
    return merge.upsert_latest(old, e.where("event_type <> 'error'"), ["user_id"], "event_id")


def paper_upsert(spark, sf_dir):
    """Papers inserted only when absent: known titles never change."""
    p = V.papers(spark, sf_dir).select("paper_key", "doc_id", "title")
    known = p.join(V.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("paper_key", "title")
    return merge.insert_absent(known, p.select("paper_key", F.upper("title").alias("title")), "paper_key")


def chunk_upsert(spark, sf_dir):
    """Chunk rows after an update that may change only text and section."""
    c = V.chunks(spark, sf_dir).select("chunk_id", "text", "section", "chunk_type", "paper_key")
    old = c.where("section <> 'results'").withColumn("text", F.lit("old"))
    new = c.where("chunk_type = 'text'").withColumn("chunk_type", F.lit("new"))
    return merge.update_columns(old, new, "chunk_id", ["text", "section"]).groupBy("section", "chunk_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("text") == "old").alias("untouched"))


def _entries(spark, sf_dir):
    """Events as reference entries: existing ones are purchases, new ones the rest."""
    e = V.table(spark, sf_dir, "events")
    entry = e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("Drug"), (F.col("user_id") % 40).cast("string")))
        .otherwise(F.concat(F.lit(" drug"), (F.col("user_id") % 60).cast("string"), F.lit(" "))).alias("drug"),
        V.pick(["fda", "EMA"], F.floor(F.col("value"))).alias("jurisdiction"),
        F.when(F.col("event_id") % 19 == 0, F.lit(" ")).otherwise(F.concat(F.lit("w"), F.col("event_id").cast("string"))).alias("warning"),
        F.when(F.col("event_id") % 97 == 0, "manual").otherwise("feed").alias("source"), "event_type")
    return entry.where("event_type = 'purchase'").drop("event_type"), entry.where("event_type <> 'purchase'").drop("event_type")


def merge_protected(spark, sf_dir):
    """Reference table after a merge in which manual entries are never overwritten."""
    return merge.merge_protected(*_entries(spark, sf_dir))


def merge_counts(spark, sf_dir):
    return merge.merge_counts(*_entries(spark, sf_dir))


def enforcement_map(spark, sf_dir):
    """Events and documents as enforcement records, mapped to withdrawal entries."""
    d = F.col("doc_id")
    rec = V.table(spark, sf_dir, "documents").select(
        d.alias("seq"), F.concat(F.lit("DRUG"), (d % 20).cast("string")).alias("drug"),
        F.concat(V.pick(["Bladder kit ", "Syringe ", "For Urothelial use ", "Cream "], d), "text").alias("product_description"),
        F.when(d % 7 != 0, F.concat("source", F.lit(" defect..."))).alias("reason_for_recall"),
        V.pick(["Voluntary: Firm Initiated", "FDA Mandated", "voluntary"], d).alias("voluntary_mandated"),
        V.pick(["Terminated", "Ongoing"], d).alias("status"),
        V.pick(["20210305", "2022-11-09", "bad", "20219999"], F.floor(d / 4)).alias("recall_initiation_date"))
    return records.enforcement_entries(rec).select(
        "seq", "drug", "status", "date", "warning", F.md5("raw_description").alias("description_md5"))


def _eav(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    meta = e.select(
        F.col("event_id").alias("id"),
        F.explode(F.array(
            F.struct(F.lit("pmc_id").alias("key"), F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("string_value"), F.lit(None).cast("bigint").alias("int_value"), F.lit(None).cast("double").alias("float_value")),
            F.struct(F.lit("topic").alias("key"), F.when(F.col("user_id") % 4 != 0, F.col("event_type")).otherwise("").alias("string_value"), F.lit(None).cast("bigint").alias("int_value"), F.lit(None).cast("double").alias("float_value")),
            F.struct(F.lit("year").alias("key"), F.lit("").alias("string_value"), (F.col("event_id") % 30 + 1995).alias("int_value"), F.lit(None).cast("double").alias("float_value")),
            F.struct(F.lit("chunk_index").alias("key"), F.get_json_object("props", "$.k").alias("string_value"), F.lit(None).cast("bigint").alias("int_value"), F.lit(None).cast("double").alias("float_value")),
            F.struct(F.lit("title").alias("key"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("string_value"), F.lit(None).cast("bigint").alias("int_value"), F.lit(None).cast("double").alias("float_value")),
            F.struct(F.lit("chroma:document").alias("key"), F.concat(F.lit("doc "), "props").alias("string_value"), F.lit(None).cast("bigint").alias("int_value"), F.lit(None).cast("double").alias("float_value")),
        )).alias("m")).select("id", "m.*")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("embedding_id")), meta


def eav_pivot(spark, sf_dir):
    """Key-value rows regrouped to one wide row per id."""
    return records.eav_pivot(*_eav(spark, sf_dir), ["pmc_id", "topic", "year", "chunk_index", "title"])


def payload_map(spark, sf_dir):
    """Wide rows mapped to the current chunk layout, with the embedding text."""
    wide = records.eav_pivot(*_eav(spark, sf_dir), records.LEGACY_KEYS)
    cur = records.current_payload(wide, 2000)
    return _big(cur.select(
        "chunk_id", "text", "pmcid", "title", "year", "topic", F.array_join("cancer_type", ",").alias("cancer_type"),
        "chunk_index", "total_chunks", "evidence_level", "study_design",
        X.embedding_text(F.col("text"), F.col("title"), F.col("section")).alias("embed_text")),
        "year", "chunk_index", "total_chunks", "evidence_level")


def _golden(spark, sf_dir):
    """Benchmark items and questions of conversations as golden entries of both generations."""
    i = F.col("item_id")
    none = F.lit(None)
    return V.table(spark, sf_dir, "benchmark").select(
        i.alias("seq"), F.when(i % 4 != 3, F.format_string("G%03d", i)).alias("id"),
        F.when(i % 2 == 0, F.col("text")).when(i % 3 == 0, "").alias("query"),
        F.when(i % 2 == 1, F.col("text")).alias("question"),
        F.when(i % 2 == 0, V.pick(V.K.TOPICS, i)).alias("cancer_type"),
        V.pick(V.K.TOPICS, i + 1).alias("topic"), F.when(i % 3 == 0, "hard").alias("difficulty"),
        none.cast("string").alias("question_type"), none.cast("array<string>").alias("expected_study_designs"),
        F.when(i % 2 == 0, F.array(F.lit("tion"))).alias("must_contain_terms"), none.cast("boolean").alias("must_not_hallucinate"),
        none.cast("string").alias("ground_truth"), none.cast("array<string>").alias("expected_sources"), none.cast("string").alias("notes"))


def golden_load(spark, sf_dir):
    g = tables.golden_queries(_golden(spark, sf_dir))
    return g.select("id", "query", "cancer_type", "difficulty", "question_type", "must_not_hallucinate", "ground_truth",
                    F.array_join("must_contain_terms", ",").alias("must_contain_terms"))


def golden_append(spark, sf_dir):
    """Golden set after appending the entries that have no id yet."""
    items = _golden(spark, sf_dir).withColumn("query", F.coalesce("query", "question"))
    have = items.where("id is not null").select("id", "query", "seq")
    fresh = items.where("id is null").select("id", "query", "seq")
    return tables.append_golden(have, fresh, bucket=7).select("id", "query")


def quick_sample(spark, sf_dir):
    """The ten-query quick evaluation sample."""
    g = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"))
    return tables.quick_sample(g, 10, seed=7)


def point_scan(spark, sf_dir):
    """Full scan of points without vectors, with id and text fallbacks."""
    p = V.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("c"), F.col("vec_id").cast("string"))).alias("chunk_id"),
        F.when(F.col("label") != 1, F.col("label").cast("string")).alias("text"), "embedding", "label")
    return _big(tables.scan_points(p), "label")


def chunk_lookup(spark, sf_dir):
    """Batch lookup of the first chunk of every benchmark id, missing ones null."""
    ids = V.table(spark, sf_dir, "benchmark").select(
        F.concat(F.col("item_id").cast("string"), F.lit("_abstract_0")).alias("chunk_id"))
    c = V.chunks(spark, sf_dir).select("chunk_id", "paper_key", F.md5("text").alias("text_md5"))
    return tables.chunks_by_ids(c, ids)


QUERIES = {f.__name__: f for f in (
    paper_quality, rejections_by_reason, full_text_filter, missing_fields, missing_percent, section_distribution,
    section_coverage, top_sections, length_stats, problem_papers, worst_papers, year_distribution, corpus_grade,
    corpus_summary, corpus_stats, collection_stats, processing_stats, ingest_summary, incremental_skip,
    first_topic_wins, topic_cap, id_harvest, metadata_attach, extraction_work, extraction_normalise, author_heads,
    delete_paper, upsert_latest, paper_upsert, chunk_upsert, merge_protected, merge_counts, enforcement_map,
    eav_pivot, payload_map, golden_load, golden_append, quick_sample, point_scan, chunk_lookup)}

_NW = "len(" + WORDS + ")"
_SCORED = f"""
scored_v AS (
  SELECT *, round((CASE WHEN trim(abstract) <> '' THEN 3 ELSE 0 END + CASE WHEN aw >= 50 THEN 2 ELSE 0 END
             + CASE WHEN bw >= 300 THEN 7 ELSE 0 END + CASE WHEN found THEN 6 ELSE 0 END
             + CASE WHEN nl >= 2 THEN 2 ELSE 0 END) / 20.0::DOUBLE, 4) AS score
  FROM (SELECT p.*, {_NW.format('abstract')} AS aw, coalesce(s.bw, 0) AS bw, coalesce(s.nl, 0) AS nl, coalesce(s.found, false) AS found
        FROM papers_v p LEFT JOIN (
          SELECT doc_id, CAST(sum({_NW.format('content')}) AS BIGINT) AS bw, count(DISTINCT CASE WHEN name <> 'other' THEN name END) AS nl,
                 bool_or(name IN ('results', 'discussion', 'conclusion')) AS found
          FROM kept_v WHERE name <> 'abstract' GROUP BY doc_id) s USING (doc_id))),
verdict_v AS (SELECT *, found AND score >= 0.5 AS passed, list_filter([
    CASE WHEN trim(abstract) = '' THEN 'Abstract missing' END,
    CASE WHEN aw < 50 THEN 'Abstract too short (' || aw || ' words, min 50)' END,
    CASE WHEN bw < 300 THEN 'Body content too short (' || bw || ' words, min 300)' END,
    CASE WHEN NOT found THEN 'No results, discussion, or conclusion section found' END,
    CASE WHEN nl < 2 THEN 'Too few distinct body sections (' || nl || ', min 2)' END], lambda x: x IS NOT NULL) AS reasons FROM scored_v)
"""


def _with(base: str, extra: str, body: str) -> str:
    head = sql(base, "").rstrip()
    return (head + ",\n" if head else "WITH ") + extra.strip() + "\n" + body.strip()


_MISSING = """
SELECT topic, count(*) AS papers, count(*) FILTER (title = '' OR title = 'No title') AS missing_title,
       count(*) FILTER (abstract = '') AS missing_abstract, count(*) FILTER (n_sections = 0) AS missing_sections,
       count(*) FILTER (len(authors) = 0) AS missing_authors, count(*) FILTER (year = '') AS missing_year,
       count(*) FILTER (journal = '') AS missing_journal, count(*) FILTER (pmc_id = '') AS missing_pmc_id,
       count(*) FILTER (pmid = '') AS missing_pmid
FROM body_v GROUP BY topic"""
_HEAD = "SELECT topic, raw_name AS section_name FROM kept_v JOIN legacy_v USING (doc_id)"
_GRADE = """
grade_v AS (
  SELECT topic, count(*) AS total_papers, count(*) FILTER (len(issues) > 0) AS problematic_count,
         greatest(100 - CASE WHEN count(*) FILTER (title = '' OR title = 'No title') > 0 THEN 20 ELSE 0 END
           - CASE WHEN count(*) FILTER (abstract = '') > count(*) * 0.1 THEN 15 ELSE 0 END
           - CASE WHEN count(*) FILTER (n_sections = 0) > 0 THEN 20 ELSE 0 END
           - CASE WHEN count(*) FILTER (len(issues) > 0) > count(*) * 0.3 THEN 15 ELSE 0 END
           - CASE WHEN avg(chars) < 10000 THEN 10 ELSE 0 END, 0) AS quality_score
  FROM issues_v GROUP BY topic)"""
_LEGACY_N = """
chunk_n AS (
  SELECT doc_id, CAST(sum(CASE WHEN n <= 200 THEN 1 ELSE (n - 1) // 170 + 1 END) AS BIGINT) AS chunks,
         CAST(sum(CASE WHEN n <= 200 THEN n ELSE (SELECT sum(least(200, n - k)) FROM (SELECT unnest(range(0, n, 170)) AS k)) END) AS BIGINT) AS words
  FROM (SELECT doc_id, len(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'),
               '[^\\p{L}\\p{N}_ .,;:\\-()\\[\\]'']', '', 'g')), '\\s+'), lambda x: x <> '')) AS n FROM kept_v) GROUP BY doc_id)"""
_INGEST = f"""
state_v AS (SELECT DISTINCT doc_id, true AS seen FROM labels),
made_v AS (SELECT c.*, chunk_index % 10 <> 9 AS embedded,
                  {_NW.format("(CASE WHEN title <> '' OR section <> '' THEN title || ' | ' || section || chr(10) || text ELSE text END)")} AS nw
           FROM chunks_v c JOIN (SELECT doc_id FROM verdict_v WHERE passed) USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM state_v)),
topic_v AS (
  SELECT topic, count(*) FILTER (seen IS NULL AND passed) AS pf, count(*) FILTER (seen) AS ps
  FROM verdict_v LEFT JOIN state_v USING (doc_id) GROUP BY topic),
made_t AS (SELECT topic, count(*) AS cp, count(*) FILTER (embedded) AS ce, sum(CASE WHEN embedded THEN nw END) AS w FROM made_v GROUP BY topic)
"""
_ENTRY = f"""
entry_v AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'Drug' || (user_id % 40) ELSE ' drug' || (user_id % 60) || ' ' END AS drug,
         {V.sql_pick(['fda', 'EMA'], 'CAST(floor(value) AS BIGINT)')} AS jurisdiction,
         CASE WHEN event_id % 19 = 0 THEN ' ' ELSE 'w' || event_id END AS warning,
         CASE WHEN event_id % 97 = 0 THEN 'manual' ELSE 'feed' END AS source, event_type
  FROM events),
ex_v AS (SELECT * EXCLUDE (n) FROM (
  SELECT *, lower(drug) AS d, upper(jurisdiction) AS j, 0 AS side, row_number() OVER (PARTITION BY lower(drug), upper(jurisdiction) ORDER BY seq DESC) AS n
  FROM entry_v WHERE event_type = 'purchase') WHERE n = 1),
all_v AS (SELECT * FROM ex_v UNION ALL
  SELECT *, lower(trim(drug)) AS d, upper(trim(jurisdiction)) AS j, 1 AS side FROM entry_v
  WHERE event_type <> 'purchase' AND trim(drug) <> '' AND trim(warning) <> ''),
pos_v AS (SELECT *, row_number() OVER (PARTITION BY d, j ORDER BY side, seq) AS p FROM all_v),
mark_v AS (SELECT *, min(CASE WHEN source = 'manual' THEN p END) OVER (PARTITION BY d, j) AS m, max(p) OVER (PARTITION BY d, j) AS z FROM pos_v)
"""
_ENF = f"""
SELECT doc_id AS seq, 'drug' || (doc_id % 20) AS drug, CASE WHEN doc_id % 2 = 0 THEN 'withdrawn' ELSE 'recalled' END AS status, date,
       'Drug' || (doc_id % 20) || ' — FDA voluntary action (' || date || '): ' || regexp_replace(left(reason, 200), '\\.+$', '')
         || '. Verify current regulatory status before recommending.' AS warning, md5(left(product, 300)) AS description_md5
FROM (SELECT doc_id, {V.sql_pick(["Bladder kit ", "Syringe ", "For Urothelial use ", "Cream "], 'doc_id')} || text AS product,
             CASE WHEN doc_id % 7 <> 0 THEN source || ' defect...' ELSE 'No reason provided' END AS reason,
             CASE WHEN doc_id % 7 <> 0 THEN source || ' defect...' ELSE '' END AS reason_text,
             {V.sql_pick(["Voluntary: Firm Initiated", "FDA Mandated", "voluntary"], 'doc_id')} AS vm,
             {V.sql_pick(["2021-03", "2022-11", "bad", "2021999"], 'doc_id // 4')} AS date
      FROM documents)
WHERE contains(lower(vm), 'voluntary') AND ({' OR '.join(f"contains(lower(product || ' ' || reason_text), '{k}')" for k in V.K.ONCOLOGY_KEYWORDS)})"""
_GOLD = f"""
SELECT item_id AS seq, CASE WHEN item_id % 4 <> 3 THEN printf('G%03d', item_id) END AS id,
       CASE WHEN item_id % 2 = 0 THEN text WHEN item_id % 3 = 0 THEN '' END AS query, CASE WHEN item_id % 2 = 1 THEN text END AS question,
       CASE WHEN item_id % 2 = 0 THEN {V.sql_pick(V.K.TOPICS, 'item_id')} END AS cancer_type, {V.sql_pick(V.K.TOPICS, 'item_id + 1')} AS topic,
       CASE WHEN item_id % 3 = 0 THEN 'hard' ELSE 'medium' END AS difficulty
FROM benchmark"""
_DESIGN = V.sql_pick(["rct", "cohort", "RCT", "survey", "review", "unknown"], "doc_id")
_BAD = "(doc_id % 11 = 0 OR doc_id % 17 = 0 OR trim(abstract) = '')"

ORACLE = {
    "paper_quality": _with("papers_v kept_v", _SCORED,
                           "SELECT paper_key, score, passed, array_to_string(reasons, '; ') AS reasons FROM verdict_v"),
    "rejections_by_reason": _with("papers_v kept_v", _SCORED, r"""
        SELECT topic, regexp_replace(r, ' \(.*', '') AS reason, count(*) AS papers
        FROM (SELECT topic, unnest(reasons) AS r FROM verdict_v WHERE NOT passed) GROUP BY ALL"""),
    "full_text_filter": sql("legacy_v kept_v", """
        SELECT topic, count(*) AS papers, CAST(sum(n) AS BIGINT) AS sections
        FROM legacy_v JOIN (SELECT doc_id, count(*) AS n FROM kept_v WHERE raw_name <> 'Abstract' GROUP BY doc_id) USING (doc_id)
        WHERE n > 1 GROUP BY topic"""),
    "missing_fields": sql("body_v", _MISSING),
    "missing_percent": sql("body_v", f"""
        SELECT topic, replace(field, 'missing_', '') AS field, missing, round(missing / papers * 100, 10) AS percent
        FROM (UNPIVOT ({_MISSING}) ON COLUMNS('missing_.*') INTO NAME field VALUE missing)"""),
    "section_distribution": sql("kept_v legacy_v", f"SELECT topic, section_name, count(*) AS n FROM ({_HEAD}) GROUP BY ALL"),
    "section_coverage": sql("body_v", f"""
        SELECT topic, papers, round(avg_sections, 10) AS avg_sections, coalesce(u, 0) AS unique_sections,
               {', '.join(f"round(coalesce(c{i}, 0) / papers * 100, 10) AS {p}_percent" for i, p in enumerate(['introduction', 'method', 'result', 'discussion']))}
        FROM (SELECT topic, count(*) AS papers, avg(n_sections) AS avg_sections FROM body_v GROUP BY topic)
        LEFT JOIN (SELECT topic, count(DISTINCT section_name) AS u,
                   {', '.join(f"count(*) FILTER (contains(lower(section_name), '{p}')) AS c{i}" for i, p in enumerate(['introduction', 'method', 'result', 'discussion']))}
                   FROM ({_HEAD}) GROUP BY topic) USING (topic)"""),
    "top_sections": sql("kept_v legacy_v", f"""
        SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, section_name) AS place
        FROM (SELECT topic, section_name, count(*) AS n FROM ({_HEAD}) GROUP BY ALL) QUALIFY place <= 10"""),
    "length_stats": sql("body_v", """
        SELECT topic, round(avg(chars), 10) AS chars_avg, min(chars) AS chars_min, max(chars) AS chars_max,
               list(chars ORDER BY chars)[count(*) // 2 + 1] AS chars_median,
               round(avg(n_sections), 10) AS sections_avg, min(n_sections) AS sections_min, max(n_sections) AS sections_max,
               round(avg(length(abstract)), 10) AS abstract_avg, min(length(abstract)) AS abstract_min, max(length(abstract)) AS abstract_max
        FROM body_v GROUP BY topic"""),
    "problem_papers": sql("issues_v", """
        SELECT topic, pmc_id, pmid, CASE WHEN length(title) > 60 THEN left(title, 60) || '...' ELSE title END AS title,
               array_to_string(issues, '; ') AS issues, len(issues) AS n_issues, chars AS total_text_length, n_sections AS section_count
        FROM issues_v WHERE len(issues) > 0"""),
    "worst_papers": sql("issues_v", """
        SELECT topic, pmc_id, len(issues) AS n_issues, row_number() OVER (PARTITION BY topic ORDER BY len(issues) DESC, pmc_id) AS place
        FROM issues_v WHERE len(issues) > 0 QUALIFY place <= 10"""),
    "year_distribution": sql("legacy_v", r"""
        SELECT topic, CASE WHEN regexp_full_match(year, '[0-9]+') THEN year END AS year, count(*) AS papers FROM legacy_v GROUP BY ALL"""),
    "corpus_grade": _with("issues_v", _GRADE, """
        SELECT topic, total_papers, problematic_count, quality_score::BIGINT AS quality_score,
               CASE WHEN quality_score >= 90 THEN 'A (Excellent)' WHEN quality_score >= 80 THEN 'B (Good)' WHEN quality_score >= 70 THEN 'C (Acceptable)'
                    WHEN quality_score >= 60 THEN 'D (Needs Improvement)' ELSE 'F (Poor)' END AS grade FROM grade_v"""),
    "corpus_summary": _with("issues_v", _GRADE, """
        SELECT CAST(sum(total_papers) AS BIGINT) AS total_papers, round(avg(quality_score), 10) AS avg_quality FROM grade_v"""),
    "corpus_stats": sql("papers_v chunks_v", """
        SELECT 'papers' AS facet, NULL::VARCHAR AS value, count(*) AS n FROM papers_v
        UNION ALL SELECT 'chunks', NULL, count(*) FROM chunks_v
        UNION ALL SELECT 'topic', topic, count(*) FROM papers_v WHERE topic IS NOT NULL GROUP BY topic
        UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM papers_v WHERE year IS NOT NULL GROUP BY year
        UNION ALL SELECT 'study_design', study_design, count(*) FROM papers_v WHERE study_design IS NOT NULL GROUP BY study_design"""),
    "collection_stats": "SELECT count(*) AS point_count, max(len(embedding)) AS dense_vector_size FROM embeddings",
    "processing_stats": _with("body_v kept_v", _LEGACY_N, """
        SELECT topic, count(*) AS papers, CAST(sum(n_sections) AS BIGINT) AS sections, CAST(sum(coalesce(chunks, 0)) AS BIGINT) AS chunks,
               round(sum(n_sections) / count(*), 1) AS avg_sections_per_paper, round(sum(chunks) / count(*), 1) AS avg_chunks_per_paper,
               round(sum(words) / sum(chunks), 1) AS avg_chunk_length
        FROM body_v LEFT JOIN chunk_n USING (doc_id) GROUP BY ROLLUP (topic)"""),
    "ingest_summary": _with("chunks_v papers_v kept_v", _SCORED.rstrip() + "," + _INGEST, """
        SELECT topic, CAST(sum(pf) AS BIGINT) AS papers_fetched, CAST(sum(ps) AS BIGINT) AS papers_skipped,
               CAST(sum(coalesce(cp, 0)) AS BIGINT) AS chunks_produced, CAST(sum(coalesce(ce, 0)) AS BIGINT) AS chunks_embedded,
               round(sum(coalesce(w, 0)) * 1.3::DOUBLE / 1000 * 0.00002::DOUBLE, 10) AS estimated_cost_usd
        FROM topic_v LEFT JOIN made_t USING (topic) GROUP BY ROLLUP (topic)"""),
    "incremental_skip": sql("papers_v", "SELECT topic, count(*) AS new_papers FROM papers_v WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY topic"),
    "first_topic_wins": sql("papers_v", f"""
        SELECT paper_key, arg_min(topic, list_position({V.sql_list(V.K.TOPICS)}, topic)) AS topic
        FROM (SELECT paper_key, topic FROM papers_v UNION ALL SELECT paper_key, {V.sql_pick(V.K.TOPICS, 'doc_id * 5 + 1')} FROM papers_v)
        GROUP BY paper_key"""),
    "topic_cap": sql("papers_v", "SELECT paper_key, topic FROM papers_v QUALIFY row_number() OVER (PARTITION BY topic ORDER BY doc_id) <= 25"),
    "id_harvest": """
        SELECT 'PMC' || id AS pmc_id, "window", position
        FROM (SELECT 2000 + doc_id % 18 AS "window", doc_id AS position, doc_id // 2 AS id FROM documents)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY "window", position) = 1""",
    "metadata_attach": sql("papers_v", f"""
        SELECT paper_key, CASE WHEN year IS NOT NULL THEN study_design ELSE 'unknown' END AS study_design,
               CASE WHEN year IS NOT NULL THEN sample_size END AS sample_size, CASE WHEN year IS NOT NULL THEN 'outcome ' || paper_key END AS primary_outcome,
               topic AS cancer_type, (CASE WHEN year IS NOT NULL THEN evidence_level ELSE 6 END)::BIGINT AS evidence_level FROM papers_v"""),
    "extraction_work": sql("papers_v", """
        SELECT paper_key, CASE WHEN doc_id % 9 <> 0 THEN pmid ELSE '' END AS pmid FROM papers_v
        WHERE doc_id % 9 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels)"""),
    "extraction_normalise": sql("papers_v", f"""
        SELECT paper_key, CASE WHEN NOT {_BAD} AND {_DESIGN} IN ('rct', 'cohort', 'review') THEN {_DESIGN} ELSE 'unknown' END AS study_design,
               (CASE WHEN NOT {_BAD} THEN [120, NULL, NULL, 44, NULL, NULL][(doc_id // 6) % 6 + 1] END)::BIGINT AS sample_size,
               CASE WHEN NOT {_BAD} THEN ['overall survival', NULL, NULL, 'PSA'][doc_id % 4 + 1] END AS primary_outcome,
               CASE WHEN NOT {_BAD} AND doc_id % 60 > 0 THEN left(trim(repeat('drug ', CAST(doc_id % 60 AS BIGINT))), 200) END AS intervention,
               NULL::VARCHAR AS comparator, {_BAD} AS extraction_failed FROM papers_v"""),
    "author_heads": sql("papers_v", """
        SELECT paper_key, array_to_string(authors[1:3], ', ') || CASE WHEN len(authors) > 3 THEN ' et al.' ELSE '' END AS authors FROM papers_v"""),
    "delete_paper": sql("chunks_v", """
        SELECT topic, count(*) AS chunks FROM chunks_v WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY topic"""),
    "upsert_latest": """
        SELECT user_id, event_id, event_type, value FROM (
          SELECT *, 0 AS side FROM events WHERE event_type <> 'view' UNION ALL SELECT *, 1 FROM events WHERE event_type <> 'error')
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, side DESC) = 1""",
    "paper_upsert": sql("papers_v", """
        SELECT paper_key, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN title ELSE upper(title) END AS title FROM papers_v"""),
    "chunk_upsert": sql("chunks_v", """
        SELECT section, CASE WHEN section = 'results' THEN 'new' ELSE chunk_type END AS chunk_type, count(*) AS n,
               count(*) FILTER (section <> 'results' AND chunk_type <> 'text') AS untouched
        FROM chunks_v WHERE section <> 'results' OR chunk_type = 'text' GROUP BY ALL"""),
    "merge_protected": _with("", _ENTRY, """
        SELECT seq, drug, jurisdiction, warning, source FROM mark_v WHERE p = coalesce(m, z)"""),
    "merge_counts": _with("", _ENTRY, """
        SELECT count(*) FILTER (p > m) AS protected, count(*) FILTER ((m IS NULL OR p <= m) AND p > 1) AS updated,
               count(*) FILTER ((m IS NULL OR p <= m) AND p = 1) AS added FROM mark_v WHERE side = 1"""),
    "enforcement_map": _ENF,
    "eav_pivot": """
        SELECT 'e' || event_id AS embedding_id, 'P' || user_id AS pmc_id, CASE WHEN user_id % 4 <> 0 THEN event_type END AS topic,
               CAST(event_id % 30 + 1995 AS VARCHAR) AS year, props ->> '$.k' AS chunk_index,
               CASE WHEN event_id % 3 <> 0 THEN event_type END AS title FROM events""",
    "payload_map": """
        SELECT 'e' || event_id AS chunk_id, 'doc ' || props AS text, 'P' || user_id AS pmcid,
               CASE WHEN event_id % 3 <> 0 THEN event_type ELSE '' END AS title, event_id % 30 + 1995 AS year,
               CASE WHEN user_id % 4 <> 0 THEN event_type ELSE '' END AS topic, CASE WHEN user_id % 4 <> 0 THEN event_type ELSE '' END AS cancer_type,
               CAST(props ->> '$.k' AS BIGINT) AS chunk_index, NULL::BIGINT AS total_chunks, 6::BIGINT AS evidence_level, 'unknown' AS study_design,
               CASE WHEN event_id % 3 <> 0 THEN event_type || ' | ' || chr(10) ELSE '' END || 'doc ' || props AS embed_text
        FROM events""",
    "golden_load": f"""
        SELECT coalesce(id, '') AS id, coalesce(nullif(query, ''), question, '') AS query, coalesce(nullif(cancer_type, ''), topic) AS cancer_type,
               difficulty, 'treatment' AS question_type, true AS must_not_hallucinate, '' AS ground_truth,
               CASE WHEN seq % 2 = 0 THEN 'tion' ELSE '' END AS must_contain_terms FROM ({_GOLD})""",
    "golden_append": f"""
        WITH g AS ({_GOLD})
        SELECT id, coalesce(query, question) AS query FROM g WHERE id IS NOT NULL
        UNION ALL
        SELECT printf('G%03d', (SELECT max(CAST(id[2:] AS BIGINT)) FROM g) + row_number() OVER (ORDER BY seq)) AS id, coalesce(query, question)
        FROM g WHERE id IS NULL""",
    "quick_sample": "SELECT CAST(item_id AS VARCHAR) AS id, text AS query FROM benchmark ORDER BY md5('7:' || item_id), 1 LIMIT 10",
    "point_scan": """
        SELECT CASE WHEN vec_id % 3 <> 0 THEN 'c' || vec_id ELSE CAST(vec_id AS VARCHAR) END AS chunk_id,
               CASE WHEN label <> 1 THEN CAST(label AS VARCHAR) ELSE '' END AS text, label::BIGINT AS label FROM embeddings""",
    "chunk_lookup": sql("chunks_v", """
        SELECT item_id || '_abstract_0' AS chunk_id, paper_key, md5(c.text) AS text_md5
        FROM benchmark b LEFT JOIN chunks_v c ON c.chunk_id = item_id || '_abstract_0'"""),
}
