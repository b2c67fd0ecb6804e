"""The driver's tables read as papers, sections, chunks, questions, answers and logs.

Every view exists twice, as a DataFrame and as SQL, computed from whole tables.
Columns the tables lack are derived from keys the same way on both sides.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.scores import evidence_level
from litspark.functions.text import section_label
from litspark.operators.corpus import chunk_papers
from litspark.session import store
from litspark.sizing import spread

HEADINGS = ["Introduction", "Patients and Methods", "Outcomes in patients", "Results", "Discussion",
            "Conclusions", "Statistical Analysis", "Case presentation", "Funding", "Summary of findings",
            "Study outcomes", "Methodological limits"]
NOW_YEAR = 2026


KEYS = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "conversations": "conv_id"}


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, KEYS[name]) if name in KEYS else df


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values: list[str], index: str) -> str:
    return f"{sql_list(values)}[({index}) % {len(values)} + 1]"


# --- papers and sections ------------------------------------------------------

def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


@lru_cache(maxsize=16)
def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with their sections: one line of a document is one section."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")

    def heading(i: Column) -> Column:
        return F.when(i == 0, F.lit("Abstract")).otherwise(pick(HEADINGS, d * 7 + i))

    def section(x: Column, i: Column) -> Column:
        kind = F.when(i % 9 == 7, "table").when(i % 9 == 8, "figure_caption").otherwise("text")
        return F.struct(section_label(heading(i)).alias("name"), heading(i).alias("raw_name"),
                        x.alias("content"), kind.alias("section_type"))

    raw = F.transform(lines(F.col("text")), section)
    named = docs.select(
        "doc_id", d.cast("string").alias("paper_key"), F.concat(F.lit("9"), d.cast("string")).alias("pmid"),
        F.when(d % 37 == 0, "").otherwise(
            F.concat_ws(" ", "source", "lang", F.lit("study"), d.cast("string"))).alias("title"),
        F.coalesce(F.get(lines(F.col("text")), F.lit(0)), F.lit("")).alias("abstract"),
        F.transform(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= d % 5),
                    lambda i: F.concat(F.lit("Author"), (d * i % 97).cast("string"), F.lit(" X"))).alias("authors"),
        F.col("source").alias("journal"),
        F.when(d % 50 != 0, (2008 + d % 18).cast("int")).alias("year"),
        pick(K.TOPICS, d).alias("topic"), pick(K.DESIGNS, F.floor(d / 6)).alias("study_design"),
        F.when(d % 4 != 0, (10 + d % 500).cast("int")).alias("sample_size"),
        F.filter(raw, lambda s: s["name"] != K.SKIP_SECTION).alias("sections"),
    )
    return named.withColumn("cancer_type", F.array("topic")).withColumn(
        "evidence_level", evidence_level(F.col("study_design")))


@lru_cache(maxsize=16)
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_papers(papers(spark, sf_dir), table_cap=K.TABLE_WORD_CAP)


@lru_cache(maxsize=16)
def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as a written table, as retrieval finds them in a built corpus."""
    return store(chunks(spark, sf_dir), "chunks")


@lru_cache(maxsize=16)
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with the vector of its document, where the document has one."""
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("paper_key"), "embedding")
    return chunk_table(spark, sf_dir).drop("text").join(emb, "paper_key")


@lru_cache(maxsize=16)
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, with a vector and some with filters."""
    i = F.col("item_id")
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return table(spark, sf_dir, "benchmark").join(emb, "item_id", "left").select(
        i.cast("string").alias("query_id"), F.col("text").alias("question"), "embedding",
        F.when(i % 2 == 0, F.array(pick(K.TOPICS, i))).alias("f_cancer_type"),
        F.when(i % 3 == 0, F.lit(2012)).alias("f_year_min"),
        F.when(i % 5 == 0, F.lit(4)).alias("f_evidence_level_max"))


@lru_cache(maxsize=16)
def legacy_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers in the collection layout; some lack fields, some years are not numbers."""
    d = F.col("doc_id")
    return papers(spark, sf_dir).select(
        "doc_id", F.col("paper_key").alias("pmc_id"), "pmid",
        F.when(d % 41 == 0, "No title").otherwise(F.col("title")).alias("title"),
        F.when(d % 13 == 0, "").otherwise(F.col("abstract")).alias("abstract"), "authors", "journal",
        F.when(d % 29 == 0, "n.d.").otherwise(F.coalesce(F.col("year").cast("string"), F.lit(""))).alias("year"),
        "topic",
        F.transform("sections", lambda s: F.struct(s["raw_name"].alias("section_name"),
                                                   s["content"].alias("content"))).alias("sections"))


# --- conversations -------------------------------------------------------------

@lru_cache(maxsize=16)
def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that an assistant turn follows, as question and cited answer."""
    c, t = F.col("conv_id"), F.col("turn")
    # Turns are numbered without gaps: the next one is found by key, so a long
    # conversation is spread like any other rows.
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    after = turns.select("conv_id", (t - 1).alias("turn"), F.col("role").alias("next_role"), F.col("text").alias("next_text"))
    nxt = turns.join(after, ["conv_id", "turn"])

    def extra(every: int, text: str) -> Column:
        return F.when(c % every == 0, text).otherwise("")

    return nxt.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        "conv_id", "turn", F.concat_ws("-", c.cast("string"), t.cast("string")).alias("query_id"),
        F.col("text").alias("question"),
        F.concat("next_text", F.lit(" [Doc "), (t + 1).cast("string"), F.lit("]"), extra(5, " and [Doc 9]."),
                 extra(4, " See [doc 1][Doc 12]."), extra(7, " You should take 50 mg daily."),
                 extra(3, " This may help."), extra(11, " I cannot answer more.")).alias("answer"),
        F.when(c % 6 != 0, F.col("next_text")).alias("ground_truth"),
        pick(K.TOPICS, c).alias("cancer_type"), pick(["easy", "medium", "hard"], c).alias("difficulty"),
        pick(["treatment", "safety", "prognosis", "diagnosis"], t).alias("question_type"),
        F.when(c % 2 == 0, F.array(F.lit("tion"), F.lit("The"))).otherwise(
            F.array().cast("array<string>")).alias("must_contain_terms"))


@lru_cache(maxsize=16)
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked chunks per question: the assistant turns of its conversation."""
    c = F.col("conv_id")
    order = Window.partitionBy("conv_id").orderBy("turn")
    top = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn(
        "rank", F.row_number().over(order)).select(
        "conv_id", "rank", "text", ((c + F.col("rank")) % 6 + 1).cast("int").alias("evidence_level"),
        F.concat(F.lit("P"), (c + F.floor(F.col("rank") / 3)).cast("string")).alias("pmcid"),
        F.array(pick(K.TOPICS, c + F.col("rank") % 2)).alias("cancer_type"),
        (F.lit(1.0) - (c * 7 + F.col("rank") * 13) % 97 / 100.0).alias("relevance_score"))
    return answered(spark, sf_dir).select("query_id", "conv_id").join(top, "conv_id").drop("conv_id")


# --- SQL twins -------------------------------------------------------------------

def _label_case(col: str) -> str:
    rules = " ".join(f"WHEN contains({col}, '{kw}') THEN '{label}'" for kw, label in K.SECTION_RULES)
    return f"CASE {rules} ELSE 'other' END"


def _level_case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col}='{k}' THEN {v}" for k, v in K.EVIDENCE_LEVELS.items()) + " ELSE 6 END"


WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
TOKENS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"

CTES = {
    "lines_v": ((), """
        SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) - 1 AS pos
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)"""),
    "sections_v": (("lines_v",), f"""
        SELECT *, {_label_case('lower(raw_name)')} AS name,
               CASE pos % 9 WHEN 7 THEN 'table' WHEN 8 THEN 'figure_caption' ELSE 'text' END AS section_type
        FROM (SELECT doc_id, pos, content,
                     CASE WHEN pos = 0 THEN 'Abstract' ELSE {sql_pick(HEADINGS, 'doc_id * 7 + pos')} END AS raw_name
              FROM lines_v)"""),
    "kept_v": (("sections_v",), "SELECT * FROM sections_v WHERE name <> '_skip'"),
    "papers_v": (("lines_v",), f"""
        SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS paper_key, '9' || d.doc_id AS pmid,
               CASE WHEN d.doc_id % 37 = 0 THEN '' ELSE concat_ws(' ', source, lang, 'study', d.doc_id) END AS title,
               coalesce(l.content, '') AS abstract,
               list_transform(range(1, d.doc_id % 5 + 1), lambda i: 'Author' || (d.doc_id * i % 97) || ' X') AS authors,
               source AS journal, CASE WHEN d.doc_id % 50 <> 0 THEN 2008 + d.doc_id % 18 END AS year,
               {sql_pick(K.TOPICS, 'd.doc_id')} AS topic,
               {sql_pick(K.DESIGNS, 'd.doc_id // 6')} AS study_design,
               {_level_case(sql_pick(K.DESIGNS, 'd.doc_id // 6'))} AS evidence_level,
               CASE WHEN d.doc_id % 4 <> 0 THEN 10 + d.doc_id % 500 END AS sample_size
        FROM documents d LEFT JOIN lines_v l ON l.doc_id = d.doc_id AND l.pos = 0"""),
    "worded_v": (("kept_v",), f"SELECT *, {WORDS.format('content')} AS w FROM kept_v"),
    "texts_v": (("worded_v",), f"""
        SELECT doc_id, pos, name AS section, section_type AS chunk_type, unnest(t) AS text,
               generate_subscripts(t, 1) AS i
        FROM (SELECT *, CASE
                WHEN len(w) = 0 THEN []
                WHEN section_type = 'table' THEN [CASE WHEN len(w) > {K.TABLE_WORD_CAP}
                     THEN array_to_string(w[1:{K.TABLE_WORD_CAP}], ' ') || ' {K.TABLE_NOTE}' ELSE content END]
                WHEN section_type = 'figure_caption' THEN [content]
                WHEN len(w) < {K.MIN_CHUNK_WORDS} THEN []
                WHEN len(w) <= {K.SHORT_SECTION_WORDS} THEN [content]
                ELSE list_transform(range(0, greatest(CAST(ceil((len(w) - 200) / 170.0) AS BIGINT), 0) + 1),
                                    lambda k: array_to_string(w[k * 170 + 1 : k * 170 + 200], ' ')) END AS t
              FROM worded_v)"""),
    "chunks_v": (("texts_v", "papers_v"), """
        SELECT p.paper_key || '_' || c.section || '_' || c.chunk_index AS chunk_id, c.text, c.section,
               c.chunk_type, c.chunk_index, p.*
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) - 1 AS chunk_index FROM texts_v) c
        JOIN papers_v p USING (doc_id)"""),
    "questions_v": ((), f"""
        SELECT item_id, CAST(item_id AS VARCHAR) AS query_id, b.text AS question, e.embedding,
               CASE WHEN item_id % 2 = 0 THEN {sql_pick(K.TOPICS, 'item_id')} END AS f_topic,
               CASE WHEN item_id % 3 = 0 THEN 2012 END AS f_year_min,
               CASE WHEN item_id % 5 = 0 THEN 4 END AS f_level_max
        FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id"""),
    "tok_v": (("chunks_v",), f"SELECT *, len(t) AS dl FROM (SELECT chunk_id, topic, year, evidence_level, {TOKENS.format('text')} AS t FROM chunks_v)"),
    "post_v": (("tok_v",), """
        SELECT chunk_id, dl, topic, year, evidence_level, term, count(*) AS tf
        FROM (SELECT chunk_id, dl, topic, year, evidence_level, unnest(t) AS term FROM tok_v) GROUP BY ALL"""),
    "idf_v": (("post_v", "tok_v"), """
        SELECT term, df, greatest(ln(((SELECT count(*) FROM tok_v) - df + 0.5) / (df + 0.5)), 0) AS idf
        FROM (SELECT term, count(*) AS df FROM post_v GROUP BY term)"""),
    "qterm_v": (("questions_v",), f"""
        SELECT query_id, term, count(*) AS qtf
        FROM (SELECT query_id, unnest({TOKENS.format('question')}) AS term FROM questions_v) GROUP BY ALL"""),
    "kw_scored_v": (("post_v", "idf_v", "qterm_v", "tok_v"), f"""
        SELECT * FROM (
          SELECT query_id, chunk_id, any_value(topic) AS topic, any_value(year) AS year,
                 any_value(evidence_level) AS evidence_level,
                 round(sum(qtf * idf * tf / (tf + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * dl /
                       (SELECT avg(dl) FROM tok_v)))), 9) AS score
          FROM qterm_v JOIN idf_v USING (term) JOIN post_v USING (term) WHERE idf > 0
          GROUP BY query_id, chunk_id) WHERE score > 0"""),
    "kw_v": (("kw_scored_v", "questions_v"), """
        SELECT s.query_id, chunk_id, score, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, chunk_id) AS rank
        FROM kw_scored_v s JOIN questions_v q ON q.query_id = s.query_id
        WHERE (f_topic IS NULL OR topic = f_topic) AND (f_year_min IS NULL OR year IS NULL OR year >= f_year_min)
          AND (f_level_max IS NULL OR evidence_level IS NULL OR evidence_level <= f_level_max)
        QUALIFY rank <= 20"""),
    "cos_v": (("questions_v", "chunks_v"), """
        SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score,
               c.topic, c.year, c.evidence_level, f_topic, f_year_min, f_level_max
        FROM chunks_v c JOIN embeddings e ON e.vec_id = c.doc_id CROSS JOIN questions_v q
        WHERE q.embedding IS NOT NULL"""),
    "dn_v": (("cos_v",), """
        SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM cos_v
        WHERE (f_topic IS NULL OR topic = f_topic) AND (f_year_min IS NULL OR year >= f_year_min)
          AND (f_level_max IS NULL OR evidence_level <= f_level_max)
        QUALIFY rank <= 20"""),
    "fused_v": (("kw_v", "dn_v"), """
        SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST,
                                     keyword_rank NULLS LAST, chunk_id) AS rank
        FROM (SELECT *, 1.0 / (60 + coalesce(dense_rank, n)) + 1.0 / (60 + coalesce(keyword_rank, n)) AS score
              FROM (SELECT *, greatest(count(dense_rank) OVER w, count(keyword_rank) OVER w, 1) + 1 AS n
                    FROM (SELECT coalesce(d.query_id, k.query_id) AS query_id, coalesce(d.chunk_id, k.chunk_id) AS chunk_id,
                                 d.rank AS dense_rank, k.rank AS keyword_rank
                          FROM dn_v d FULL JOIN kw_v k ON d.query_id = k.query_id AND d.chunk_id = k.chunk_id)
                    WINDOW w AS (PARTITION BY query_id)))
        QUALIFY rank <= 20"""),
    "capped_v": (("fused_v", "chunks_v"), """
        SELECT * EXCLUDE (seen) FROM (
          SELECT f.*, c.* EXCLUDE (chunk_id), sum(CASE WHEN study_design = 'review' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY query_id ORDER BY rank) AS seen
          FROM fused_v f JOIN chunks_v c USING (chunk_id))
        WHERE study_design <> 'review' OR seen <= 3"""),
    "reranked_v": (("capped_v", "cos_v"), f"""
        SELECT * EXCLUDE (judged, rank, rel, place), rank AS fused_rank, place AS rank,
               CASE WHEN judged THEN rel ELSE score END AS relevance_score,
               CASE WHEN judged THEN pow(rel, 0.7) * pow(dw, 0.15) * pow(rw * tb, 0.15) ELSE score END AS final_score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN judged THEN rel END DESC NULLS LAST, rank, chunk_id) AS place
        FROM (SELECT k.*, x.score AS rel, count(x.score) OVER (PARTITION BY k.query_id) > 0 AS judged,
                     CASE study_design WHEN 'rct' THEN 0.9 WHEN 'meta_analysis' THEN 1.0 WHEN 'cohort' THEN 0.6
                          WHEN 'review' THEN 0.3 WHEN 'case_report' THEN 0.5 ELSE 0.5 END AS dw,
                     CASE WHEN k.year IS NULL THEN 0.75 WHEN {NOW_YEAR} - k.year <= 2 THEN 1.0 WHEN {NOW_YEAR} - k.year <= 5 THEN 0.9
                          WHEN {NOW_YEAR} - k.year <= 10 THEN 0.8 WHEN {NOW_YEAR} - k.year <= 15 THEN 0.7 ELSE 0.6 END AS rw,
                     CASE WHEN study_design = 'rct' AND {NOW_YEAR} - k.year <= 2 THEN 1.1 ELSE 1.0 END AS tb
              FROM capped_v k LEFT JOIN cos_v x ON x.query_id = k.query_id AND x.chunk_id = k.chunk_id)
        WHERE NOT judged OR rel IS NOT NULL) WHERE place <= 5"""),
    "graded_v": (("reranked_v",), """
        SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
        FROM reranked_v WHERE relevance_score >= 0.45"""),
    "legacy_v": (("papers_v",), """
        SELECT doc_id, paper_key AS pmc_id, pmid, CASE WHEN doc_id % 41 = 0 THEN 'No title' ELSE title END AS title,
               CASE WHEN doc_id % 13 = 0 THEN '' ELSE abstract END AS abstract, authors, journal,
               CASE WHEN doc_id % 29 = 0 THEN 'n.d.' ELSE coalesce(CAST(year AS VARCHAR), '') END AS year, topic
        FROM papers_v"""),
    "body_v": (("kept_v", "legacy_v"), """
        SELECT l.*, coalesce(n, 0) AS n_sections, coalesce(chars, 0) AS chars, coalesce(has_m, false) AS has_m,
               coalesce(has_r, false) AS has_r
        FROM legacy_v l LEFT JOIN (
          SELECT doc_id, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars,
                 bool_or(contains(lower(raw_name), 'method')) AS has_m, bool_or(contains(lower(raw_name), 'result')) AS has_r
          FROM kept_v GROUP BY doc_id) s USING (doc_id)"""),
    "issues_v": (("body_v",), """
        SELECT *, list_filter([
            CASE WHEN chars < 5000 THEN 'Very short (' || format('{:,}', chars) || ' chars)' END,
            CASE WHEN n_sections = 0 THEN 'No sections' WHEN n_sections < 3 THEN 'Only ' || n_sections || ' sections' END,
            CASE WHEN length(abstract) = 0 THEN 'No abstract' WHEN length(abstract) < 100 THEN 'Very short abstract' END,
            CASE WHEN title = '' OR title = 'No title' THEN 'Missing title' END,
            CASE WHEN NOT has_m THEN 'No methods section' END,
            CASE WHEN NOT has_r THEN 'No results section' END], lambda x: x IS NOT NULL) AS issues
        FROM body_v"""),
    "qa_v": ((), f"""
        SELECT conv_id, turn, conv_id || '-' || turn AS query_id, text AS question,
               next_text || ' [Doc ' || (turn + 1) || ']' || CASE WHEN conv_id % 5 = 0 THEN ' and [Doc 9].' ELSE '' END
               || CASE WHEN conv_id % 4 = 0 THEN ' See [doc 1][Doc 12].' ELSE '' END
               || CASE WHEN conv_id % 7 = 0 THEN ' You should take 50 mg daily.' ELSE '' END
               || CASE WHEN conv_id % 3 = 0 THEN ' This may help.' ELSE '' END
               || CASE WHEN conv_id % 11 = 0 THEN ' I cannot answer more.' ELSE '' END AS answer,
               CASE WHEN conv_id % 6 <> 0 THEN next_text END AS ground_truth,
               {sql_pick(K.TOPICS, 'conv_id')} AS cancer_type,
               {sql_pick(['easy', 'medium', 'hard'], 'conv_id')} AS difficulty,
               {sql_pick(['treatment', 'safety', 'prognosis', 'diagnosis'], 'turn')} AS question_type,
               CASE WHEN conv_id % 2 = 0 THEN ['tion', 'The'] ELSE [] END AS must_contain_terms
        FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
              WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND next_role = 'assistant'"""),
    "ev_v": (("qa_v",), f"""
        SELECT q.query_id, e.* EXCLUDE (conv_id) FROM qa_v q JOIN (
          SELECT conv_id, rank, text, (conv_id + rank) % 6 + 1 AS evidence_level, 'P' || (conv_id + rank // 3) AS pmcid,
                 {sql_pick(K.TOPICS, 'conv_id + rank % 2')} AS topic,
                 1.0::DOUBLE - ((conv_id * 7 + rank * 13) % 97)::DOUBLE / 100.0::DOUBLE AS relevance_score
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations WHERE role = 'assistant')
          ) e USING (conv_id)"""),
    "packed_v": (("qa_v", "ev_v"), """
        SELECT q.*, coalesce(e.texts, []) AS texts, coalesce(e.levels, []) AS levels
        FROM qa_v q LEFT JOIN (SELECT query_id, list(text ORDER BY rank) AS texts, list(evidence_level ORDER BY rank) AS levels
                               FROM ev_v GROUP BY query_id) e USING (query_id)"""),
}


def sql(needs: str, body: str) -> str:
    """``body`` behind the views it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in CTES[name][0]:
                visit(dep)
            order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return body.strip()
    # Materialised: several views are used more than once.
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1].strip()})" for n in order) + "\n" + body.strip()
