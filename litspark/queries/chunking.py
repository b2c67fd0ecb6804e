"""Text expressions, section labels, chunk arrays, identifiers, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.functions import chunks as C
from litspark.functions import text as X
from litspark.functions.scores import legacy_embedding_cost
from litspark.operators import corpus, stats
from litspark.queries import views as V
from litspark.queries.views import TOKENS, WORDS, sql
from litspark.sources import html, jats


def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, tokens and distinct tokens of every document."""
    docs = V.table(spark, sf_dir, "documents")
    toks = docs.select("doc_id", X.word_count(F.col("text")).alias("n_words"), X.tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"),
                       F.size("t").cast("bigint").alias("n_tokens"),
                       F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


def key_term_stats(spark, sf_dir):
    """Key terms of every document, counted and joined in sorted order."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.array_sort(X.key_terms(F.col("text"))).alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_terms"),
                       F.md5(F.array_join("t", " ")).alias("terms_md5"))


def section_labels(spark, sf_dir):
    """Sections per raw heading and canonical label, skipped ones included."""
    d = F.col("doc_id")
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(V.lines(F.col("text"))).alias("pos", "x"))
    raw = F.when(F.col("pos") == 0, "Abstract").otherwise(V.pick(V.HEADINGS, d * 7 + F.col("pos")))
    return rows.groupBy(raw.alias("raw_name")).agg(F.count("*").alias("n")).select(
        "raw_name", X.section_label(F.col("raw_name")).alias("name"), "n")


def sections_clean(spark, sf_dir):
    """Every kept section after markup and legacy cleaning."""
    rows = V.papers(spark, sf_dir).select("doc_id", F.posexplode("sections").alias("i", "s"))
    marked = F.concat("s.content", F.lit(" [3] [1,2]  [4-6] [7, 8]"))
    return rows.select("doc_id", F.col("i").cast("bigint").alias("i"), F.col("s.name").alias("name"),
                       F.md5(X.clean_markup(marked)).alias("clean_md5"),
                       F.md5(X.clean_legacy(marked)).alias("legacy_md5"))


def sliding_chunks(spark, sf_dir):
    """All chunks: id, position, section, type, words, digest of the text."""
    return V.chunks(spark, sf_dir).select(
        "chunk_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "section", "chunk_type",
        X.word_count(F.col("text")).cast("bigint").alias("n_words"), F.md5("text").alias("text_md5"))


def chunk_ids(spark, sf_dir):
    """Both point identifiers of every chunk."""
    c = F.col("chunk_id")
    return V.chunks(spark, sf_dir).select("chunk_id", C.point_id(c).alias("point_id"), C.point_id_v5(c).alias("point_id_v5"))


def _legacy(spark, sf_dir):
    return corpus.legacy_chunks(V.legacy_papers(spark, sf_dir))


def legacy_chunks(spark, sf_dir):
    """Chunks of the older processing with index and total per section."""
    return _legacy(spark, sf_dir).select(
        "doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "section_name",
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("total_chunks").cast("bigint").alias("total_chunks"), F.md5("text").alias("text_md5"))


def legacy_ids(spark, sf_dir):
    """Composite keys of the older collection."""
    return _legacy(spark, sf_dir).select(C.legacy_id(
        F.col("topic"), F.col("pmc_id"), F.col("pmid"), F.col("section_name"), F.col("chunk_index"),
        F.col("ordinal")).alias("legacy_id"))


def chunk_totals(spark, sf_dir):
    """Chunks per paper and section, spread over the chunks of the section."""
    c = V.chunks(spark, sf_dir)
    return c.groupBy("paper_key", "section").agg(
        F.count("*").alias("total_chunks"), F.min("chunk_index").cast("bigint").alias("first_index"),
        F.max("chunk_index").cast("bigint").alias("last_index"))


def embed_cost(spark, sf_dir):
    """Words handed to the embedder and estimated cost per topic, with the older flat estimate."""
    rows = corpus.with_embedding_text(V.chunks(spark, sf_dir))
    return stats.embedding_costs(rows).select(
        "topic", "chunks", "words", F.round("estimated_cost_usd", 9).alias("estimated_cost_usd"),
        F.round(legacy_embedding_cost(F.col("chunks")), 9).alias("legacy_cost_usd"))


def embed_texts(spark, sf_dir):
    """Digest of the embedding input of every chunk; every seventh paper has a context prefix."""
    c = V.chunks(spark, sf_dir)
    prefixed = c.withColumn("context_prefix", F.when(F.col("paper_key").cast("bigint") % 7 == 0, F.col("journal")))
    return corpus.with_embedding_text(prefixed).select("chunk_id", F.md5("embed_text").alias("embed_md5"))


def pii_scrub(spark, sf_dir):
    """Documents after the opt-in scrub: digest and number of replacements."""
    scrubbed = X.scrub_pii(F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", scrubbed.alias("t")).select(
        "doc_id", F.md5("t").alias("scrubbed_md5"),
        F.regexp_count("t", F.lit(r"\[REDACTED\]")).cast("bigint").alias("n_redacted"))


def _xml(spark, sf_dir):
    """Each document as a paper in XML: lines become sections."""
    def esc(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    d = F.col("doc_id")
    body = F.array_join(F.transform(F.slice("l", 2, F.size("l")), lambda x, i: F.concat(
        F.lit("<sec><title>"), V.pick(V.HEADINGS, d * 7 + i + 1), F.lit("</title><p>"), esc(x), F.lit(" [3]</p></sec>"))), "")
    return V.table(spark, sf_dir, "documents").withColumn("l", V.lines(F.col("text"))).select(
        d.cast("string").alias("doc_key"),
        F.concat(
            F.lit("<article><front><journal-title>"), "source", F.lit("</journal-title><article-id pub-id-type='pmc'>PMC"),
            d.cast("string"), F.lit("</article-id><article-title>Study <i>of</i> "), "lang",
            F.lit("</article-title><contrib contrib-type='author'><name><surname>Doe</surname><given-names>J"),
            d.cast("string"), F.lit("</given-names></name></contrib><pub-date pub-type='epub'/><pub-date pub-type='ppub'><year>"),
            (2000 + d % 20).cast("string"), F.lit("</year></pub-date><abstract><p>"),
            esc(F.coalesce(F.get("l", F.lit(0)), F.lit(""))), F.lit("</p></abstract></front><body>"), body,
            F.lit("</body></article>")).alias("xml"))


def jats_papers(spark, sf_dir):
    """Documents written as XML and parsed back: paper fields."""
    return paper_fields(_xml(spark, sf_dir))


def paper_fields(xml):
    """Fields of the papers in ``(doc_key, xml)``."""
    return jats.parse_papers(xml).select(
        "paper_key", "title", "journal", F.col("year").cast("bigint").alias("year"),
        F.array_join("authors", "|").alias("authors"), F.md5("abstract").alias("abstract_md5"),
        F.size("sections").cast("bigint").alias("n_sections"))


def jats_sections(spark, sf_dir):
    """Documents written as XML and parsed back: ordered sections."""
    rows = jats.parse_papers(_xml(spark, sf_dir)).select("paper_key", F.posexplode("sections").alias("i", "s"))
    return rows.select("paper_key", F.col("i").cast("bigint").alias("i"), F.col("s.name").alias("name"),
                       F.col("s.raw_name").alias("raw_name"), F.col("s.section_type").alias("section_type"),
                       F.md5("s.content").alias("content_md5"))


def html_text(spark, sf_dir):
    """Visible text of every page."""
    return html.page_texts(V.table(spark, sf_dir, "pages")).select(
        "page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def topic_normalised(spark, sf_dir):
    """Documents per raw topic spelling with the topic it resolves to."""
    raw = V.pick(["  Renal ", "RCC", "pca", "Bladder", "NMIBC", "gct", "acc", "penile", "lung", ""], F.col("doc_id"))
    return V.table(spark, sf_dir, "documents").groupBy(raw.alias("raw")).agg(F.count("*").alias("n")).select(
        "raw", X.normalise_topic(F.col("raw")).alias("topic"), "n")


QUERIES = {f.__name__: f for f in (
    tokenize_stats, key_term_stats, section_labels, sections_clean, sliding_chunks, chunk_ids, legacy_chunks,
    legacy_ids, chunk_totals, embed_cost, embed_texts, pii_scrub, jats_papers, jats_sections, html_text,
    topic_normalised)}

_STOP = V.sql_list(V.K.STOPWORDS)
_CLEAN = r"trim(regexp_replace(regexp_replace({0}, '\[\d+(?:[,\s–\-]\d+)*\]', '', 'g'), '\s+', ' ', 'g'))"
_LEGACY_CLEAN = r"trim(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_ .,;:\-()\[\]'']', '', 'g'))"
_MARKED = "content || ' [3] [1,2]  [4-6] [7, 8]'"
_LEGACY = f"""
legacy_rows AS (
  SELECT doc_id, pos, raw_name AS section_name, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS chunk_index,
         len(t) AS total_chunks
  FROM (SELECT *, CASE WHEN len(w) <= 200 THEN [c]
               ELSE list_transform(range(0, len(w), 170), lambda k: array_to_string(w[k + 1 : k + 200], ' ')) END AS t
        FROM (SELECT *, {WORDS.format('c')} AS w
              FROM (SELECT *, {_LEGACY_CLEAN.format('content')} AS c FROM kept_v)))),
legacy_n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, chunk_index) - 1 AS ordinal FROM legacy_rows)
"""
_SHA = ("sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id))")
_EMBED = ("CASE WHEN title <> '' OR section <> '' THEN title || ' | ' || section || chr(10) || text ELSE text END")
_DASH = r"regexp_replace({0}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"
_SCRUB = "text"
for _p in V.K.PII_PATTERNS:
    _SCRUB = f"regexp_replace({_SCRUB}, '{_p}', '[REDACTED]', 'g')"


def _with(base: str, extra: str, body: str) -> str:
    head = sql(base, "")
    return head.rstrip() + ",\n" + extra.strip() + "\n" + body.strip()


_SKIP = "</?(script|style|nav|footer|head|noscript)([\\s/][^>]*)?>"
_ENTITIES = "p"
for _name, _sign in V.K.HTML_ENTITIES:
    _ENTITIES = "replace({0}, '&{1};', '{2}')".format(_ENTITIES, _name, _sign.replace("'", "''"))
_HTML = f"""
WITH bare AS (SELECT page_id, regexp_replace(coalesce(html, ''),
    '<!--.*?-->|<script(\\s[^>]*)?>.*?</script\\s*>|<style(\\s[^>]*)?>.*?</style\\s*>', '<i>', 'gis') AS h FROM pages),
cut AS (SELECT page_id, string_split_regex(h, '(?i){_SKIP}') AS parts, list_reduce(list_transform(
    regexp_extract_all(h, '(?i){_SKIP}'), lambda t: CASE WHEN t LIKE '%/>' THEN [0] WHEN t LIKE '</%' THEN [-1] ELSE [1] END),
    lambda a, s: list_append(a, greatest(0, a[-1] + s[1])), [0]) AS depth FROM bare),
shown AS (SELECT page_id, array_to_string(list_transform(list_filter(list_zip(parts, depth), lambda z: z[2] = 0), lambda z: z[1]), '<i>') AS v FROM cut),
pieces AS (SELECT page_id, list_transform(string_split_regex(v, '<(/?[a-zA-Z]([^>"'']|"[^"]*"|''[^'']*'')*|[!?][^>]*)>'),
    lambda p: regexp_replace({_ENTITIES}, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')) AS p FROM shown),
texts AS (SELECT page_id, array_to_string(list_filter(p, lambda x: x <> ''), ' ') AS text FROM pieces)
SELECT page_id, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM texts"""

ORACLE = {
    "html_text": _HTML,
    "tokenize_stats": f"""
        SELECT doc_id, len({WORDS.format('text')}) AS n_words, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct
        FROM (SELECT *, {TOKENS.format('text')} AS t FROM documents)""",
    "key_term_stats": f"""
        SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5
        FROM (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(
                regexp_extract_all(text, '[a-zA-Z]+'), lambda x: lower(x)), lambda x: length(x) > 3 AND NOT list_contains({_STOP}, x)))) AS t
              FROM documents)""",
    "section_labels": sql("sections_v", "SELECT raw_name, name, count(*) AS n FROM sections_v GROUP BY ALL"),
    "sections_clean": sql("kept_v", f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, name,
               md5({_CLEAN.format(_MARKED)}) AS clean_md5, md5({_LEGACY_CLEAN.format(_MARKED)}) AS legacy_md5 FROM kept_v"""),
    "sliding_chunks": sql("chunks_v", f"""
        SELECT chunk_id, chunk_index, section, chunk_type, len({WORDS.format('text')}) AS n_words, md5(text) AS text_md5
        FROM chunks_v"""),
    "chunk_ids": sql("chunks_v", f"""
        SELECT chunk_id, {_DASH.format('md5(chunk_id)')} AS point_id,
               {_DASH.format("s[1:12] || '5' || s[14:16] || translate(s[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || s[18:32]")} AS point_id_v5
        FROM (SELECT chunk_id, {_SHA} AS s FROM chunks_v)"""),
    "legacy_chunks": _with("kept_v", _LEGACY, """
        SELECT doc_id, ordinal, section_name, chunk_index, total_chunks, md5(text) AS text_md5 FROM legacy_n"""),
    "legacy_ids": _with("kept_v legacy_v", _LEGACY, """
        SELECT concat_ws('_', topic, pmc_id, pmid, left(replace(section_name, ' ', '_'), 30), chunk_index, ordinal) AS legacy_id
        FROM legacy_n JOIN legacy_v USING (doc_id)"""),
    "chunk_totals": sql("chunks_v", """
        SELECT paper_key, section, count(*) AS total_chunks, min(chunk_index) AS first_index, max(chunk_index) AS last_index
        FROM chunks_v GROUP BY ALL"""),
    "embed_cost": sql("chunks_v", f"""
        SELECT topic, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS words, round(sum(n) * 1.3::DOUBLE / 1000 * 0.00002::DOUBLE, 9) AS estimated_cost_usd,
               round(count(*) * 200 * 0.00002::DOUBLE / 1000, 9) AS legacy_cost_usd
        FROM (SELECT topic, len({WORDS.format('(' + _EMBED + ')')}) AS n FROM chunks_v) GROUP BY topic"""),
    "embed_texts": sql("chunks_v", f"""
        SELECT chunk_id, md5(CASE WHEN doc_id % 7 = 0 AND journal <> '' THEN journal || chr(10) || text ELSE {_EMBED} END) AS embed_md5
        FROM chunks_v"""),
    "pii_scrub": f"""
        SELECT doc_id, md5(t) AS scrubbed_md5, len(regexp_extract_all(t, '\\[REDACTED\\]')) AS n_redacted
        FROM (SELECT doc_id, {_SCRUB} AS t FROM documents)""",
    "jats_papers": sql("papers_v kept_v", f"""
        SELECT p.paper_key, 'Study of ' || d.lang AS title, d.source AS journal, 2000 + p.doc_id % 20 AS year,
               'Doe J' || p.doc_id AS authors, md5({_CLEAN.format('abstract')}) AS abstract_md5, coalesce(n, 0) AS n_sections
        FROM papers_v p JOIN documents d USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM kept_v GROUP BY doc_id) USING (doc_id)"""),
    "jats_sections": sql("kept_v", f"""
        SELECT CAST(doc_id AS VARCHAR) AS paper_key, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i,
               name, raw_name, 'text' AS section_type, md5({_CLEAN.format('content')}) AS content_md5 FROM kept_v"""),
    "topic_normalised": f"""
        SELECT raw, CASE WHEN list_contains({V.sql_list(V.K.TOPICS)}, t) THEN t END AS topic, n
        FROM (SELECT raw, n, CASE lower(trim(raw)) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in V.K.TOPIC_ALIASES.items())}
                     ELSE lower(trim(raw)) END AS t
              FROM (SELECT {V.sql_pick(["  Renal ", "RCC", "pca", "Bladder", "NMIBC", "gct", "acc", "penile", "lung", ""], 'doc_id')} AS raw,
                           count(*) AS n FROM documents GROUP BY 1))""",
}
