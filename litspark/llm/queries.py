"""The dealt operators over their whole tables, one query each, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from litspark.llm import (bit_sliced, chat_format, hard_negatives, mixing, packing, periodic_runs, quality_rules, set_join, sharding,
                          substrings, suffix_trees, toxicity, url_filter)

QUERIES, ORACLE = {"pipeline": corpus_pipeline.run}, {}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge_lines(docs, cleaned=None)


ORACLE["op10_line_first_quality"] = quality_rules.oracle()


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op2_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rounds=None)


ORACLE["op2_link_graph_urls"] = url_filter.oracle()

#: A conversation that holds the template's own marks, added to the table.
PLANTED_CONVERSATION, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(1).select(
        F.lit(PLANTED_CONVERSATION).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"),
        F.to_json(F.struct(F.lit(PLANTED_TEXT).alias("prompt"), F.lit(PLANTED_TEXT).alias("response"))).alias("record"))
    turns = chat_format.canonical_turns(chat_format.records_of_rows(rows).unionByName(planted))
    return chat_format.digest_formatted(chat_format.format_turns(turns))


ORACLE["op5_chat_format"] = r"""
    WITH every AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    sized AS (SELECT *, length(text) + length(role) + 15 + length(regexp_replace(text, '[^\\#<]', '', 'g'))
        + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS n FROM every)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(n)::BIGINT AS formatted_chars FROM sized GROUP BY conv_id"""


@query
def op1_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bit_sliced.search(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE["op1_bit_sliced_topk"] = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scored QUALIFY rank <= 10"""


@query
def op8_bucket_pointer_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, cleaned=None)


ORACLE["op8_bucket_pointer_substrings"] = r"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    places AS (SELECT doc_id, h, unnest(range(length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400),
    windows AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, (2 * i + 1)::BIGINT, 400)) AS k FROM places),
    again AS (SELECT doc_id, i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
    marked AS (SELECT *, i - 200 > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS fresh FROM again),
    numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
    spans AS (SELECT doc_id, span, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY doc_id, span),
    gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM spans),
    cut AS (SELECT doc_id, count(*) AS n, sum(e - s)::BIGINT AS gone, max(e) AS last, string_agg(substr(h, (2 * p + 1)::BIGINT, (2 * (s - p))::BIGINT), '' ORDER BY s) AS head
        FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
        sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
    FROM d LEFT JOIN cut USING (doc_id)"""


@query
def op3_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query
def op7_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.link_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE["op7_set_relation_join"] = r"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i + 1:i + 5], ' ')) AS s
        FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
    sets AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    ordered AS (SELECT s.doc_id, s.s, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df, s.s) AS place
        FROM shingles s JOIN (SELECT s, count(*) AS df FROM shingles GROUP BY s) f USING (s) JOIN sets USING (doc_id)),
    heads AS (SELECT doc_id, s, n FROM ordered WHERE place <= n - ceil(0.8 * n) + 1),
    pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM heads a JOIN heads b
        ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    shared AS (SELECT a, b, na, nb, count(*) AS k FROM pairs JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.s = x.s GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)),
    sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, c) AS (SELECT DISTINCT a, a FROM sides UNION SELECT b, c FROM reach JOIN sides ON a = doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) USING (doc_id)"""


@query
def op11_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_trees.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE["op11_prefix_suffix_trees"] = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
    windows AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS k FROM starts),
    least AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN least USING (k) WHERE m < doc_id),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)"""


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth text by the id's CRC repeats its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    docs = docs.select("doc_id", "text", h.alias("_h"), F.floor(h / 10).alias("_g"), words.alias("_w")).withColumn("_n", F.size("_w"))
    start = F.col("_g") % F.col("_n")
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, start).cast("int"))
    docs = docs.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), times)), F.lit(1), F.col("_n") - F.col("_a"))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " ")
    return docs.select("doc_id", F.when(F.col("_n") > 0, text).otherwise(F.col("text")).alias("text"))


@query
def op12_link_cut_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumns({"_best": best, "_lines": F.array_join(lines, "")})
    start, period = -F.col("_best.start"), -F.col("_best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), F.col("_best.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("_best.length") / period).cast("long").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


ORACLE["op12_link_cut_runs"] = r"""
    WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
            list_reduce(list_prepend(xor(c, b), range(8)), lambda z, e: xor(z >> 1, CASE WHEN z % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS h FROM documents),
    shaped AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM texts),
    d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
            THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END)
            ELSE w END AS w FROM shaped),
    places AS (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM d WHERE n >= 6),
    grams AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 6], ' ')) AS k FROM places),
    matches AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
    islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches),
    stretches AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 6 + q AS n FROM islands GROUP BY doc_id, q, island),
    runs AS (SELECT doc_id, s, n, min(q) AS q FROM stretches WHERE n >= greatest(12, 2 * q) GROUP BY doc_id, s, n),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s, q) = 1),
    lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period, (1000 * b.n) // b.q AS exponent_milli,
        sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
    FROM d LEFT JOIN best b USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


@query
def op13_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLE["op13_secondary_sort_negatives"] = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
        FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.e) = len(r.e) WHERE a.vec_id % 100 = 0),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY rank <= 5"""
