"""Citations, judges, evaluation, safety joins, cards, history, audit."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions import citations as C
from litspark.functions import records as R
from litspark.operators import context, evaluate, safety
from litspark.plans import answers as plan
from litspark.plans.cards import finish_cards
from litspark.plans.evaluation import evaluate as run_evaluation
from litspark.queries import views as V
from litspark.queries.views import sql
from litspark.sources import records

# Entries whose names and keywords occur in the driver's texts.
WITHDRAWALS = [
    # drug, aliases, indication_keywords, jurisdiction, warning, warning_fr
    ("thand", ["Heit"], ["tion", "ment"], "EMA", "Thand was withdrawn.", "Thand a été retiré."),
    ("That", [], [], "FDA", "", "That a été retiré."),
    ("orantion", ["lich", ""], ["zzz", "with"], "FDA", "Orantion was withdrawn.", ""),
    ("in", ["pour"], ["[doc 9"], "EMA", "In was withdrawn.", None),
]
BIOMARKERS = [
    # drug, drug_patterns, biomarker_keywords, indication_keywords, warning, warning_fr
    ("Alpha class", ["alpha", "Beta"], ["ch ", "keit"], ["prostate", "kidney", "bladder"], "Needs marker A.", "Marqueur A requis."),
    ("gamma", ["gamma"], ["zzz"], [], "Needs marker G.", None),
]
DRUGS = ["Alpha 10 mg [Doc 1]", "thand plus beta [Doc 7]", "Gamma", "orantion", "Delta [doc 2]"]


def withdrawals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *w) for i, w in enumerate(WITHDRAWALS)],
        "ord long, drug string, aliases array<string>, indication_keywords array<string>, jurisdiction string, "
        "warning string, warning_fr string")


def biomarkers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *b) for i, b in enumerate(BIOMARKERS)],
        "ord long, drug string, drug_patterns array<string>, biomarker_keywords array<string>, "
        "indication_keywords array<string>, warning string, warning_fr string")


@lru_cache(maxsize=16)
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their ranked chunks as one array."""
    ev = V.evidence(spark, sf_dir).groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "text", "evidence_level"))),
        lambda x: F.struct(x["text"].alias("text"), x["evidence_level"].alias("evidence_level"))).alias("chunks"))
    none = F.array().cast(ev.schema["chunks"].dataType)
    return V.answered(spark, sf_dir).join(ev, "query_id", "left").withColumn("chunks", F.coalesce("chunks", none))


@lru_cache(maxsize=16)
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.answer_flags(evaluate.judge_answers(packed(spark, sf_dir)))


# --- citations ------------------------------------------------------------------

def citation_split(spark, sf_dir):
    """Valid and hallucinated citations and the cleaned answer of every turn."""
    a = V.answered(spark, sf_dir).select("query_id", "answer", F.lit(3).alias("num_docs"))
    out = plan.check_citations(a)
    return out.select("query_id", F.array_join("citations", ",").alias("citations"),
                      F.array_join("hallucinated_citations", ",").alias("hallucinated"), F.md5("answer").alias("answer_md5"))


def citation_order(spark, sf_dir):
    """Cited numbers in range by first mention, and answers without any tag."""
    a = V.answered(spark, sf_dir)
    return a.select("query_id", F.array_join(C.first_mentions(F.array("answer", "question"), F.lit(12)), ",").alias("mentioned"),
                    F.md5(C.strip_all_tags(F.col("answer"))).alias("bare_md5"))


def post_process(spark, sf_dir):
    """Answers after citation checks, safety notes and confidence gate."""
    a = V.answered(spark, sf_dir).select("query_id", "answer", F.array("cancer_type").alias("query_topics"))
    out = plan.post_process(a, V.evidence(spark, sf_dir), withdrawals(spark))
    return out.select("query_id", F.md5("answer").alias("answer_md5"), "gate",
                      F.col("n_warnings").cast("bigint").alias("n_warnings"), F.array_join("citations", ",").alias("citations"))


# --- safety ------------------------------------------------------------------------

def warning_append(spark, sf_dir):
    """Answers with a note per withdrawn drug they mention in its withdrawn use."""
    out = safety.append_warnings(V.answered(spark, sf_dir).select("query_id", "answer"), withdrawals(spark))
    return out.select("query_id", F.md5("answer").alias("answer_md5"), F.col("n_warnings").cast("bigint").alias("n_warnings"))


def warning_append_fr(spark, sf_dir):
    """The same in French, falling back to the other language."""
    out = safety.append_warnings(V.answered(spark, sf_dir).select("query_id", "answer"), withdrawals(spark), "fr")
    return out.select("query_id", F.md5("answer").alias("answer_md5"), F.col("n_warnings").cast("bigint").alias("n_warnings"))


def _regulatory(spark, sf_dir, literal_rows):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    m = safety.match_entries(docs, F.col("text"), F.col("text"), safety.withdrawal_entries(withdrawals(spark)),
                             literal_rows=literal_rows)
    return m.select("doc_id", F.explode("matches").alias("m")).groupBy("m.drug", "m.jurisdiction").agg(F.count("*").alias("documents"))


def regulatory_join(spark, sf_dir):
    """Documents that mention each withdrawn drug in its withdrawn use."""
    return _regulatory(spark, sf_dir, safety.LITERAL_ROWS)


def regulatory_join_grams(spark, sf_dir):
    """The same through the gram join that serves large reference tables."""
    return _regulatory(spark, sf_dir, 0)


def _cards(spark, sf_dir):
    d = F.col("doc_id")
    p = V.papers(spark, sf_dir).join(V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole")), "doc_id")

    def drug(k: int):
        return F.struct(V.pick(DRUGS, d + k).alias("drug"),
                        F.when((d + k) % 3 != 0, "Curatif").alias("intent"), F.when((d + k) % 2 == 0, "A").alias("level"))

    return p.select(
        F.col("paper_key").alias("patient_id"), F.col("topic").alias("cancer_type"), F.col("whole").alias("clinical_history"),
        F.when(d % 4 != 0, "T2 [Doc 1]").otherwise("").alias("stage"), F.lit("Guide [Doc 2]").alias("guideline"),
        F.lit(None).cast("string").alias("comorbidities_impact"), F.lit(None).cast("string").alias("confidence"),
        F.when(d % 2 == 0, "High").alias("treatment_confidence"), F.array(drug(0), drug(1)).alias("treatment"),
        F.array(F.struct(F.lit("GAMMA").alias("key"), F.lit("Adjuvant").alias("intent")),
                F.struct(F.lit("alpha 10 mg [doc 1] extra").alias("key"), F.lit("Palliatif").alias("intent"))).alias("intent_map"),
        F.array(F.lit("x [Doc 2] y [Doc 9]"), F.lit("z [doc 1] [Doc 2]")).alias("sources"))


def _card_chunks(spark, sf_dir):
    """Two chunks for the card of every paper that states its sample size; the others have none."""
    p = V.papers(spark, sf_dir).where("sample_size is not null").join(
        V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole")), "doc_id")
    return p.select(F.col("paper_key").alias("patient_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"),
                    F.col("paper_key").alias("chunk_id"), F.col("whole").alias("text"), "title", "authors", "journal",
                    "year", "study_design", "sample_size", F.lit("abstract").alias("section"), "pmid")


def biomarker_join(spark, sf_dir):
    """Warnings on the treatments of every card, by kind and drug."""
    cards = safety.treatment_warnings(_cards(spark, sf_dir), withdrawals(spark), biomarkers(spark), "en")
    w = cards.select("patient_id", F.explode("treatment").alias("t")).select("patient_id", "t.drug", F.explode("t.warnings").alias("w"))
    return w.groupBy(F.col("w.type").alias("type"), F.col("w.drug").alias("drug"), F.col("w.jurisdiction").alias("jurisdiction"),
                     F.col("w.message").alias("message")).agg(F.count("*").alias("n"))


def card_finish(spark, sf_dir):
    """Finished cards: drugs, intents, levels, sources and warnings as text."""
    cards = finish_cards(_cards(spark, sf_dir), _card_chunks(spark, sf_dir), withdrawals(spark), biomarkers(spark),
                         "fr", keep_citations=True, disclose_fallback=True)
    drugs = F.array_join(F.transform("treatment", lambda t: F.concat_ws(
        "/", t["drug"], t["intent"], t["level"], F.size(t["warnings"]).cast("string"))), "; ")
    return cards.select("patient_id", drugs.alias("treatment"), "stage", "guideline", "confidence", "treatment_confidence",
                        F.array_join("sources", "; ").alias("sources"), "grounded",
                        F.col("chunks_used").cast("bigint").alias("chunks_used"))


def comorbidities(spark, sf_dir):
    """Comorbidity lines parsed from event properties and formatted again."""
    e = V.table(spark, sf_dir, "events")
    text = F.concat(F.lit(" "), "event_type", F.lit(": "), F.col("value").cast("int").cast("string"), F.lit("\nno colon\n: x\nflag:  \n"),
                    F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(":again: b"))).otherwise(""))
    m = R.comorbidity_map(text)
    return e.select("event_id", R.format_comorbidities(m, "en").alias("line"),
                    R.format_comorbidities(F.map_filter(m, lambda k, v: F.lit(False)), "en").alias("none"))


# --- judges and evaluation -----------------------------------------------------------

def judge_all(spark, sf_dir):
    """All metrics of every answered turn."""
    return judged(spark, sf_dir).select("query_id", *K.METRICS, F.round("overall", 10).alias("overall"))


def refusal_terms(spark, sf_dir):
    """Required terms and refusals per answered turn."""
    return judged(spark, sf_dir).select("query_id", "contains_required_terms", "is_refused")


def extractive_judge(spark, sf_dir):
    """Evaluation without a generator: the first chunk texts are the answer."""
    golden = V.answered(spark, sf_dir).select(
        F.col("query_id").alias("id"), F.col("question").alias("query"), "cancer_type", "difficulty", "question_type",
        "ground_truth", "must_contain_terms")
    res = run_evaluation(golden, V.evidence(spark, sf_dir)).results
    return res.select("query_id", "answer_relevance", "context_precision", "context_recall", F.md5("answer").alias("answer_md5"))


def eval_report(spark, sf_dir):
    """Mean metrics over all answers."""
    m = evaluate.mean_metrics(judged(spark, sf_dir))
    return m.select("total_queries", *[F.round(c, 10).alias(c) for c in [*K.METRICS, "overall"]])


def eval_grouped(spark, sf_dir):
    """Mean metrics by topic, difficulty, question type and overall."""
    g = evaluate.grouped_metrics(judged(spark, sf_dir))
    return g.select("facet", "value", "n", *[F.round(c, 10).alias(c) for c in [*K.METRICS, "overall"]])


def eval_labels(spark, sf_dir):
    """Answer metrics grouped by the quality label of the document with the conversation's number."""
    q = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    j = judged(spark, sf_dir).join(q, "conv_id", "left")
    return j.groupBy(F.col("quality").cast("bigint").alias("quality")).agg(
        F.count("*").alias("n"), F.round(F.avg("overall"), 10).alias("overall"))


def regression_gate(spark, sf_dir):
    """Hard questions against all others as baseline."""
    j = judged(spark, sf_dir)
    now = evaluate.mean_metrics(j.where("difficulty = 'hard'"))
    base = evaluate.mean_metrics(j.where("difficulty <> 'hard'")).drop("clinical_safety")
    g = evaluate.regression_gate(now, base)
    return g.select(*[F.round(c, 10).alias(c) for c in K.CORE_METRICS], "passed")


def threshold_gate(spark, sf_dir):
    """Facet means and latencies against floors and a ceiling."""
    t = spark.createDataFrame(
        [("all", "faithfulness", 0.8, "floor"), ("all", "answer_relevance", 0.75, "floor"),
         ("cancer_type", "faithfulness", 0.5, "floor"), ("latency", "p95", 95.0, "ceiling")],
        "facet string, metric string, bound double, kind string")
    lat = evaluate.latency_stats(V.table(spark, sf_dir, "events"), "value")
    out = evaluate.threshold_gate(evaluate.grouped_metrics(judged(spark, sf_dir)), lat, t)
    return out.select("facet", "value", "metric", F.round("actual", 10).alias("actual"), "bound", "passed")


# --- history and audit ------------------------------------------------------------------

def _turns(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), "role",
        F.col("text").alias("content"))


def history_first(spark, sf_dir):
    """The first four turns of each conversation and of those the last three."""
    h = context.history(_turns(spark, sf_dir), limit=4, last=3)
    return h.select("conversation_id", F.col("pos").cast("bigint").alias("pos"), "role", F.md5("content").alias("content_md5"))


def query_history(spark, sf_dir):
    """Every question with the first turns of its conversation attached."""
    q = V.answered(spark, sf_dir).select("query_id", F.col("conv_id").alias("conversation_id"))
    h = context.attach_history(q, _turns(spark, sf_dir), limit=4, last=3)
    return h.select("query_id", F.size("history").cast("bigint").alias("n"),
                    F.md5(F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("history_md5"))


def history_last(spark, sf_dir):
    """The last three turns of each conversation, oldest first."""
    h = context.history(_turns(spark, sf_dir), limit=3, mode="last")
    return h.select("conversation_id", F.col("pos").cast("bigint").alias("pos"), "role", F.md5("content").alias("content_md5"))


def conversation_append(spark, sf_dir):
    """Answered turns as the two rows each appends to the history."""
    a = V.answered(spark, sf_dir).select(
        "query_id", F.when(F.col("conv_id") % 5 != 0, F.col("conv_id")).alias("conversation_id"), "question", "answer")
    return context.conversation_turns(a).select("id", "conversation_id", F.col("ordinal").cast("bigint").alias("ordinal"), "role",
                                                F.md5("content").alias("content_md5"))


def audit_rows(spark, sf_dir):
    """Audit rows of every answered turn."""
    p = packed(spark, sf_dir)
    a = p.select(
        "query_id", F.lit("2024-01-01").cast("timestamp").alias("timestamp"), "question", F.lit(None).cast("string").alias("rewritten_query"),
        "answer", F.lit(0.5).alias("confidence"), F.lit("hedged").alias("gate_decision"), F.lit("m").alias("model"), F.lit("p").alias("provider"),
        F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.col("turn").cast("double").alias("retrieval_ms"),
        F.lit(2.5).alias("generation_ms"), F.lit("u").alias("user_id"), F.lit("s").alias("session_id"),
        C.hallucinated(F.col("answer"), F.size("chunks")).alias("hallucinated_citations"),
        F.transform("chunks", lambda c: F.struct(F.lit("1").alias("pmid"), F.lit("t").alias("title"), F.lit("abstract").alias("section"),
                                                 (c["evidence_level"] / 7).alias("relevance_score"))).alias("chunks"))
    return records.audit_rows(a).select(
        "query_id", "latency_ms", "flagged", F.array_join("hallucinated_citations", ",").alias("hallucinated"),
        F.array_join(F.transform("sources", lambda s: s["score"].cast("string")), ",").alias("scores"))


def card_audit(spark, sf_dir):
    """Audit rows of every card: short summary, size of the stored card, flag."""
    cards = finish_cards(_cards(spark, sf_dir), _card_chunks(spark, sf_dir), withdrawals(spark), biomarkers(spark), "en")
    out = records.card_audit_rows(cards.withColumns({
        "query_id": F.concat(F.lit("c"), "patient_id"), "grounded": F.lit(None).cast("boolean"), "confidence_score": F.lit(0.5)}))
    return out.select("query_id", F.md5("question").alias("question_md5"), F.get_json_object("answer", "$.stage").alias("stage"),
                      F.get_json_object("answer", "$.retrieval_metadata.chunks_used").alias("chunks_used"), "flagged")


def fenced_json(spark, sf_dir):
    """Event properties inside code fences, parsed; broken ones give an empty map."""
    e = V.table(spark, sf_dir, "events")
    text = F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 4 == 0, "broken").otherwise(F.col("props")), F.lit("\n```"))
    return e.select("event_id", R.fenced_json_map(text).alias("m")).select(
        "event_id", F.size("m").cast("bigint").alias("n"), F.try_element_at("m", F.lit("k")).alias("k"))


def payload_json(spark, sf_dir):
    """Labelled vectors as JSON payloads without null keys."""
    e = V.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", R.payload_json(F.struct(
        "vec_id", F.when(F.col("label") > 4, F.col("label")).alias("label"))).alias("payload"))


QUERIES = {f.__name__: f for f in (
    citation_split, citation_order, post_process, warning_append, warning_append_fr, regulatory_join, regulatory_join_grams,
    biomarker_join, card_finish, comorbidities, judge_all, refusal_terms, extractive_judge, eval_report, eval_grouped,
    eval_labels, regression_gate, threshold_gate, history_first, history_last, query_history, conversation_append, audit_rows, card_audit,
    fenced_json, payload_json)}


# --- SQL --------------------------------------------------------------------------------

def _q(text) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_WITHDRAWAL_ROWS = ", ".join(
    f"({i}, {_q(d)}, {V.sql_list([d, *a])}, {V.sql_list(k) if k else '[]::VARCHAR[]'}, {_q(j)}, {_q(w)}, {_q(f)})"
    for i, (d, a, k, j, w, f) in enumerate(WITHDRAWALS))
_BIOMARKER_ROWS = ", ".join(
    f"({i}, {_q(d)}, {V.sql_list(p)}, {V.sql_list(b)}, {V.sql_list(k) if k else '[]::VARCHAR[]'}, {_q(w)}, {_q(f)})"
    for i, (d, p, b, k, w, f) in enumerate(BIOMARKERS))


def _refs(lang: str) -> str:
    a, b = ("warning_fr", "warning") if lang == "fr" else ("warning", "warning_fr")
    msg = f"coalesce(nullif({a}, ''), nullif({b}, ''), '')"
    return f"""
wd_v AS (SELECT *, {msg} AS msg FROM (VALUES {_WITHDRAWAL_ROWS}) t(ord, drug, names, kws, jur, warning, warning_fr) WHERE {msg} <> ''),
bm_v AS (SELECT *, {msg} AS msg FROM (VALUES {_BIOMARKER_ROWS}) t(ord, drug, pats, bkws, kws, warning, warning_fr) WHERE {msg} <> '')"""


def _hit(names: str, text: str) -> str:
    return f"len(list_filter({names}, lambda n: n <> '' AND contains(lower({text}), lower(n)))) > 0"


def _any(kws: str, text: str) -> str:
    return f"(len({kws}) = 0 OR len(list_filter({kws}, lambda n: contains(lower({text}), lower(n)))) > 0)"


def _with(base: str, extra: str, body: str) -> str:
    head = sql(base, "").rstrip()
    return (head + ",\n" if head else "WITH ") + extra.strip() + "\n" + body.strip()


def _noted(src: str, key: str = "query_id") -> str:
    return f"""
noted_v AS (SELECT a.{key}, a.answer AS before, CASE WHEN count(w.ord) > 0 THEN rtrim(a.answer, chr(10) || ' ') || chr(10) || chr(10)
              || string_agg('{K.REGULATORY_NOTE}' || w.msg, chr(10) || chr(10) ORDER BY w.ord) ELSE a.answer END AS answer, count(w.ord) AS n_warnings
            FROM {src} a LEFT JOIN wd_v w ON {_hit('w.names', 'a.answer')} AND {_any('w.kws', 'a.answer')} GROUP BY a.{key}, a.answer)"""


def _bad(n: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '(?i)\\s*\\[Doc (\\d+)\\]', 1), lambda x: CAST(x AS BIGINT)), lambda x: x < 1 OR x > {n})))"


def _checked(n: str) -> str:
    tag = r"'(?i)\s*\[Doc (?:' || array_to_string(bad, '|') || ')\\]'".replace("\\\\", "\\")
    return f"""
bad_v AS (SELECT *, {_bad(n)} AS bad FROM src_v),
clean_v AS (SELECT * REPLACE (CASE WHEN len(bad) > 0 THEN 'WARNING: The following answer contained hallucinated citations ([Doc ' || array_to_string(bad, ', ')
             || ']) that were removed.' || chr(10) || chr(10) || trim(regexp_replace(answer, {tag}, '', 'g'), chr(10) || ' ') ELSE trim(answer, chr(10) || ' ') END AS answer) FROM bad_v),
cited_v AS (SELECT *, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(answer, '(?i)\\s*\\[Doc (\\d+)\\]', 1), lambda x: CAST(x AS BIGINT))),
              lambda x: NOT list_contains(bad, x))) AS citations FROM clean_v)"""


_STOP = V.sql_list(K.STOPWORDS)


def _terms(col: str) -> str:
    return (f"list_distinct(list_filter(list_transform(regexp_extract_all({col}, '[a-zA-Z]+'), lambda x: lower(x)),"
            f" lambda x: length(x) > 3 AND NOT list_contains({_STOP}, x)))")


def _sqlre(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _judge(src: str) -> str:
    return f"""
j1_v AS (SELECT *, list_transform(regexp_extract_all(answer, {_sqlre(K.CITATION_LOOSE)}, 1), lambda x: CAST(x AS BIGINT)) AS cites,
           {_terms('question')} AS qt, {_terms("coalesce(ground_truth, '')")} AS gt, lower(answer) AS low FROM {src}),
j2_v AS (SELECT *,
    CASE WHEN len(cites) = 0 THEN 0.85::DOUBLE ELSE round_even(len(list_filter(cites, lambda c: c BETWEEN 1 AND len(texts))) / len(cites), 4) END AS faithfulness,
    CASE WHEN len(qt) = 0 THEN 1.0::DOUBLE ELSE round_even(len(list_filter(qt, lambda t: contains(low, t))) / len(qt), 4) END AS answer_relevance,
    CASE WHEN len(texts) = 0 THEN 0.0::DOUBLE WHEN len(qt) = 0 THEN 1.0 ELSE
      round_even(len(list_filter(texts, lambda x: len(list_filter(qt, lambda t: contains(lower(x), t))) > 0)) / len(texts), 4) END AS context_precision,
    CASE WHEN len(gt) = 0 THEN 1.0::DOUBLE ELSE round_even(len(list_filter(gt, lambda t: contains(low, t))) / len(gt), 4) END AS context_recall,
    greatest(1.0::DOUBLE - least(0.5::DOUBLE * len(regexp_extract_all(answer, {_sqlre(K.DIRECTIVE)})), 1.0), 0.0) AS clinical_safety,
    CASE WHEN len(cites) = 0 THEN 1.0::DOUBLE ELSE round_even(len(list_filter(cites, lambda c: c BETWEEN 1 AND len(texts) AND trim(texts[c]) <> '')) / len(cites), 4) END AS citation_accuracy,
    CASE WHEN len(list_filter(levels, lambda l: l >= 4)) = 0 OR regexp_matches(answer, {_sqlre(K.HEDGE)}) THEN 1.0::DOUBLE ELSE 0.7 END AS evidence_appropriate
  FROM j1_v),
judged_v AS (SELECT *, (faithfulness + answer_relevance + context_precision + context_recall + clinical_safety) / 5 AS overall FROM j2_v)"""


_AVG = ", ".join(f"round(avg({m}), 10) AS {m}" for m in K.METRICS)
_OVER = "round((" + " + ".join(f"avg({m})" for m in K.CORE_METRICS) + ") / 5, 10) AS overall"
_CARD = f"""
card_v AS (SELECT doc_id, paper_key, topic, whole, lower(topic || ' ' || whole) AS ctx, sample_size IS NOT NULL AS grounded, k AS pos,
             {V.sql_pick(DRUGS, 'doc_id + k')} AS drug, CASE WHEN (doc_id + k) % 3 <> 0 THEN 'Curatif' END AS intent,
             CASE WHEN (doc_id + k) % 2 = 0 THEN 'A' END AS level, title, authors, journal, year, study_design, sample_size
           FROM papers_v JOIN (SELECT doc_id, text AS whole FROM documents) USING (doc_id), (VALUES (0), (1)) t(k))"""


def _warn(drug: str, lang: str) -> str:
    return _refs(lang) + "," + _CARD + f""",
warn_v AS (
  SELECT doc_id, pos, 'regulatory' AS type, w.drug, w.jur AS jurisdiction, w.msg AS message FROM (SELECT *, {drug} AS d FROM card_v) c
  JOIN wd_v w ON {_hit('w.names', 'c.d')} AND {_any('w.kws', 'c.ctx')}
  UNION ALL
  SELECT doc_id, pos, 'biomarker', b.drug, 'biomarker', b.msg FROM (SELECT *, {drug} AS d FROM card_v) c
  JOIN bm_v b ON {_hit('b.pats', 'c.d')} AND {_any('b.kws', 'c.ctx')} AND len(list_filter(b.bkws, lambda n: contains(c.ctx, lower(n)))) = 0)"""


_KEEP = r"trim(CASE WHEN grounded THEN regexp_replace(drug, '(?i)\s*\[Doc (?:7)\]', '', 'g') ELSE regexp_replace(drug, '(?i)\s*\[Doc (\d+)\]', '', 'g') END)"
_INTENT = """coalesce(CASE WHEN doc_id % 4 <> 0 AND (contains(lower(drug), 'gamma') OR contains('gamma', lower(drug))) THEN 'Adjuvant'
   WHEN doc_id % 4 <> 0 AND (contains(lower(drug), 'alpha 10 mg [doc 1] extra') OR contains('alpha 10 mg [doc 1] extra', lower(drug))) THEN 'Palliatif' ELSE intent END, 'Palliatif')"""
_HEADER = ("coalesce(nullif(concat_ws(' ', CASE WHEN len(authors) > 0 THEN string_split(authors[1], ' ')[1] || ' et al.' END,"
           " CASE WHEN year <> 0 THEN CAST(year AS VARCHAR) END, nullif(journal, '')), ''), nullif(title, ''), 'Unknown source')")
_SUFF = "concat_ws(', ', nullif(study_design, ''), CASE WHEN sample_size <> 0 THEN 'n=' || sample_size END)"
_LINE = f"{_HEADER} || CASE WHEN {_SUFF} <> '' THEN ' (' || {_SUFF} || ')' ELSE '' END"

ORACLE = {
    "citation_split": _with("qa_v", "src_v AS (SELECT query_id, answer FROM qa_v)," + _checked("3"), """
        SELECT query_id, array_to_string(citations, ',') AS citations, array_to_string(bad, ',') AS hallucinated, md5(answer) AS answer_md5 FROM cited_v"""),
    "citation_order": sql("qa_v", r"""
        SELECT query_id, coalesce((SELECT string_agg(n, ',' ORDER BY first) FROM (SELECT n, min(i) AS first FROM (
                 SELECT unnest(m) AS n, generate_subscripts(m, 1) AS i) WHERE CAST(n AS BIGINT) BETWEEN 1 AND 12 GROUP BY n)), '') AS mentioned,
               md5(trim(regexp_replace(answer, '(?i)\s*\[Doc (\d+)\]', '', 'g'), chr(10) || ' ')) AS bare_md5
        FROM (SELECT query_id, answer, list_concat(regexp_extract_all(answer, '(?i)\s*\[Doc (\d+)\]', 1), regexp_extract_all(question, '(?i)\s*\[Doc (\d+)\]', 1)) AS m FROM qa_v)"""),
    "warning_append": _with("qa_v", _refs("en") + "," + _noted("qa_v"), "SELECT query_id, md5(answer) AS answer_md5, n_warnings FROM noted_v"),
    "warning_append_fr": _with("qa_v", _refs("fr") + "," + _noted("qa_v"), "SELECT query_id, md5(answer) AS answer_md5, n_warnings FROM noted_v"),
    "regulatory_join": _with("", _refs("en"), f"""
        SELECT w.drug, w.jur AS jurisdiction, count(*) AS documents FROM documents d JOIN wd_v w ON {_hit('w.names', 'd.text')} AND {_any('w.kws', 'd.text')} GROUP BY ALL"""),
    "biomarker_join": _with("papers_v", _warn("drug", "en"), "SELECT type, drug, jurisdiction, message, count(*) AS n FROM warn_v GROUP BY ALL"),
    "card_finish": _with("papers_v", _warn(_KEEP, "fr"), f"""
        SELECT c.paper_key AS patient_id, string_agg({_KEEP} || '/' || {_INTENT} || '/' || coalesce(level, 'B') || '/' || coalesce(n, 0), '; ' ORDER BY c.pos) AS treatment,
               CASE WHEN c.doc_id % 4 <> 0 THEN 'T2' ELSE '' END AS stage, 'Guide' AS guideline, 'Modérée' AS confidence,
               CASE WHEN c.doc_id % 2 = 0 THEN 'High' ELSE 'Modérée' END AS treatment_confidence,
               CASE WHEN grounded THEN '[Doc 2] ' || any_value({_LINE}) || '; [Doc 1] ' || any_value({_LINE}) ELSE {_q(K.FALLBACK_DISCLOSURE['fr'])} END AS sources,
               grounded, CASE WHEN grounded THEN 2 ELSE 0 END::BIGINT AS chunks_used
        FROM card_v c LEFT JOIN (SELECT doc_id AS wd, pos AS wp, count(*) AS n FROM warn_v GROUP BY ALL) w ON wd = c.doc_id AND wp = c.pos
        GROUP BY c.paper_key, c.doc_id, grounded"""),
    "comorbidities": """
        SELECT event_id, event_type || ': ' || CASE WHEN event_id % 3 = 0 THEN 'again: b' ELSE CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) END || ', flag: yes' AS line,
               'No comorbidities specified' AS none FROM events""",
    "judge_all": _with("packed_v", _judge("packed_v"), f"SELECT query_id, {', '.join(K.METRICS)}, round(overall, 10) AS overall FROM judged_v"),
    "refusal_terms": sql("qa_v", f"""
        SELECT query_id, len(list_filter(must_contain_terms, lambda t: NOT contains(lower(answer), lower(t)))) = 0 AS contains_required_terms,
               {' OR '.join(f"contains(lower(answer), {_q(m)})" for m in K.REFUSAL_MARKERS)} AS is_refused FROM qa_v"""),
    "extractive_judge": _with("packed_v", "x_v AS (SELECT * REPLACE (array_to_string(texts[1:3], ' ') AS answer) FROM packed_v)," + _judge("x_v"), """
        SELECT query_id, answer_relevance, context_precision, context_recall, md5(answer) AS answer_md5 FROM judged_v"""),
    "eval_report": _with("packed_v", _judge("packed_v"), f"SELECT count(*) AS total_queries, {_AVG}, {_OVER} FROM judged_v"),
    "eval_grouped": _with("packed_v", _judge("packed_v"), " UNION ALL ".join(
        f"SELECT '{facet}' AS facet, {col} AS value, count(*) AS n, {_AVG}, {_OVER} FROM judged_v GROUP BY ALL"
        for facet, col in [("all", "NULL::VARCHAR"), ("cancer_type", "cancer_type"), ("difficulty", "difficulty"), ("question_type", "question_type")])),
    "eval_labels": _with("packed_v", _judge("packed_v"), """
        SELECT quality::BIGINT AS quality, count(*) AS n, round(avg(overall), 10) AS overall FROM judged_v LEFT JOIN labels ON doc_id = conv_id GROUP BY 1"""),
    "regression_gate": _with("packed_v", _judge("packed_v") + ",\n" + "delta_v AS (SELECT " + ", ".join(
        f"avg({m}) FILTER (difficulty = 'hard') - " + ("0" if m == "clinical_safety" else f"avg({m}) FILTER (difficulty <> 'hard')") + f" AS {m}"
        for m in K.CORE_METRICS) + " FROM judged_v)",
        "SELECT " + ", ".join(f"round({m}, 10) AS {m}" for m in K.CORE_METRICS) + ", "
        + " AND ".join(f"{m} >= -0.02" for m in K.CORE_METRICS) + " AS passed FROM delta_v"),
    "threshold_gate": _with("packed_v", _judge("packed_v"), """
        SELECT facet, value, metric, round(actual, 10) AS actual, bound, CASE WHEN metric = 'p95' THEN actual <= bound ELSE actual >= bound END AS passed FROM (
          SELECT 'all' AS facet, NULL::VARCHAR AS value, 'faithfulness' AS metric, avg(faithfulness) AS actual, 0.8::DOUBLE AS bound FROM judged_v
          UNION ALL SELECT 'all', NULL, 'answer_relevance', avg(answer_relevance), 0.75::DOUBLE FROM judged_v
          UNION ALL SELECT 'cancer_type', cancer_type, 'faithfulness', avg(faithfulness), 0.5::DOUBLE FROM judged_v GROUP BY cancer_type
          UNION ALL SELECT 'latency', NULL, 'p95', list(value ORDER BY value)[least(CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT), count(*) - 1) + 1], 95.0::DOUBLE FROM events)"""),
    "history_first": """
        SELECT conv_id AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, md5(text) AS content_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM (
          SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4)) WHERE z <= 3""",
    "query_history": sql("qa_v", """
        SELECT query_id, n, history_md5 FROM qa_v JOIN (
          SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS history_md5
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM (
            SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4)) WHERE z <= 3 GROUP BY conv_id) USING (conv_id)"""),
    "history_last": """
        SELECT conv_id AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, md5(text) AS content_md5
        FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)""",
    "conversation_append": sql("qa_v", """
        SELECT query_id || '-0' AS id, conv_id AS conversation_id, 0::BIGINT AS ordinal, 'user' AS role, md5(question) AS content_md5 FROM qa_v WHERE conv_id % 5 <> 0
        UNION ALL SELECT query_id || '-1', conv_id, 1, 'assistant', md5(answer) FROM qa_v WHERE conv_id % 5 <> 0"""),
    "audit_rows": sql("packed_v", f"""
        SELECT query_id, turn + 2.5::DOUBLE AS latency_ms, len(bad) > 0 AS flagged, array_to_string(bad, ',') AS hallucinated,
               array_to_string(list_transform(levels, lambda l: CAST(round(l / 7, 4) AS VARCHAR)), ',') AS scores
        FROM (SELECT *, {_bad('len(texts)')} AS bad FROM packed_v)"""),
    "card_audit": sql("papers_v", """
        SELECT 'c' || paper_key AS query_id, md5('[treatment-card] patient=' || paper_key || ': ' || left(whole, 500)) AS question_md5,
               CASE WHEN doc_id % 4 <> 0 THEN 'T2' ELSE '' END AS stage, CASE WHEN sample_size IS NOT NULL THEN '2' ELSE '0' END AS chunks_used,
               sample_size IS NULL AS flagged FROM papers_v JOIN (SELECT doc_id, text AS whole FROM documents) USING (doc_id)"""),
    "fenced_json": """
        SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN event_id % 4 <> 0 THEN props ->> '$.k' END AS k FROM events""",
    "payload_json": """
        SELECT vec_id, '{"vec_id":' || vec_id || CASE WHEN label > 4 THEN ',"label":' || label ELSE '' END || '}' AS payload FROM embeddings""",
}
ORACLE["regulatory_join_grams"] = ORACLE["regulatory_join"]

from litspark.queries.retrieval import _conf as _confidence  # noqa: E402  the shared confidence SQL

ORACLE["post_process"] = _with(
    "qa_v ev_v", _confidence("NOT coalesce(list_contains(topics, cancer_type), false)", "ev_v", "qa_v") + ",\n" + """
num_v AS (SELECT query_id, count(*) AS num FROM ev_v GROUP BY query_id),
src_v AS (SELECT query_id, answer, answer AS raw, coalesce(num, 0) AS num, gate FROM qa_v LEFT JOIN num_v USING (query_id) JOIN conf_v USING (query_id)),
""" + _checked("num") + """,
settled_v AS (SELECT query_id, gate, CASE WHEN gate = 'refused' THEN raw ELSE answer END AS answer, CASE WHEN gate = 'refused' THEN [] ELSE citations END AS citations FROM cited_v),
""" + _refs("en") + "," + _noted("settled_v"), """
        SELECT n.query_id, md5(n.answer) AS answer_md5, gate, n_warnings, array_to_string(citations, ',') AS citations
        FROM noted_v n JOIN settled_v s USING (query_id)""")
