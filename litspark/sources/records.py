"""Mappings between record layouts, and append sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.records import as_array, month_of, safe_int
from litspark.functions.text import or_else
from litspark.operators.filters import oncology_voluntary


def eav_values(embeddings: DataFrame, metadata: DataFrame) -> DataFrame:
    """``(embedding_id, key, value)``: the string if not empty, else the integer, else the float."""
    value = F.coalesce(F.nullif(F.col("string_value"), F.lit("")), F.col("int_value").cast("string"),
                       F.col("float_value").cast("string"))
    return embeddings.join(metadata, "id").select("embedding_id", "key", value.alias("value"))


def eav_pivot(embeddings: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """One wide row per embedding id. ``keys`` are named, so no extra job finds them."""
    return eav_values(embeddings, metadata).groupBy("embedding_id").pivot("key", keys).agg(F.max("value"))


LEGACY_KEYS = ["pmc_id", "pmid", "title", "journal", "year", "section_name", "topic", "chunk_index",
               "total_chunks", "doi", "chroma:document"]


def open_metadata(embeddings: DataFrame, metadata: DataFrame) -> DataFrame:
    """``embedding_id, meta``: all metadata of a record as one VARIANT object, whatever its keys.

    A key's value is its first filled one: text, number, fraction; repeated keys keep
    the largest. Unknown keys survive, and their types can be read off with
    ``schema_of_variant_agg``. Records without metadata have an empty object.
    """
    def json(column: str) -> Column:
        whole = F.to_json(F.struct(F.col(column).alias("v")))
        return F.substr(whole, F.lit(6), F.length(whole) - 6)

    value = F.coalesce(F.when(F.col("string_value") != "", json("string_value")), F.when(F.col("int_value").isNotNull(), json("int_value")),
                       F.when(F.col("float_value").isNotNull(), json("float_value")))
    pairs = metadata.where(F.col("key").isNotNull() & value.isNotNull()).groupBy("id", "key").agg(F.max(value).alias("_value"))
    made = pairs.select("id", F.concat(json("key"), F.lit(":"), "_value").alias("_pair"))
    objects = made.groupBy("id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("_pair")), ","), F.lit("}")).alias("_object"))
    return embeddings.join(objects, "id", "left").select("embedding_id", F.parse_json(F.coalesce("_object", F.lit("{}"))).alias("meta"))


def current_payload(wide: DataFrame, text_cut: int | None = None) -> DataFrame:
    """Chunk rows of the current layout from pivoted older records; ``text_cut`` cuts the texts."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`"), F.lit(""))

    topic = F.nullif(text("topic"), F.lit(""))
    return wide.select(
        F.col("embedding_id").alias("chunk_id"), (text("chroma:document") if text_cut is None else F.left(text("chroma:document"), F.lit(text_cut))).alias("text"),
        text("pmc_id").alias("pmcid"), text("pmid").alias("pmid"), text("title").alias("title"),
        text("journal").alias("journal"), safe_int(F.col("year")).alias("year"),
        text("section_name").alias("section"), text("topic").alias("topic"), as_array(topic).alias("cancer_type"),
        safe_int(F.col("chunk_index")).alias("chunk_index"), safe_int(F.col("total_chunks")).alias("total_chunks"),
        text("doi").alias("doi"), F.lit("unknown").alias("study_design"),
        F.lit(K.DEFAULT_EVIDENCE_LEVEL).alias("evidence_level"), F.lit("text").alias("chunk_type"))


def external_evidence(abstracts: DataFrame) -> DataFrame:
    """Chunk rows from searched abstracts ``(query_id, rank, pmid, title, abstract, year)``.

    Records without an abstract are dropped.
    """
    title = F.coalesce("title", F.lit(""))
    return abstracts.where(F.coalesce(F.col("abstract"), F.lit("")) != "").select(
        "query_id", "rank", F.concat(F.lit("pubmed:"), F.col("pmid").cast("string")).alias("chunk_id"),
        F.concat(title, F.lit("\n\n"), "abstract").alias("text"),
        F.lit(K.CONFIDENCE_LOW).alias("score"), F.lit(K.CONFIDENCE_LOW).alias("relevance_score"),
        title.alias("title"), F.col("pmid").cast("string").alias("pmid"),
        F.when(F.col("year").cast("string").rlike(r"^[0-9]+$"), F.col("year").try_cast("int")).alias("year"),
        F.lit("web_search").alias("study_design"), F.lit("abstract").alias("section"))


def enforcement_entries(records: DataFrame) -> DataFrame:
    """Withdrawal entries from enforcement records; only voluntary oncology ones."""
    drug = F.lower("drug")
    date = month_of(F.coalesce("recall_initiation_date", F.lit("")))
    reason = F.regexp_replace(
        F.left(F.coalesce("reason_for_recall", F.lit("No reason provided")), F.lit(200)), r"\.+$", "")
    status = F.when(F.col("status") == "Terminated", "withdrawn").otherwise("recalled")
    none = F.array().cast("array<string>")
    return oncology_voluntary(records).select(
        *[c for c in ("seq",) if c in records.columns],
        drug.alias("drug"), none.alias("aliases"), F.lit("see product description").alias("indication"),
        none.alias("indication_keywords"), F.lit("FDA").alias("jurisdiction"), status.alias("status"),
        date.alias("date"),
        F.concat(F.initcap("drug"), F.lit(" — FDA voluntary action ("), date, F.lit("): "), reason,
                 F.lit(". Verify current regulatory status before recommending.")).alias("warning"),
        F.lit("openfda_api").alias("source"),
        F.left(F.coalesce("product_description", F.lit("")), F.lit(300)).alias("raw_description"))


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds concatenated; columns a feed lacks are null."""
    first, *rest = feeds
    for feed in rest:
        first = first.unionByName(feed, allowMissingColumns=True)
    return first


def audit_rows(answered: DataFrame) -> DataFrame:
    """Audit rows of answered queries.

    ``answered`` has the answer fields and ``chunks`` in rank order with
    ``pmid, title, section, relevance_score``. Latency is the retrieval total
    plus generation time.
    """
    sources = F.transform("chunks", lambda c: F.struct(
        c["pmid"].alias("pmid"), c["title"].alias("title"), c["section"].alias("section"),
        F.round(c["relevance_score"], 4).alias("score")))
    hallucinated = F.coalesce("hallucinated_citations", F.array().cast("array<bigint>"))
    return answered.select(
        "query_id", "timestamp", "question", "rewritten_query", "answer", "confidence", "gate_decision",
        "model", "provider", "input_tokens", "output_tokens",
        (F.coalesce("retrieval_ms", F.lit(0.0)) + F.coalesce("generation_ms", F.lit(0.0))).alias("latency_ms"),
        sources.alias("sources"), "user_id", "session_id",
        hallucinated.alias("hallucinated_citations"), (F.size(hallucinated) > 0).alias("flagged"))


def card_audit_rows(cards: DataFrame) -> DataFrame:
    """Audit rows of finished cards: a short summary as question, the card as JSON answer."""
    grounded = F.coalesce("grounded", F.col("chunks_used") > 0)
    card = F.struct(
        "stage", "confidence", "guideline", "comorbidities_impact", "treatment", "treatment_confidence", "sources",
        F.struct("chunks_used", grounded.alias("grounded"), "confidence_score").alias("retrieval_metadata"))
    return cards.select(
        "query_id", F.concat(F.lit("[treatment-card] patient="), F.col("patient_id").cast("string"), F.lit(": "),
                             F.left(F.coalesce("clinical_history", F.lit("")), F.lit(500))).alias("question"),
        F.to_json(card).alias("answer"), F.col("confidence_score").alias("confidence"),
        F.col("sources_detail").alias("sources"), F.array().cast("array<bigint>").alias("hallucinated_citations"),
        (~grounded).alias("flagged"))


def append_by_day(rows: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Insert-only append, partitioned by day."""
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def commit_state(papers: DataFrame, path: str) -> None:
    """Record papers as ingested; call only after their data is written."""
    papers.select("paper_key", "topic", F.current_timestamp().alias("committed_at")).write.mode("append").parquet(path)


def append_rejections(rejected: DataFrame, path: str) -> None:
    rejected.write.mode("append").parquet(path)


def evaluation_rows(results: DataFrame, answer_cut: int | None = None) -> DataFrame:
    """Detail rows of an evaluation report; ``answer_cut`` cuts the stored answer for display."""
    return results if answer_cut is None else results.withColumn("answer", F.left("answer", F.lit(answer_cut)))


def write_report(results: DataFrame, summary: DataFrame, path: str, run_id: str, answer_cut: int | None = None) -> None:
    """Detail rows and a one-row summary per run, and the summary again as ``latest``."""
    evaluation_rows(results, answer_cut).write.mode("overwrite").json(f"{path}/{run_id}/detailed")
    stamped = summary.withColumn("run_id", F.lit(run_id)).withColumn("timestamp", F.current_timestamp())
    stamped.write.mode("overwrite").json(f"{path}/{run_id}/metrics")
    stamped.write.mode("overwrite").json(f"{path}/latest")


def paper_key(raw: Column) -> Column:
    """Canonical paper key: trimmed id without its ``PMC`` prefix."""
    return F.regexp_replace(F.trim(or_else(raw, F.lit(""))), "^PMC", "")
