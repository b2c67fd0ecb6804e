"""Treatment card post-processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions import citations as C
from litspark.functions.binding import let
from litspark.operators.safety import treatment_warnings

CHUNK_FIELDS = ["chunk_id", "text", "title", "authors", "journal", "year", "study_design", "sample_size",
                "section", "pmid"]


def _intent(drug: Column, intent_map: Column, given: Column) -> Column:
    """First map entry whose key contains the drug or is contained in it wins."""
    entries = F.coalesce(intent_map, F.array().cast("array<struct<key:string,intent:string>>"))
    hits = let(F.lower(F.coalesce(drug, F.lit(""))), lambda low: F.filter(
        entries, lambda e: low.contains(F.lower(e["key"])) | F.lower(e["key"]).contains(low)))
    return let(hits, lambda h: F.when(F.size(h) > 0, F.get(h, F.lit(0))["intent"]).otherwise(given))


def reclassify_intents(cards: DataFrame) -> DataFrame:
    """Set each treatment's intent from ``intent_map``, when a stage and a drug are given."""
    usable = F.coalesce(F.col("stage") != "", F.lit(False)) & F.exists(
        "treatment", lambda t: F.coalesce(t["drug"], F.lit("")) != "")
    return cards.withColumn("treatment", F.when(usable, F.transform(
        "treatment", lambda t: F.struct(
            t["drug"].alias("drug"), _intent(t["drug"], F.col("intent_map"), t["intent"]).alias("intent"),
            t["level"].alias("level")))).otherwise(F.col("treatment")))


def finish_cards(cards: DataFrame, ranked: DataFrame, withdrawals: DataFrame, biomarkers: DataFrame,
                 language: str = "fr", keep_citations: bool = False, disclose_fallback: bool = False) -> DataFrame:
    """Intents, citation tags, defaults, safety warnings, grounded sources, disclosure.

    ``cards(patient_id, cancer_type, clinical_history, stage, guideline,
    comorbidities_impact, confidence, treatment_confidence, treatment, intent_map,
    sources)``; ``ranked(patient_id, rank, <chunk fields>)`` holds each card's chunks.
    """
    labels = K.CARD_LABELS.get(language, K.CARD_LABELS["fr"])
    have = [c for c in CHUNK_FIELDS if c in ranked.columns]
    packed = ranked.groupBy("patient_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.struct(*have).alias("c")))), lambda x: x["c"]).alias("chunks"))
    joined = reclassify_intents(cards).join(packed, "patient_id", "left")
    none = F.array().cast(packed.schema["chunks"].dataType)
    joined = joined.withColumn("chunks", F.coalesce("chunks", none)).withColumn("chunks_used", F.size("chunks"))
    n = F.col("chunks_used")

    def tags(text: Column) -> Column:
        plain = F.coalesce(text, F.lit(""))
        return C.strip_invalid_tags(plain, n) if keep_citations else C.strip_all_tags(plain)

    named = joined.withColumn("treatment", F.transform("treatment", lambda t: F.struct(
        tags(t["drug"]).alias("drug"), F.coalesce(t["intent"], F.lit(labels["intent"])).alias("intent"),
        F.coalesce(t["level"], F.lit("B")).alias("level"))))
    for field in ("stage", "guideline", "comorbidities_impact"):
        named = named.withColumn(field, C.strip_all_tags(F.coalesce(field, F.lit(""))))
    for field in ("confidence", "treatment_confidence"):
        named = named.withColumn(field, F.coalesce(field, F.lit(labels["confidence"])))
    given = F.coalesce("sources", F.array().cast("array<string>"))
    if keep_citations:
        sources = F.transform(C.first_mentions(given, n), lambda i: _grounded(F.get(F.col("chunks"), (i - 1).cast("int")), i))
    else:
        sources = F.transform(given, C.strip_all_tags)
    sourced = named.withColumn("sources", sources).withColumn(
        "sources_detail", F.transform("chunks", C.source_detail))
    warned = treatment_warnings(sourced, withdrawals, biomarkers, language)
    if disclose_fallback:
        text = F.lit(K.FALLBACK_DISCLOSURE.get(language, K.FALLBACK_DISCLOSURE["fr"]))
        grounded = F.col("chunks_used") > 0
        warned = (
            warned.withColumn("grounded", grounded)
            .withColumn("sources", F.when(grounded, F.col("sources")).otherwise(F.array(text)))
            .withColumn("sources_detail", F.when(grounded, F.col("sources_detail")).otherwise(
                F.array(C.disclosure_detail(text))))
        )
    return warned.drop("chunks", "intent_map")


def _grounded(c: Column, n: Column) -> Column:
    return C.source_line(n, c["authors"], c["year"], c["journal"], c["title"], c["study_design"], c["sample_size"])


