"""Chunk metadata filters and row gates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.text import is_blank

FILTER_SCHEMA = (
    "cancer_type array<string>, section array<string>, study_design array<string>, "
    "chunk_type array<string>, year_min int, year_max int, evidence_level_max int"
)


@dataclass(frozen=True)
class ChunkFilter:
    """One request's filter. Empty tuples and ``None`` mean no condition."""

    cancer_type: tuple[str, ...] = field(default=())
    section: tuple[str, ...] = field(default=())
    study_design: tuple[str, ...] = field(default=())
    chunk_type: tuple[str, ...] = field(default=())
    year_min: int | None = None
    year_max: int | None = None
    evidence_level_max: int | None = None

    def condition(self, null_passes: bool = False) -> Column:
        """Predicate over chunk columns.

        ``null_passes`` is the keyword-search rule: a chunk without a year or
        evidence level is kept. Dense search drops it, as SQL ranges do.
        """
        parts: list[Column] = []
        if self.cancer_type:
            parts.append(F.arrays_overlap(
                F.coalesce(F.col("cancer_type"), F.array().cast("array<string>")),
                F.array(*map(F.lit, self.cancer_type))))
        for name in ("section", "study_design", "chunk_type"):
            allowed = getattr(self, name)
            if allowed:
                parts.append(F.coalesce(F.col(name).isin(list(allowed)), F.lit(False)))

        def ranged(column: str, test: Column) -> Column:
            return (F.col(column).isNull() | test) if null_passes else test

        if self.year_min is not None:
            parts.append(ranged("year", F.col("year") >= self.year_min))
        if self.year_max is not None:
            parts.append(ranged("year", F.col("year") <= self.year_max))
        if self.evidence_level_max is not None:
            parts.append(ranged("evidence_level", F.col("evidence_level") <= self.evidence_level_max))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def query_filter_condition(null_passes: bool = False, prefix: str = "f_") -> Column:
    """Per-query form: filter values are columns ``f_cancer_type``, ``f_year_min``, …

    A null or empty filter column puts no condition on the chunk.
    """
    def col(name: str) -> Column:
        return F.col(prefix + name)

    def open_(name: str) -> Column:
        return col(name).isNull() | (F.size(col(name)) == 0)

    kinds = [F.coalesce(F.array_contains(col(n), F.col(n)), F.lit(False)) | open_(n)
             for n in ("section", "study_design", "chunk_type")]
    topics = open_("cancer_type") | F.coalesce(
        F.arrays_overlap(F.col("cancer_type"), col("cancer_type")), F.lit(False))

    def ranged(name: str, test: Column, bound: str) -> Column:
        inside = F.coalesce(test, F.lit(False))
        if null_passes:
            inside = inside | F.col(name).isNull()
        return col(bound).isNull() | inside

    ranges = [
        ranged("year", F.col("year") >= col("year_min"), "year_min"),
        ranged("year", F.col("year") <= col("year_max"), "year_max"),
        ranged("evidence_level", F.col("evidence_level") <= col("evidence_level_max"),
               "evidence_level_max"),
    ]
    return reduce(lambda a, b: a & b, [topics, *kinds, *ranges])


def with_filter_columns(queries: DataFrame, prefix: str = "f_") -> DataFrame:
    """Add the filter columns a query table lacks, as no condition."""
    for field_ in FILTER_SCHEMA.split(", "):
        name, kind = field_.split(" ", 1)
        if prefix + name not in queries.columns:
            queries = queries.withColumn(prefix + name, F.lit(None).cast(kind))
    return queries


def request_filters(requests: DataFrame, prefix: str = "f_") -> DataFrame:
    """Turn request fields into filter columns; empty lists become no condition."""
    def listed(name: str) -> Column:
        return F.when(F.size(F.col(name)) > 0, F.col(name)).alias(prefix + name.removesuffix("s"))

    return requests.select(
        "query_id", "question",
        *map(listed, ("cancer_types", "sections", "study_designs", "chunk_types")),
        F.col("year_from").alias(prefix + "year_min"), F.col("year_to").alias(prefix + "year_max"),
        F.col("evidence_level_max").alias(prefix + "evidence_level_max"),
    )


def grade(ranked: DataFrame, floor: float = K.CONFIDENCE_LOW) -> DataFrame:
    """Keep chunks whose relevance reaches ``floor``."""
    return ranked.where(F.col("relevance_score") >= floor)


def full_text_only(papers: DataFrame) -> DataFrame:
    """Papers with more than one section; an empty body falls back to the abstract."""
    fallback = F.when(
        (F.size("sections") == 0) & (F.coalesce(F.col("abstract"), F.lit("")) != ""),
        F.array(F.struct(F.lit("Abstract").alias("section_name"), F.col("abstract").alias("content"))),
    ).otherwise(F.col("sections"))
    return papers.withColumn("sections", fallback).where(F.size("sections") > 1)


def oncology_voluntary(records: DataFrame) -> DataFrame:
    """Enforcement records that concern oncology and were voluntary."""
    blank = F.lit("")
    text = F.lower(F.concat_ws(" ", F.coalesce("product_description", blank),
                               F.coalesce("reason_for_recall", blank)))
    topical = reduce(lambda a, b: a | b, [text.contains(k) for k in K.ONCOLOGY_KEYWORDS])
    voluntary = F.lower(F.coalesce("voluntary_mandated", blank)).contains("voluntary")
    return records.where(topical & voluntary)


def valid_entries(entries: DataFrame) -> DataFrame:
    """Reference entries that name a drug and carry a warning."""
    return entries.where(~is_blank(F.col("drug")) & ~is_blank(F.col("warning")))


def suppress_weak(answers: DataFrame, floor: float = K.CONFIDENCE_REFUSE) -> DataFrame:
    """Empty the ``chunks`` array where retrieval confidence is below ``floor``."""
    kept = F.when(F.col("retrieval_confidence") < floor, F.slice("chunks", 1, 0)).otherwise(F.col("chunks"))
    return answers.withColumn("chunks", kept)
