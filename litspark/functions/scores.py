"""Scores and weights as arithmetic over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark import constants as K


def _lookup(table: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def evidence_level(design: Column) -> Column:
    return _lookup(K.EVIDENCE_LEVELS, design, K.DEFAULT_EVIDENCE_LEVEL)


def design_weight(design: Column) -> Column:
    return _lookup(K.DESIGN_WEIGHTS, design, K.DEFAULT_DESIGN_WEIGHT)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two equally long float arrays; null for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norm, F.lit(0.0))


def unit(a: Column) -> Column:
    """``a`` scaled to length one, done once at write time."""
    norm = F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / norm)


def idf(n_docs: Column, doc_freq: Column) -> Column:
    """Robertson inverse document frequency, not below zero."""
    return F.greatest(F.ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)), F.lit(0.0))


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K.BM25_K1, b: float = K.BM25_B) -> Column:
    return tf / (tf + k1 * (1 - b + b * dl / avgdl))


def rrf(rank_a: Column, rank_b: Column, k: int = K.RRF_K) -> Column:
    return F.lit(1.0) / (rank_a + k) + F.lit(1.0) / (rank_b + k)


def recency_weight(year: Column, now_year: int) -> Column:
    age = F.lit(now_year) - year
    return (
        F.when(year.isNull() | (year == 0), 0.75)
        .when(age <= 2, 1.0).when(age <= 5, 0.9).when(age <= 10, 0.8).when(age <= 15, 0.7)
        .otherwise(0.6)
    )


def trial_boost(design: Column, year: Column, now_year: int) -> Column:
    recent = (design == "rct") & (year != 0) & (F.lit(now_year) - year <= 2)
    return F.when(recent, 1.1).otherwise(1.0)


def final_score(relevance: Column, design: Column, year: Column, now_year: int) -> Column:
    """Relevance weighted by study design and recency."""
    return (
        F.pow(relevance, F.lit(0.70))
        * F.pow(design_weight(design), F.lit(0.15))
        * F.pow(recency_weight(year, now_year) * trial_boost(design, year, now_year), F.lit(0.15))
    )


def gate(score: Column) -> Column:
    return (
        F.when(score >= K.CONFIDENCE_HIGH, "high")
        .when(score >= K.CONFIDENCE_LOW, "hedged")
        .when(score >= K.CONFIDENCE_REFUSE, "caveated")
        .otherwise("refused")
    )


def evidence_quality(score: Column) -> Column:
    """Stored form of the gate: a refused answer is stored as ``insufficient``."""
    decided = gate(score)
    return F.when(decided == "refused", "insufficient").otherwise(decided)


def embedding_cost(n_words: Column) -> Column:
    return n_words * K.TOKENS_PER_WORD / 1000 * K.COST_PER_1K_TOKENS


def legacy_embedding_cost(n_chunks: Column) -> Column:
    return n_chunks * K.LEGACY_TOKENS_PER_CHUNK * K.COST_PER_1K_TOKENS / 1000
