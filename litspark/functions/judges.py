"""Deterministic answer judges as column expressions.

``chunks`` is an array of structs with at least ``text`` and
``evidence_level``, in rank order; it holds the few chunks one answer cites.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.binding import let
from litspark.functions.citations import cited_loose, in_range
from litspark.functions.text import is_blank, key_terms


def _share(hits: Column, total: Column, empty: float) -> Column:
    return F.when(total == 0, F.lit(empty)).otherwise(F.bround(hits / total, 4))


def _covered(terms: Column, text: Column, empty: float) -> Column:
    return let(
        F.struct(terms.alias("terms"), F.lower(text).alias("low")),
        lambda v: _share(F.size(F.filter(v["terms"], lambda t: v["low"].contains(t))), F.size(v["terms"]), empty))


def faithfulness(answer: Column, chunks: Column) -> Column:
    return let(cited_loose(answer), lambda cites: _share(
        F.size(F.filter(cites, lambda n: in_range(n, F.size(chunks)))), F.size(cites), 0.85))


def answer_relevance(question: Column, answer: Column) -> Column:
    return _covered(key_terms(question), answer, 1.0)


def context_precision(question: Column, chunks: Column) -> Column:
    def precision(terms: Column) -> Column:
        low = F.transform(chunks, lambda c: F.lower(F.coalesce(c["text"], F.lit(""))))
        hit = F.filter(low, lambda text: F.exists(terms, lambda t: text.contains(t)))
        return (
            F.when(F.size(chunks) == 0, F.lit(0.0))
            .when(F.size(terms) == 0, F.lit(1.0))
            .otherwise(F.bround(F.size(hit) / F.size(chunks), 4))
        )

    return let(key_terms(question), precision)


def context_recall(answer: Column, ground_truth: Column) -> Column:
    return _covered(key_terms(F.coalesce(ground_truth, F.lit(""))), answer, 1.0)


def clinical_safety(answer: Column) -> Column:
    hits = F.regexp_count(answer, F.lit(K.DIRECTIVE))
    return F.round(F.greatest(F.lit(1.0) - F.least(hits * 0.5, F.lit(1.0)), F.lit(0.0)), 4)


def citation_accuracy(answer: Column, chunks: Column) -> Column:
    filled = F.transform(chunks, lambda c: ~is_blank(c["text"]))

    def accuracy(v: Column) -> Column:
        good = F.filter(
            v["cites"], lambda n: F.when(in_range(n, F.size(v["filled"])),
                                         F.get(v["filled"], (n - 1).cast("int"))).otherwise(F.lit(False)))
        return _share(F.size(good), F.size(v["cites"]), 1.0)

    return let(F.struct(cited_loose(answer).alias("cites"), filled.alias("filled")), accuracy)


def evidence_appropriate(answer: Column, chunks: Column) -> Column:
    weak = F.exists(chunks, lambda c: F.coalesce(c["evidence_level"], F.lit(1)) >= 4)
    return F.when(~weak | answer.rlike(K.HEDGE), F.lit(1.0)).otherwise(F.lit(0.7))


def overall(*core: Column) -> Column:
    total = core[0]
    for metric in core[1:]:
        total = total + metric
    return total / float(len(core))


def all_metrics(question: Column, answer: Column, chunks: Column, ground_truth: Column) -> dict[str, Column]:
    return {
        "faithfulness": faithfulness(answer, chunks),
        "answer_relevance": answer_relevance(question, answer),
        "context_precision": context_precision(question, chunks),
        "context_recall": context_recall(answer, ground_truth),
        "clinical_safety": clinical_safety(answer),
        "citation_accuracy": citation_accuracy(answer, chunks),
        "evidence_appropriate": evidence_appropriate(answer, chunks),
    }


def extractive_answer(texts: Column, keep: int = 3) -> Column:
    """Answer used when no generator is supplied: the first chunk texts joined."""
    return F.array_join(F.transform(F.slice(texts, 1, keep), lambda t: F.coalesce(t, F.lit(""))), " ")


def contains_all(answer: Column, terms: Column) -> Column:
    wanted = F.coalesce(terms, F.array().cast("array<string>"))
    return let(F.lower(answer), lambda low: F.forall(wanted, lambda t: low.contains(F.lower(t))))


def is_refusal(answer: Column) -> Column:
    return let(F.lower(answer), lambda low: reduce(
        lambda hit, marker: hit | low.contains(marker), K.REFUSAL_MARKERS, F.lit(False)))
