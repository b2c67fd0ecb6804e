"""Paper quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.text import is_blank, word_count


def score_papers(papers: DataFrame) -> DataFrame:
    """Add ``score``, ``passed`` and ``reasons``.

    Five weighted checks on the abstract and the body sections, all row-local
    because a paper carries its sections. A paper without findings never passes.
    """
    body = F.filter("sections", lambda s: s["name"] != "abstract")
    abstract_words = word_count(F.coalesce("abstract", F.lit("")))
    body_words = F.aggregate(
        F.transform("_body", lambda s: word_count(F.coalesce(s["content"], F.lit("")))),
        F.lit(0), lambda a, n: a + n)
    labels = F.array_distinct(F.filter(F.transform("_body", lambda s: s["name"]), lambda x: x != "other"))
    found = F.arrays_overlap("_labels", F.array(*map(F.lit, K.FINDING_SECTIONS)))
    # (passed, weight in twentieths, reason): integer weights keep the sum exact.
    checks = [
        (~is_blank(F.col("abstract")), 3, F.lit("Abstract missing")),
        (F.col("_aw") >= K.MIN_ABSTRACT_WORDS, 2, F.format_string(
            f"Abstract too short (%d words, min {K.MIN_ABSTRACT_WORDS})", "_aw")),
        (F.col("_bw") >= K.MIN_BODY_WORDS, 7, F.format_string(
            f"Body content too short (%d words, min {K.MIN_BODY_WORDS})", "_bw")),
        (found, 6, F.lit("No results, discussion, or conclusion section found")),
        (F.size("_labels") >= K.MIN_DISTINCT_SECTIONS, 2, F.format_string(
            f"Too few distinct body sections (%d, min {K.MIN_DISTINCT_SECTIONS})", F.size("_labels"))),
    ]
    twentieths = F.lit(0)
    for test, weight, _ in checks:
        twentieths = twentieths + F.when(test, weight).otherwise(0)
    return (
        papers.withColumn("_body", body).withColumn("_aw", abstract_words)
        .withColumn("_bw", body_words).withColumn("_labels", labels)
        .withColumn("score", F.round(twentieths / 20, 4))
        .withColumn("passed", found & (F.col("score") >= K.PASS_SCORE))
        .withColumn("reasons", F.array_compact(F.array(*[F.when(~t, r) for t, _, r in checks])))
        .drop("_body", "_aw", "_bw", "_labels")
    )


def passed(scored: DataFrame) -> DataFrame:
    return scored.where("passed").drop("score", "passed", "reasons")


def rejections(scored: DataFrame) -> DataFrame:
    """Rows of the rejection log."""
    return scored.where("not passed").select("paper_key", "topic", "score", "reasons")
