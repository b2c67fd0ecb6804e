"""Corpus quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from litspark.operators import report as R


def corpus_report(papers: DataFrame) -> dict[str, DataFrame]:
    """All parts of the report, lazily, keyed by name."""
    grades = R.corpus_grade(papers)
    return {
        "missing_fields": R.missing_fields(papers), "section_coverage": R.section_coverage(papers),
        "top_sections": R.top_sections(papers), "length_stats": R.length_stats(papers),
        "worst_papers": R.worst_papers(papers), "year_distribution": R.year_distribution(papers),
        "grades": grades, "summary": R.corpus_summary(grades),
    }


def write_corpus_report(papers: DataFrame, path: str) -> None:
    for name, part in corpus_report(papers).items():
        part.write.mode("overwrite").json(f"{path}/{name}")
