"""Corpus quality report over papers in the collection layout.

``papers(pmc_id, pmid, title, abstract, authors, journal, year, topic,
sections: array<struct<section_name, content>>)``; ``year`` is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.operators.quantiles import positional_quantiles

PATTERNS = ["introduction", "method", "result", "discussion"]


def _missing(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _none(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) <= 0


def _no_title() -> Column:
    return _missing("title") | (F.col("title") == "No title")


def _body_chars() -> Column:
    lengths = F.transform("sections", lambda s: F.length(F.coalesce(s["content"], F.lit(""))).cast("bigint"))
    return F.coalesce(F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + n), F.lit(0))


def _abstract_chars() -> Column:
    return F.length(F.coalesce("abstract", F.lit("")))


def _n_sections() -> Column:
    return F.greatest(F.coalesce(F.size("sections"), F.lit(0)), F.lit(0))


def missing_fields(papers: DataFrame) -> DataFrame:
    """Per topic: papers and how many lack each field."""
    tests = {
        "title": _no_title(), "abstract": _missing("abstract"), "sections": _none("sections"),
        "authors": _none("authors"), "year": _missing("year"), "journal": _missing("journal"),
        "pmc_id": _missing("pmc_id"), "pmid": _missing("pmid"),
    }
    return papers.groupBy("topic").agg(
        F.count("*").alias("papers"), *[F.count_if(t).alias(f"missing_{n}") for n, t in tests.items()])


def missing_fields_long(papers: DataFrame) -> DataFrame:
    """The same as rows ``(topic, field, missing, percent)``."""
    wide = missing_fields(papers)
    fields = [c for c in wide.columns if c.startswith("missing_")]
    pairs = F.array(*[F.struct(F.lit(c.removeprefix("missing_")).alias("field"), F.col(c).alias("missing"))
                      for c in fields])
    return wide.select("topic", "papers", F.explode(pairs).alias("f")).select(
        "topic", F.col("f.field").alias("field"), F.col("f.missing").alias("missing"),
        (F.col("f.missing") / F.col("papers") * 100).alias("percent"))


def _headings(papers: DataFrame) -> DataFrame:
    return papers.select("topic", F.explode("sections").alias("s")).select(
        "topic", F.coalesce("s.section_name", F.lit("Unknown")).alias("section_name"))


def section_distribution(papers: DataFrame) -> DataFrame:
    """Count of every raw heading per topic."""
    return _headings(papers).groupBy("topic", "section_name").agg(F.count("*").alias("n"))


def section_coverage(papers: DataFrame) -> DataFrame:
    """Mean sections per paper, distinct headings, and how often each standard pattern occurs."""
    per_paper = papers.groupBy("topic").agg(
        F.count("*").alias("papers"), F.avg(_n_sections()).alias("avg_sections"))
    low = F.lower("section_name")
    dist = section_distribution(papers).groupBy("topic").agg(
        F.count("*").alias("unique_sections"),
        *[F.sum(F.when(low.contains(p), F.col("n")).otherwise(0)).alias(p) for p in PATTERNS])
    joined = per_paper.join(dist, "topic", "left")
    shares = [(F.coalesce(F.col(p), F.lit(0)) / F.col("papers") * 100).alias(f"{p}_percent") for p in PATTERNS]
    return joined.select("topic", "papers", "avg_sections",
                         F.coalesce("unique_sections", F.lit(0)).alias("unique_sections"), *shares)


def top_sections(papers: DataFrame, keep: int = 10) -> DataFrame:
    """Most common headings per topic, ties in alphabetical order."""
    order = Window.partitionBy("topic").orderBy(F.col("n").desc(), "section_name")
    return section_distribution(papers).withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= keep)


def length_stats(papers: DataFrame) -> DataFrame:
    """Per topic: body characters (mean, min, max, upper median), section and abstract statistics."""
    sized = papers.select("topic", _body_chars().alias("chars"), _n_sections().alias("sections"),
                          _abstract_chars().alias("abstract_chars"))
    basic = sized.groupBy("topic").agg(
        F.avg("chars").alias("chars_avg"), F.min("chars").alias("chars_min"), F.max("chars").alias("chars_max"),
        F.avg("sections").alias("sections_avg"), F.min("sections").alias("sections_min"),
        F.max("sections").alias("sections_max"), F.avg("abstract_chars").alias("abstract_avg"),
        F.min("abstract_chars").alias("abstract_min"), F.max("abstract_chars").alias("abstract_max"))
    median = positional_quantiles(sized, "chars", {"chars_median": 0.5}, by=["topic"]).select("topic", "chars_median")
    return basic.join(median, "topic")


def _with_issues(papers: DataFrame) -> DataFrame:
    chars, n, a = F.col("total_text_length"), F.col("section_count"), F.col("_a")
    names = F.transform("sections", lambda s: F.lower(F.coalesce(s["section_name"], F.lit(""))))

    def has(word: str) -> Column:
        return F.coalesce(F.exists(names, lambda x: x.contains(word)), F.lit(False))

    issues = F.array_compact(F.array(
        F.when(chars < 5000, F.concat(F.lit("Very short ("), F.format_number(chars, 0), F.lit(" chars)"))),
        F.when(n == 0, F.lit("No sections")).when(
            n < 3, F.concat(F.lit("Only "), n.cast("string"), F.lit(" sections"))),
        F.when(a == 0, F.lit("No abstract")).when(a < 100, F.lit("Very short abstract")),
        F.when(_no_title(), F.lit("Missing title")),
        F.when(~has("method"), F.lit("No methods section")),
        F.when(~has("result"), F.lit("No results section")),
    ))
    return papers.withColumn("total_text_length", _body_chars()).withColumn("section_count", _n_sections()).withColumn(
        "_a", _abstract_chars()).withColumn("issues", issues)


def problem_papers(papers: DataFrame) -> DataFrame:
    """Papers with at least one issue, with the list of issues."""
    title = F.coalesce("title", F.lit(""))
    return (
        _with_issues(papers).where(F.size("issues") > 0)
        .select(
            "topic", F.coalesce("pmc_id", F.lit("Unknown")).alias("pmc_id"),
            F.coalesce("pmid", F.lit("Unknown")).alias("pmid"),
            F.when(F.length(title) > 60, F.concat(F.left(title, F.lit(60)), F.lit("..."))).otherwise(title).alias("title"),
            "issues", F.size("issues").alias("n_issues"), "total_text_length", "section_count")
    )


def worst_papers(papers: DataFrame, keep: int = 10) -> DataFrame:
    """Papers with the most issues per topic."""
    order = Window.partitionBy("topic").orderBy(F.col("n_issues").desc(), "pmc_id")
    return problem_papers(papers).withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def year_distribution(papers: DataFrame) -> DataFrame:
    """Papers per all-digit year and topic; other years are counted under null."""
    year = F.when(F.col("year").rlike(r"^\p{Nd}+$"), F.col("year"))
    return papers.groupBy("topic", year.alias("year")).agg(F.count("*").alias("papers"))


def corpus_grade(papers: DataFrame) -> DataFrame:
    """Score out of 100 and letter grade per topic, in one aggregation over the papers."""
    facts = _with_issues(papers).groupBy("topic").agg(
        F.count("*").alias("papers"), F.count_if(_no_title()).alias("no_title"),
        F.count_if(_missing("abstract")).alias("no_abstract"),
        F.count_if(_none("sections")).alias("no_sections"), F.avg("total_text_length").alias("avg_chars"),
        F.count_if(F.size("issues") > 0).alias("problems"))
    off = [
        (F.col("no_title") > 0, 20), (F.col("no_abstract") > F.col("papers") * 0.1, 15),
        (F.col("no_sections") > 0, 20), (F.col("problems") > F.col("papers") * 0.3, 15),
        (F.col("avg_chars") < 10000, 10),
    ]
    score = F.lit(100)
    for test, points in off:
        score = score - F.when(test, points).otherwise(0)
    s = F.col("quality_score")
    grade = (F.when(s >= 90, "A (Excellent)").when(s >= 80, "B (Good)").when(s >= 70, "C (Acceptable)")
             .when(s >= 60, "D (Needs Improvement)").otherwise("F (Poor)"))
    return facts.withColumn("quality_score", F.greatest(score, F.lit(0))).select(
        "topic", F.col("papers").alias("total_papers"), F.col("problems").alias("problematic_count"),
        "quality_score", grade.alias("grade"))


def corpus_summary(grades: DataFrame) -> DataFrame:
    """Papers over all topics and the mean topic score."""
    return grades.agg(F.sum("total_papers").alias("total_papers"), F.avg("quality_score").alias("avg_quality"))
