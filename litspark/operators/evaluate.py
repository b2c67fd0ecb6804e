"""Evaluation aggregates, gates and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions import judges
from litspark.operators.quantiles import positional_quantiles

FACETS = ["cancer_type", "difficulty", "question_type"]
LATENCY = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def judge_answers(answers: DataFrame) -> DataFrame:
    """Add the seven metrics and their overall score.

    ``answers(question, answer, chunks array<struct<text, evidence_level>>,
    ground_truth)``. Columns named ``judge_<metric>`` that a caller's own judge
    produced win over the rules where they are not null.
    """
    metrics = judges.all_metrics(F.col("question"), F.col("answer"), F.col("chunks"), F.col("ground_truth"))
    for name, rule in metrics.items():
        given = f"judge_{name}"
        value = F.coalesce(F.col(given), rule) if given in answers.columns else rule
        answers = answers.withColumn(name, value)
    return answers.withColumn("overall", judges.overall(*map(F.col, K.CORE_METRICS)))


def _means():
    return [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in K.METRICS]


def mean_metrics(results: DataFrame) -> DataFrame:
    """One row: number of queries, mean metrics, overall of the means; zeros when empty."""
    return results.agg(F.count("*").alias("total_queries"), *_means()).withColumn(
        "overall", judges.overall(*map(F.col, K.CORE_METRICS)))


def grouped_metrics(results: DataFrame, facets: list[str] | None = None) -> DataFrame:
    """Mean metrics overall and by every facet, in one pass of grouping sets."""
    facets = facets or FACETS
    bits = {f: (1 << len(facets)) - 1 - (1 << (len(facets) - 1 - i)) for i, f in enumerate(facets)}
    sets = results.groupingSets([*[[f] for f in facets], []], *facets).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), *_means())
    facet = reduce(lambda acc, f: acc.when(F.col("gid") == bits[f], f), facets, F.when(F.lit(False), ""))
    return sets.select(
        facet.otherwise("all").alias("facet"), F.coalesce(*facets).alias("value"), "n", *K.METRICS,
        judges.overall(*map(F.col, K.CORE_METRICS)).alias("overall"))


def latency_stats(results: DataFrame, value: str = "latency_ms", by: list[str] | None = None) -> DataFrame:
    """p50, p95, p99 by position, and the mean; zeros when there is nothing."""
    stats = positional_quantiles(results, value, LATENCY, by)
    if by:
        return stats
    names = [*LATENCY, "mean"]
    return stats.agg(*[F.coalesce(F.max(c).cast("double"), F.lit(0.0)).alias(c) for c in names],
                     F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def threshold_gate(grouped: DataFrame, latency: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Check facet means and latency against ``thresholds(facet, metric, bound, kind)``.

    ``kind`` is ``floor`` or ``ceiling``; a threshold on a facet applies to each
    of its values.
    """
    names = [*K.METRICS, "overall"]
    long = grouped.select("facet", "value", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("actual")) for m in names])).alias("m")).select(
        "facet", "value", "m.metric", "m.actual")
    lat = latency.select(F.lit("latency").alias("facet"), F.lit(None).cast("string").alias("value"), F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("actual")) for m in [*LATENCY, "mean"]])
    ).alias("m")).select("facet", "value", "m.metric", "m.actual")
    joined = long.unionByName(lat).join(thresholds, ["facet", "metric"])
    ok = F.when(F.col("kind") == "floor", F.col("actual") >= F.col("bound")).otherwise(
        F.col("actual") <= F.col("bound"))
    return joined.withColumn("passed", ok)


def regression_gate(current: DataFrame, baseline: DataFrame,
                    tolerance: float = K.REGRESSION_TOLERANCE) -> DataFrame:
    """Change of the five core metrics against a baseline row and whether none fell too far.

    Both sides are one-row aggregates; a metric the baseline lacks counts as 0,
    and with no baseline row at all the gate passes with zero change.
    """
    have = [m for m in K.CORE_METRICS if m in baseline.columns]
    base = baseline.agg(F.count("*").alias("_n"), *[F.max(m).alias(f"b_{m}") for m in have])
    joined = current.select(*K.CORE_METRICS, F.lit(1).alias("_one")).join(
        base.withColumn("_one", F.lit(1)), "_one")
    deltas = [
        F.when(F.col("_n") == 0, 0.0).otherwise(
            F.col(m) - (F.coalesce(F.col(f"b_{m}"), F.lit(0.0)) if m in have else F.lit(0.0))).alias(m)
        for m in K.CORE_METRICS]
    changed = joined.select("_n", *deltas)
    fine = reduce(lambda a, b: a & b, [F.col(m) >= -tolerance for m in K.CORE_METRICS])
    return changed.select(*K.CORE_METRICS, (fine | (F.col("_n") == 0)).alias("passed"))


def answer_flags(results: DataFrame) -> DataFrame:
    """Add whether an answer holds all required terms and whether it is a refusal."""
    return results.withColumn(
        "contains_required_terms", judges.contains_all(F.col("answer"), F.col("must_contain_terms"))
    ).withColumn("is_refused", judges.is_refusal(F.col("answer")))


def latest_completed(runs: DataFrame) -> DataFrame:
    """The most recent completed run."""
    row = F.struct(*runs.columns)
    done = runs.where(F.col("status") == "completed")
    return done.agg(F.max_by(row, F.struct("finished_at", "run_id")).alias("r")).where("r is not null").select("r.*")
