"""Answer confidence from the ranked chunks of each query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.scores import evidence_quality, gate


def answer_confidence(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Confidence, gate and reasons per query.

    ``queries(query_id[, query_topics])``; ``ranked(query_id, rank,
    relevance_score, evidence_level, pmcid, cancer_type)``. One aggregation over
    the few chunks of a query; without ``query_topics`` the topic check is off.
    """
    level = F.coalesce("evidence_level", F.lit(K.DEFAULT_EVIDENCE_LEVEL))
    per_query = ranked.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("rank") <= 3, F.col("relevance_score"))).alias("base"),
        F.bool_or(level <= 2).alias("strong"),
        F.bool_and(level >= 5).alias("weak"),
        F.count_distinct(F.nullif(F.col("pmcid"), F.lit(""))).alias("papers"),
        F.stddev_pop("relevance_score").alias("spread"),
        F.array_distinct(F.flatten(F.collect_set("cancer_type"))).alias("topics"),
    )
    topics = F.col("query_topics") if "query_topics" in queries.columns else F.lit(None).cast("array<string>")
    joined = queries.select("query_id", topics.alias("query_topics")).join(per_query, "query_id", "left")
    rules = [
        (F.col("strong"), 0.1, "evidence_boost"),
        (~F.col("strong") & F.col("weak"), -0.1, "evidence_penalty"),
        ((F.col("papers") == 1) & (F.col("n") > 1), -0.1, "single_paper_penalty"),
        (F.col("spread") > 0.3, -0.05, "spread_penalty"),
        ((F.size("query_topics") > 0)
         & ~F.coalesce(F.arrays_overlap("topics", "query_topics"), F.lit(False)),
         -0.1, "topic_mismatch_penalty"),
    ]
    adjust = F.lit(0.0)
    for test, amount, _ in rules:
        adjust = adjust + F.when(test, amount).otherwise(0.0)
    reasons = F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, _, name in rules])), "; ")
    scored = joined.withColumn(
        "score", F.when(F.col("n").isNull(), 0.0).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base") + adjust))))
    return scored.select(
        "query_id", "score", (F.col("score") >= K.CONFIDENCE_LOW).alias("sufficient"),
        F.when(F.col("n").isNull(), "no_chunks").when(reasons == "", "nominal").otherwise(reasons).alias("reason"),
        gate(F.col("score")).alias("gate"), evidence_quality(F.col("score")).alias("evidence_quality"),
        F.coalesce("n", F.lit(0)).alias("n_chunks"),
    )
