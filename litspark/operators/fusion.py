"""Rank fusion, diversity cap, reranking, grading and fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.scores import final_score, rrf
from litspark.operators.filters import grade


def candidate_ranks(candidates: DataFrame, key: str = "chunk_id") -> DataFrame:
    """1-based rank per query by descending score."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return candidates.withColumn("rank", F.row_number().over(order))


def fuse(dense: DataFrame, keyword: DataFrame, k: int = K.RRF_K,
         top_k: int | None = K.TOP_K_RETRIEVAL) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists per query.

    A chunk missing from one list takes the rank after the longer list. Dense
    rows win ties, then the better keyword rank. One union and one aggregation
    replace the outer join; groups hold at most both lists of one query.
    """
    both = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"),
                        F.lit(None).cast("int").alias("keyword_rank")).unionByName(
        keyword.select("query_id", "chunk_id", F.lit(None).cast("int").alias("dense_rank"),
                       F.col("rank").alias("keyword_rank")))
    per_query = Window.partitionBy("query_id")
    merged = (
        both.repartition("query_id")
        .groupBy("query_id", "chunk_id")
        .agg(F.min("dense_rank").alias("dense_rank"), F.min("keyword_rank").alias("keyword_rank"))
        .withColumn("fallback", F.greatest(
            F.count("dense_rank").over(per_query), F.count("keyword_rank").over(per_query),
            F.lit(1)) + 1)
        .withColumn("score", rrf(F.coalesce("dense_rank", "fallback"),
                                 F.coalesce("keyword_rank", "fallback"), k))
    )
    order = per_query.orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(),
                              F.col("keyword_rank").asc_nulls_last(), "chunk_id")
    fused = merged.withColumn("rank", F.row_number().over(order)).drop("fallback")
    return fused if top_k is None else fused.where(F.col("rank") <= top_k)


def cap_designs(ranked: DataFrame, cap: int = K.DIVERSITY_CAP, designs: list[str] | None = None) -> DataFrame:
    """Keep at most ``cap`` rows of the capped designs per query, in rank order, no refill."""
    capped = F.coalesce(F.col("study_design"), F.lit("unknown")).isin(designs or K.CAPPED_DESIGNS)
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.withColumn("_seen", F.sum(capped.cast("int")).over(so_far))
        .where(~capped | (F.col("_seen") <= cap)).drop("_seen")
    )


def rerank(candidates: DataFrame, now_year: int, top_n: int = K.TOP_K_RERANK,
           order_by: str = "relevance") -> DataFrame:
    """Best ``top_n`` candidates per query by relevance, with the weighted score.

    Candidates carry ``relevance_score``, the fused ``score`` and ``rank``,
    ``study_design`` and ``year``. A query whose relevance is missing passes
    through in fused order with its fused score as relevance. The weighted
    score does not reorder rows unless ``order_by='final'``.
    """
    rel = F.col("relevance_score")
    scored_query = F.count(rel).over(Window.partitionBy("query_id")) > 0
    weighted = final_score(rel, F.coalesce("study_design", F.lit("unknown")), F.col("year"), now_year)
    judged = (
        candidates.withColumn("_judged", scored_query)
        .withColumn("final_score", F.when(F.col("_judged"), weighted).otherwise(F.col("score")))
        .withColumn("relevance_score", F.when(F.col("_judged"), rel).otherwise(F.col("score")))
        .where(~F.col("_judged") | F.col("relevance_score").isNotNull())
        .withColumn("fused_rank", F.col("rank"))
    )
    lead: Column = F.col("final_score" if order_by == "final" else "relevance_score")
    order = Window.partitionBy("query_id").orderBy(
        F.when(F.col("_judged"), lead).desc_nulls_last(), "fused_rank", "chunk_id")
    return (
        judged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).drop("_judged")
    )


def with_fallback(queries: DataFrame, graded: DataFrame, external: DataFrame,
                  k: int = K.TOP_K_RERANK) -> DataFrame:
    """Queries left without a graded chunk take up to ``k`` rows of external evidence."""
    empty = queries.select("query_id").join(graded.select("query_id").distinct(), "query_id", "left_anti")
    taken = external.join(empty, "query_id", "left_semi").where(F.col("rank") <= k)
    return graded.withColumn("used_fallback", F.lit(False)).unionByName(
        taken.withColumn("used_fallback", F.lit(True)), allowMissingColumns=True)


def retrieval_summary(queries: DataFrame, fused: DataFrame, graded: DataFrame) -> DataFrame:
    """Per query: mean relevance of its chunks (0 if none), candidate count, fallback flag."""
    conf = graded.groupBy("query_id").agg(
        F.avg("relevance_score").alias("retrieval_confidence"),
        F.count("*").alias("num_chunks"),
        F.max(F.coalesce("used_fallback", F.lit(False)) if "used_fallback" in graded.columns
              else F.lit(False)).alias("used_fallback"))
    cand = fused.groupBy("query_id").agg(F.count("*").alias("num_candidates"))
    return (
        queries.select("query_id").join(conf, "query_id", "left").join(cand, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("retrieval_confidence", F.lit(0.0)).alias("retrieval_confidence"),
            F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"),
            F.coalesce("num_candidates", F.lit(0)).alias("num_candidates"),
            F.coalesce("used_fallback", F.lit(False)).alias("used_fallback"))
    )


def graded_and_renumbered(reranked: DataFrame, floor: float = K.CONFIDENCE_LOW) -> DataFrame:
    """Grade, then number the survivors 1..n so ``[Doc n]`` points at them."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return grade(reranked, floor).withColumn("rank", F.row_number().over(order))
