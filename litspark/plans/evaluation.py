"""Evaluation of a golden set against a retrieval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions.judges import extractive_answer
from litspark.operators import evaluate as E


@dataclass(frozen=True)
class Evaluation:
    results: DataFrame
    grouped: DataFrame
    latency: DataFrame
    regression: DataFrame | None


def evaluate(golden: DataFrame, ranked: DataFrame, answers: DataFrame | None = None,
             baseline: DataFrame | None = None) -> Evaluation:
    """Judge every golden query and aggregate.

    ``golden(id, query, …)``; ``ranked(query_id, rank, text, evidence_level)``;
    ``answers(query_id, answer[, latency_ms])``. Without answers the first chunk
    texts are the answer. A query keeps at most its top ``n`` chunks as an array.
    """
    packed = ranked.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "text", "evidence_level"))),
        lambda x: F.struct(x["text"].alias("text"), x["evidence_level"].alias("evidence_level"))).alias("chunks"))
    none = F.array().cast(packed.schema["chunks"].dataType)
    joined = golden.withColumnRenamed("id", "query_id").withColumnRenamed("query", "question").join(
        packed, "query_id", "left").withColumn("chunks", F.coalesce("chunks", none))
    if answers is None:
        joined = joined.withColumn("answer", extractive_answer(F.transform("chunks", lambda c: c["text"])))
    else:
        joined = joined.join(answers, "query_id")
    if "latency_ms" not in joined.columns:
        joined = joined.withColumn("latency_ms", F.lit(None).cast("double"))
    results = E.answer_flags(E.judge_answers(joined))
    mean = E.mean_metrics(results)
    return Evaluation(results, E.grouped_metrics(results), E.latency_stats(results),
                      None if baseline is None else E.regression_gate(mean, baseline))
