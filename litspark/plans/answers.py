"""Answer post-processing: citations, safety notes, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions import citations as C
from litspark.operators.confidence import answer_confidence
from litspark.operators.safety import append_warnings


def check_citations(answers: DataFrame) -> DataFrame:
    """Strip citations that point at no document; ``answers(answer, num_docs)``."""
    n = F.col("num_docs")
    return (
        answers.withColumn("hallucinated_citations", C.hallucinated(F.col("answer"), n))
        .withColumn("answer", C.removed_notice(C.strip_invalid_tags(F.col("answer"), n),
                                               F.col("hallucinated_citations")))
        .withColumn("citations", C.valid_citations(F.col("answer"), F.col("hallucinated_citations")))
    )


def post_process(answers: DataFrame, ranked: DataFrame, withdrawals: DataFrame,
                 language: str = "en") -> DataFrame:
    """Checked answers with safety notes, confidence, gate and stored quality.

    ``answers(query_id, answer[, query_topics])``; ``ranked`` as in
    :func:`litspark.operators.confidence.answer_confidence`. A refused answer
    cites nothing.
    """
    conf = answer_confidence(answers, ranked).withColumnsRenamed({"score": "confidence_score", "n_chunks": "num_docs"})
    joined = answers.join(conf, "query_id")
    refused = F.col("gate") == "refused"
    checked = check_citations(joined.withColumn("_raw", F.col("answer")))
    none = F.array().cast("array<bigint>")
    settled = (
        checked.withColumn("answer", F.when(refused, F.col("_raw")).otherwise(F.col("answer")))
        .withColumn("citations", F.when(refused, none).otherwise(F.col("citations")))
        .withColumn("hallucinated_citations", F.when(refused, none).otherwise(F.col("hallucinated_citations")))
        .drop("_raw")
    )
    return append_warnings(settled, withdrawals, language)
