"""Migration of the older key-value collection to current chunk rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions.chunks import point_id
from litspark.functions.text import embedding_text, word_count
from litspark.functions.scores import embedding_cost
from litspark.operators.scorers import embed
from litspark.sources.records import LEGACY_KEYS, current_payload, eav_pivot


def migrate_eav(embeddings: DataFrame, metadata: DataFrame, text_cut: int | None = None) -> DataFrame:
    """Current chunk rows with point id and embedding text, before any model call."""
    wide = eav_pivot(embeddings, metadata, LEGACY_KEYS)
    # The embedding text is of the whole text, whatever is kept of it.
    rows = current_payload(wide).withColumns({"embed_text": embedding_text(F.col("text"), F.col("title"), F.col("section")), "point_id": point_id(F.col("chunk_id"))})
    return rows if text_cut is None else rows.withColumn("text", F.left("text", F.lit(text_cut)))


def run_migration(embeddings: DataFrame, metadata: DataFrame, embedder: Callable[[list], list], path: str) -> DataFrame:
    """Embed and write, then one row of counts: source, migrated, failed, cost."""
    rows = migrate_eav(embeddings, metadata)
    embed(rows, embedder).write.mode("overwrite").parquet(path)
    done = F.col("embedding").isNotNull()
    return rows.sparkSession.read.parquet(path).agg(
        F.count("*").alias("source_count"), F.count_if(done).alias("migrated"), F.count_if(~done).alias("failed"),
        embedding_cost(F.coalesce(F.sum(F.when(done, word_count(F.col("embed_text")))), F.lit(0))).alias(
            "estimated_cost_usd"))
