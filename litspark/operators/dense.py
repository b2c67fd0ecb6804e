"""Exact dense top-k by cosine similarity.

Pairs of query and vector are never rows. Each task multiplies a block of query
vectors with an Arrow batch of chunk vectors and keeps a running top ``k`` per
query, so a task emits at most ``k`` rows per query however many vectors it saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.operators.keyword import top_ranked
from litspark.operators.topk import OUT, QUERY_BLOCK, Best, allowed_rows, as_batches, blocks, flag_matrix, in_parts, offer
from litspark.session import store, store_parts

MAX_QUERY_FLOATS = 8_000_000   # 64 MB of query vectors per task


def _unit_rows(flat: np.ndarray, n: int) -> np.ndarray:
    m = flat.reshape(n, -1).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norm == 0, np.nan, norm)[:, None]


def _scan(bests: list[Best], queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
          allowed: np.ndarray | None, digits: int) -> None:
    for block, best in enumerate(bests):
        rows = slice(block * QUERY_BLOCK, (block + 1) * QUERY_BLOCK)
        scores = np.round(queries[rows] @ vectors.T, digits)
        ok = np.isfinite(scores)
        offer(best, scores, ok if allowed is None else ok & allowed[rows], ids)


def _batch_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    column = batch.column(batch.schema.get_field_index("embedding"))
    vectors = _unit_rows(column.flatten().to_numpy(zero_copy_only=False), batch.num_rows)
    ids = np.array(batch.column(batch.schema.get_field_index("chunk_id")).to_pylist(), dtype=object)
    return vectors, ids, flag_matrix(batch)


def dense_topk(
    queries: DataFrame, vectors: DataFrame, k: int = K.TOP_K_RETRIEVAL,
    condition: Column | None = None, conditions: list[Column] | None = None,
    digits: int = 9, max_query_floats: int = MAX_QUERY_FLOATS,
) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the ``k`` nearest vectors of every query.

    ``queries(query_id, embedding[, filter_no])``, ``vectors(chunk_id, embedding, …)``.
    ``condition`` filters vectors for all queries and reaches the scan.
    ``conditions`` are per-request filters: a query with ``filter_no = i`` sees
    the vectors that satisfy ``conditions[i]``, null sees all. They are evaluated
    in the JVM, as one flag array per vector.
    """
    if condition is not None:
        vectors = vectors.where(condition)
    vectors = vectors.where(F.col("embedding").isNotNull())
    picked = [F.col("chunk_id").cast("string").alias("chunk_id"), "embedding"]
    if conditions:
        picked.append(F.array(*[F.coalesce(c, F.lit(False)) for c in conditions]).alias("allowed"))
    slim = vectors.select(*picked)
    numbered = "filter_no" in queries.columns
    asked = queries.where(F.col("embedding").isNotNull()).select(
        F.col("query_id").cast("string").alias("query_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        (F.col("filter_no") if numbered else F.lit(None)).cast("int").alias("filter_no"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()
    if size["n"] * size["d"] <= max_query_floats:
        partial = _per_partition(asked, slim, k, digits)
    else:
        partial = _per_block(asked, slim, k, digits, size["n"], size["d"], max_query_floats)
    return top_ranked(partial, k)


def _per_partition(asked: DataFrame, vectors: DataFrame, k: int, digits: int) -> DataFrame:
    """Query vectors of checked size go to every task; vectors do not move at all."""
    rows = asked.collect()
    if not rows:
        return asked.sparkSession.createDataFrame([], OUT)
    names = np.array([r["query_id"] for r in rows], dtype=object)
    matrix = _unit_rows(np.array([r["embedding"] for r in rows]).ravel(), len(rows))
    numbers = np.array([np.nan if r["filter_no"] is None else r["filter_no"] for r in rows], dtype=float)
    shared = asked.sparkSession.sparkContext.broadcast((names, matrix, numbers))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_names, q_matrix, q_numbers = shared.value
        bests = blocks(len(q_names), k)
        for batch in in_parts(batches):
            if batch.num_rows:
                m, ids, flags = _batch_arrays(batch)
                _scan(bests, q_matrix, m, ids, allowed_rows(q_numbers, flags), digits)
        yield from as_batches(bests, q_names)

    return vectors.mapInArrow(scan, OUT)


def _per_block(asked: DataFrame, vectors: DataFrame, k: int, digits: int, n: int, dims: int, max_query_floats: int) -> DataFrame:
    """Query side too large for one task: its blocks go over the vectors in turn.

    A block is a hash range of bounded size and is broadcast; vectors stay where
    they lie and are read once per block, and a task sends ``k`` rows per query.
    """
    blocks_ = max(1, -(-n * max(dims, 1) // max(1, max_query_floats // 2)))
    placed = store(asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks_))), "dense-queries")
    return store_parts((
        top_ranked(_per_partition(placed.where(F.col("_block") == b).drop("_block"), vectors, k, digits), k).drop("rank")
        for b in range(blocks_)), "dense-blocks")
