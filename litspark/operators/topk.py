"""Running top ``k`` per query inside a task, shared by dense and keyword search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

QUERY_BLOCK = 256
OUT = "query_id string, chunk_id string, score double"
ARROW_OUT = pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("score", pa.float64())])


class Best:
    """Running top ``k`` of (query, id, score) with ties to the smaller id."""

    def __init__(self, k: int, n_queries: int) -> None:
        self.k, self.floor = k, np.full(n_queries, -np.inf)
        self.q = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=object)
        self.s = np.empty(0)

    def add(self, q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        q, ids, s = (np.concatenate(p) for p in ((self.q, q), (self.ids, ids), (self.s, s)))
        order = np.lexsort((ids.astype(str), -s, q))
        q, ids, s = q[order], ids[order], s[order]
        starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.empty(0, dtype=np.int64)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = place < self.k
        self.q, self.ids, self.s = q[keep], ids[keep], s[keep]
        full = place[keep] == self.k - 1
        self.floor[self.q[full]] = self.s[full]


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of few rows: what a task computes of a part is bounded, however long a batch is."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def blocks(n_queries: int, k: int) -> list[Best]:
    """One running top ``k`` per block of queries, so a merge touches only its block."""
    return [Best(k, min(QUERY_BLOCK, n_queries - at)) for at in range(0, n_queries, QUERY_BLOCK)]


def offer(best: Best, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
    """Offer a (queries of the block × ids) score matrix; ``ok`` marks the pairs that count."""
    scores = np.where(ok, scores, -np.inf)
    floor, n = best.floor, scores.shape[1]
    if n > best.k:
        floor = np.maximum(floor, np.partition(scores, n - best.k, axis=1)[:, n - best.k])
    qi, vi = np.nonzero(ok & (scores >= floor[:, None]))
    if len(qi):
        best.add(qi, ids[vi], scores[qi, vi])


def allowed_rows(filter_no: np.ndarray, flags: np.ndarray | None) -> np.ndarray | None:
    """(queries × ids) permissions from per-id filter flags; NaN stands for no filter."""
    if flags is None:
        return None
    padded = np.concatenate([flags, np.ones((len(flags), 1), dtype=bool)], axis=1)
    return padded.T[np.where(np.isnan(filter_no), flags.shape[1], filter_no).astype(int)]


def flag_matrix(batch: pa.RecordBatch) -> np.ndarray | None:
    at = batch.schema.get_field_index("allowed")
    if at < 0:
        return None
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(bool)


def as_batches(bests: list[Best], names: np.ndarray) -> Iterator[pa.RecordBatch]:
    for block, best in enumerate(bests):
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[best.q + block * QUERY_BLOCK].tolist(), pa.string()),
             pa.array(best.ids.tolist(), pa.string()), pa.array(best.s, pa.float64())],
            names=["query_id", "chunk_id", "score"])
