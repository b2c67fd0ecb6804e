"""Exact top-k search on a bit-sliced index.

The index holds, per block of vectors and per component, the bits of the
quantised value as bitmaps over the block's rows (one bitmap per significance).
A query's score is a weighted sum of such bitmaps: they are added with
carry-save bitmap arithmetic into the bit slices of the sum, and the top rows are
selected from the most significant slice downward. The lowest ``DROPPED`` bits
of each component take no part in the sum; they can lift a score by a known
amount at most, so the rows within that amount of the boundary are resolved by
their exact inner products.

Query blocks meet index blocks by an equi-join on the block number; every pair
gives at most ``k`` rows per query, and one window per query merges them.

A component x counts as floor(1024 * x), x as double; scores are 64-bit integers, so
|score| must stay below 2**63. Null vectors and vectors holding null, NaN or
infinity take no part, nor do rows with a null id. Vectors meet only vectors of
their length. A row is no candidate for queries of its own id; of repeated
query ids, the smallest vector asks; repeated candidate rows each count. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from litspark.session import store

K = 10
SCALE = 1024
BLOCK_ROWS, BLOCK_QUERIES = 8192, 64
#: Lowest bits of a component that the bitmap sum leaves to the exact step.
DROPPED = 3
_INDEX = "block_no long, dim int, rows int, ids binary, lows binary, widths binary, slices binary, vectors binary"


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & ok


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    width = -(-bits.shape[-1] // 64) * 64
    padded = np.zeros((*bits.shape[:-1], width), dtype=bool)
    padded[..., :bits.shape[-1]] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def _unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little", count=n).astype(bool)


def slice_block(values: np.ndarray, dropped: int = DROPPED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest value and kept bit width per component, and all slices (sum of widths, words)."""
    lows = values.min(axis=0)
    over = (values - lows) >> dropped
    widths = np.array([int(x).bit_length() for x in over.max(axis=0)], dtype=np.int64)
    slices = [_pack((over[:, d] >> j) & 1 == 1) for d in range(values.shape[1]) for j in range(widths[d])]
    return lows, widths, np.array(slices, dtype=np.uint64).reshape(int(widths.sum()), -(-len(values) // 64))


def add_slices(groups: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bitmaps by significance, carry-save added: the slices of their sum, least significant first."""
    out, p = [], min(groups, default=0)
    out += [None] * p
    while groups:
        stack = groups.pop(p, [])
        stack = np.concatenate(stack) if stack else None
        while stack is not None and len(stack) > 1:
            n = len(stack) // 3 * 3
            if n:
                a, b, c = stack[:n:3], stack[1:n:3], stack[2:n:3]
                ab = a ^ b
                carry = (a & b) | (ab & c)
                stack = np.concatenate([ab ^ c, stack[n:]])
            else:
                carry = stack[:1] & stack[1:]
                stack = stack[:1] ^ stack[1:]
            groups.setdefault(p + 1, []).append(carry)
        out.append(stack[0] if stack is not None else None)
        p += 1
    return out


def top_rows(slices: list[np.ndarray], n: int, k: int) -> tuple[np.ndarray, int]:
    """Row mask of sums at least the ``k``-th largest, and that sum, from the top slice downward."""
    ones = np.full(-(-n // 64), np.iinfo(np.uint64).max, dtype=np.uint64)
    if n % 64:
        ones[-1] = np.uint64((1 << n % 64) - 1)
    sure, tied, have, floor, k = np.zeros_like(ones), ones, 0, 0, min(k, n)
    for p in range(len(slices) - 1, -1, -1):
        if slices[p] is None:
            continue
        up = tied & slices[p]
        n_up = int(np.bitwise_count(up).sum())
        if have + n_up >= k:
            tied, floor = up, floor + (1 << p)
        else:
            sure, have, tied = sure | up, have + n_up, tied & ~slices[p]
    return sure | tied, floor


def rows_from(slices: list[np.ndarray], n: int, least: int) -> np.ndarray:
    """Row mask of sums at least ``least``, compared slice by slice from the top."""
    words = -(-n // 64)
    above, equal = np.zeros(words, np.uint64), np.full(words, np.iinfo(np.uint64).max, dtype=np.uint64)
    top = max(len(slices), int(least).bit_length())
    for p in range(top - 1, -1, -1):
        s = slices[p] if p < len(slices) and slices[p] is not None else np.zeros(words, np.uint64)
        if least >> p & 1:
            equal = equal & s
        else:
            above, equal = above | (equal & s), equal & ~s
    return above | equal


def search_block(query: np.ndarray, query_id: int, ids: np.ndarray, lows: np.ndarray, widths: np.ndarray,
                 slices: np.ndarray, values: np.ndarray, k: int = K, dropped: int = DROPPED) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the block's ``k`` best rows for one query."""
    n, starts = len(ids), np.cumsum(widths) - widths
    full = np.iinfo(np.uint64).max
    groups: dict[int, list[np.ndarray]] = {}
    # A negative weight adds the complement of the slices instead: a constant more for every row.
    for d in np.flatnonzero(query):
        own = slices[starts[d]:starts[d] + widths[d]]
        own = own if query[d] > 0 else own ^ full
        weight, bit = abs(int(query[d])), 0
        while weight >> bit:
            if weight >> bit & 1:
                for j in range(len(own)):
                    groups.setdefault(bit + j, []).append(own[j:j + 1])
            bit += 1
    sums = add_slices(groups)
    # The query's own rows may be among the best: as many more are selected.
    own_rows = np.flatnonzero(ids == query_id)
    want = k + len(own_rows)
    if want < n:
        _, floor = top_rows(sums, n, want)
        slack = sum(abs(int(q)) for q in query) * ((1 << dropped) - 1) >> dropped
        near = _unpack(rows_from(sums, n, max(floor - slack - 1, 0)), n)
        at = np.flatnonzero(near & (ids != query_id))
    else:
        at = np.flatnonzero(ids != query_id)
    exact = values[at] @ query
    best = np.lexsort((ids[at], -exact))[:k]
    return at[best], exact[best]


def build_index(vectors: DataFrame, id_col: str, vector: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The stored index: one row per block. Block numbers are dense enough to be enumerated."""
    narrow = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector))).select(
        F.col(id_col).cast("long").alias("_id"), quantised(F.col(vector)).alias("_v"))
    tasks = max(narrow.rdd.getNumPartitions(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_rows = TaskContext.get().partitionId(), {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, values = (np.concatenate(x) for x in zip(*open_rows.pop(dim)))
            lows, widths, slices = slice_block(values)
            row = [[number], [dim], [len(ids)], *([x.tobytes()] for x in (ids, lows, widths, slices, values))]
            number += tasks
            kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)],
                                              names=["block_no", "dim", "rows", "ids", "lows", "widths", "slices", "vectors"])

        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = batch.column(1).take(pa.array(at))
                parts = open_rows.setdefault(int(dim), [])
                for lo in range(0, len(at), block_rows):
                    parts.append((ids[at[lo:lo + block_rows]], _matrix(own.slice(lo, block_rows), int(dim))))
                    if sum(len(p[0]) for p in parts) >= block_rows:
                        yield flush(int(dim))
                        parts = open_rows.setdefault(int(dim), [])
        for dim in [d for d, p in open_rows.items() if p]:
            yield flush(dim)

    return store(narrow.mapInArrow(run, _INDEX), "bit-sliced-index")


def query_blocks(queries: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``ids array<long>, vectors array<array<long>>`` of at most BLOCK_QUERIES queries each."""
    asked = queries.where(F.col(id_col).isNotNull() & usable(F.col(vector))).groupBy(
        F.col(id_col).cast("long").alias("_id")).agg(F.min(quantised(F.col(vector))).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_QUERIES):
                part = batch.slice(lo, BLOCK_QUERIES)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([part.column(1).to_pylist()], pa.list_(pa.list_(pa.int64())))], names=["q_ids", "q_vectors"])

    return asked.mapInArrow(run, "q_ids array<long>, q_vectors array<array<long>>")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score`` of every query's ``k`` best rows, ties to the smaller id."""
    index = build_index(vectors, id_col, vector)
    last = index.agg(F.max("block_no")).first()[0]
    copies = query_blocks(queries, id_col, vector).withColumn(
        "block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-1 if last is None else last).cast("long"), F.lit(1).cast("long")))
    ) if last is not None else query_blocks(queries.limit(0), id_col, vector).withColumn("block_no", F.lit(0).cast("long"))
    # Copies are queries times blocks, which Spark does not see when it estimates them: never broadcast.
    pairs = index.join(copies.hint("merge"), "block_no").select("dim", "ids", "lows", "widths", "slices", "vectors", "q_ids", "q_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column(0)[row].as_py()
                ids, lows, widths, slices, values = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in (
                    (1, np.int64), (2, np.int64), (3, np.int64), (4, np.uint64), (5, np.int64)))
                slices, values = slices.reshape(-1, -(-len(ids) // 64)), values.reshape(len(ids), dim)
                out = []
                for q, asked in zip(batch.column(6)[row].as_py(), batch.column(7)[row].as_py()):
                    if len(asked) == dim:
                        at, scores = search_block(np.array(asked, dtype=np.int64), q, ids, lows, widths, slices, values, k)
                        out.append((np.full(len(at), q), ids[at], scores))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", id_col, "score"])

    best = pairs.mapInArrow(run, f"query_id long, `{id_col}` long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), id_col, "score")
