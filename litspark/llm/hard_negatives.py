"""Hard negatives by a secondary sort: positives open windows, a stream of sorted pairs fills them.

For every anchor, its best rows of the same label are positives; a positive's
negatives are the best rows of other labels whose score lies between ``LOW_PERCENT``
of the positive's and the positive's own. Pairs are packed into keys (anchor,
descending score, positives first, id), ``repartitionAndSortWithinPartitions``
brings an anchor's keys together in order, and one iterator opens a window at each
positive, hands every negative to the open windows and closes those that are full
or out of reach. It holds a window's counter, never an anchor's pairs.

Anchors meet the rows in blocks of bounded size: a block is broadcast, rows stay
where they lie, and a task sends only what can be among a window's first rows.
Before that, one row in ``SLICE`` is scored: the window's last place there is a floor
for all rows, so what is sent does not grow with the number of tasks. Both
bounds are exact. Each block's pairs are written to the shared folder, then
all are sorted at once.

A component x counts as floor(256 * x), x as double; scores are 64-bit integers, so
|score| must stay below 2**63. Rows with a null id or label, a null vector or a
null, NaN or infinite component take no part; labels are integers. Vectors
meet only vectors of their length. Equal scores go by the smaller id. Repeated
rows each count; of repeated anchor ids, the smallest vector and label asks, and
no row of its own id is taken. A positive with a score below zero has no negatives.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window
from pyspark.sql import functions as F

from litspark.llm.bit_sliced import usable
from litspark.session import shared_dir, store

SCALE = 256
K_POSITIVES, K_NEGATIVES = 5, 5
LOW_PERCENT = 80
#: Components of a block of anchors, rows scored at once, and one row in so many scored first.
BLOCK_COMPONENTS, CHUNK_ROWS, SLICE = 64 * 512, 4096, 16
_NONE = np.iinfo(np.int64).min
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Block:
    """Anchors of one block by vector length, and their windows: (lowest, highest) score and the floor (score, id) of each."""

    def __init__(self, rows: list[Row]) -> None:
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim in sorted({len(r["_v"]) for r in rows}):
            own = [r for r in rows if len(r["_v"]) == dim]
            self.parts[dim] = (np.array([r["_id"] for r in own], dtype=np.int64), np.array([r["_label"] for r in own], dtype=np.int64),
                               np.array([r["_v"] for r in own], dtype=np.int64).reshape(len(own), dim))


def scores(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, in floating point where that is exact."""
    if not asked.size or not rows.size:
        return np.zeros((len(asked), len(rows)), dtype=np.int64)
    most = float(np.abs(asked.astype(np.float64)).max()) * float(np.abs(rows.astype(np.float64)).max()) * asked.shape[1]
    return (asked.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64) if most < 2.0**53 else asked @ rows.T


def first_k(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best pairs of each group, ties to the smaller id."""
    order = np.lexsort((ids, -score, group))
    own = group[order]
    head = np.searchsorted(own, own, "left")
    return order[np.arange(len(own)) - head < k]


def _best(table: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` largest entries and all that tie with them; ``_NONE`` is no entry."""
    if table.shape[1] > k:
        least = np.partition(table, table.shape[1] - k, axis=1)[:, table.shape[1] - k, None]
        return np.nonzero((table >= least) & (table > _NONE))
    return np.nonzero(table > _NONE)


def _task(batches: Iterator[pa.RecordBatch], block: Block, windows: dict[int, list[tuple[int, int]]] | None,
          floors: dict[tuple[int, int], tuple[int, int]], k: int, single: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of this task's rows that can be among the first ``k`` of an anchor's windows.

    Without ``windows`` an anchor has one, of its own label. ``single``: a pair
    in several windows comes once, as of window -1.
    """
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    count = 0

    def edges(dim: int, place: int) -> tuple[np.ndarray, ...]:
        own = block.parts[dim][0].tolist()
        spans = [(windows.get(i, []) + [(1, 0)] * (place + 1))[place] if windows is not None else (_NONE + 1, np.iinfo(np.int64).max) for i in own]
        least = [floors.get((i, place), (_NONE, 0)) for i in own]
        return tuple(np.array(x, dtype=np.int64)[:, None] for x in (*zip(*spans), *zip(*least)))

    places = 1 if windows is None else max(map(len, windows.values()), default=0)
    limits = {(dim, p): edges(dim, p) for dim in block.parts for p in range(places)}
    for batch in batches:
        dims = np.diff(batch.column(2).offsets.to_numpy())
        for dim, (asked_ids, asked_labels, asked) in block.parts.items():
            at = np.flatnonzero(dims == dim)
            for lo in range(0, len(at), CHUNK_ROWS):
                part = batch.take(pa.array(at[lo:lo + CHUNK_ROWS]))
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                rows = part.column(2).flatten().to_numpy().astype(np.int64).reshape(len(ids), dim)
                every = scores(asked, rows)
                same = labels == asked_labels[:, None]
                able = (ids != asked_ids[:, None]) & (same if windows is None else ~same)
                for place in range(places):
                    low, high, floor, floor_id = limits[dim, place]
                    fits = able & (every >= low) & (every <= high) & ((every > floor) | ((every == floor) & (ids <= floor_id)))
                    a, b = _best(np.where(fits, every, _NONE), ids, k)
                    if not len(a):
                        continue
                    found = np.stack([a, every[a, b], ids[b], count + b])
                    found = found[:, first_k(found[0], found[1], found[2], k)]
                    seen = held.get((dim, place))
                    if seen is not None:
                        found = np.concatenate([seen, found], axis=1)
                        found = found[:, first_k(found[0], found[1], found[2], k)]
                    held[dim, place] = found
                count += len(ids)
    for dim in block.parts:
        own = [(place, found) for (d, place), found in held.items() if d == dim]
        if not own:
            continue
        rows = np.concatenate([np.vstack([found, np.full(found.shape[1], place)]) for place, found in own], axis=1)
        if single:
            # A row is told apart by its number in the task, so repeated rows stay.
            rows = rows[:, np.unique(rows[[0, 3]], axis=1, return_index=True)[1]]
            rows[4] = -1
        yield pa.RecordBatch.from_arrays([pa.array(block.parts[dim][0][rows[0]]), pa.array(rows[4].astype(np.int32)), pa.array(rows[1]),
                                          pa.array(rows[2])], names=["anchor_id", "place", "score", "id"])


def _pairs(rows: DataFrame, block, windows, floors, k: int, single: bool) -> DataFrame:
    # ``block`` and ``windows`` are broadcast: a block holds a bounded number of components.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _task(batches, block.value, windows, floors, k, single)

    return rows.select("_id", "_label", "_v").mapInArrow(run, "anchor_id long, place int, score long, id long")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _floors(rows: DataFrame, block, windows, k: int) -> dict[tuple[int, int], tuple[int, int]]:
    """The ``k``-th pair of each window within a slice of the rows: no worse pair can be among the first ``k`` of all."""
    part = rows.where(F.pmod(F.xxhash64("_id"), F.lit(SLICE)) == 0)
    # At most one row per window of the block.
    last = _ranked(_pairs(part, block, windows, {}, k, False), k).where(F.col("rank") == k).collect()
    return {(r["anchor_id"], r["place"]): (r["score"], r["id"]) for r in last}


def mined(keys: Iterator[tuple[tuple[int, int, int, int], None]], k: int = K_NEGATIVES, low: int = LOW_PERCENT) -> Iterator[tuple]:
    """Stream sorted keys (anchor, -score, 0 for a positive or 1, id): negatives of every open window."""
    anchor, windows = None, []
    for (own, descending, kind, row), _ in keys:
        if own != anchor:
            anchor, windows = own, []
        score = -descending
        if kind == 0:
            windows.append([row, score, 0])
            continue
        windows = [w for w in windows if w[2] < k and 100 * score >= low * w[1]]
        for window in windows:
            window[2] += 1
            yield own, window[0], window[2], row, window[1], score


def mine(vectors: DataFrame, is_anchor: Column, k_positives: int = K_POSITIVES, k_negatives: int = K_NEGATIVES, low: int = LOW_PERCENT,
         id_col: str = "vec_id", label: str = "label", vector: str = "embedding", block_components: int = BLOCK_COMPONENTS) -> DataFrame:
    """Per anchor and positive, up to ``k_negatives`` rows of other labels by rank, with both scores."""
    spark = vectors.sparkSession
    quantised = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = store(vectors.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector))).select(
        F.col(id_col).cast("long").alias("_id"), F.col(label).cast("long").alias("_label"), quantised.alias("_v"),
        is_anchor.alias("_asks")), "negatives-rows")
    asks = rows.where("_asks").groupBy("_id").agg(F.min(F.struct("_v", "_label")).alias("_row"))
    asks = store(asks.select("_id", "_row.*"), "negatives-anchors")
    components = asks.agg(F.sum(F.size("_v") + 1)).first()[0]
    if not components:
        return spark.createDataFrame([], _OUT)
    blocks = -(-components // block_components)
    folder = f"{shared_dir(spark)}/litspark-{spark.sparkContext.applicationId}/negatives-{uuid.uuid4().hex}"
    for number in range(blocks):
        # About ``block_components`` components: a block is bounded, the number of blocks follows the anchors.
        own = Block(asks.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == number).collect())
        block = spark.sparkContext.broadcast(own)
        positives = _ranked(_pairs(rows, block, None, _floors(rows, block, None, k_positives), k_positives, False), k_positives)
        positives = store(positives.select("anchor_id", "score", F.lit(0).alias("kind"), "id"), "negatives-positives")
        windows: dict[int, list[tuple[int, int]]] = {}
        # At most ``k_positives`` rows per anchor of the block; equal scores share a window.
        for r in positives.select("anchor_id", "score").distinct().where("score >= 0").collect():
            windows.setdefault(r["anchor_id"], []).append((-(-low * r["score"] // 100), r["score"]))
        negatives = _pairs(rows, block, windows, _floors(rows, block, windows, k_negatives), k_negatives, True)
        negatives.select("anchor_id", "score", F.lit(1).alias("kind"), "id").unionByName(positives).write.parquet(f"{folder}/part={number}")
        block.unpersist()
    pairs = spark.read.schema("anchor_id long, score long, kind int, id long").parquet(folder)
    parts = max(pairs.rdd.getNumPartitions(), 1)
    keys = pairs.select("anchor_id", "score", "kind", "id").rdd.map(lambda r: ((r[0], -r[1], r[2], r[3]), None))
    # The number of an anchor's keys does not grow with the rows, so anchors are dealt whole.
    dealt = keys.repartitionAndSortWithinPartitions(parts, lambda key: hash(key[0]) % parts)
    return spark.createDataFrame(dealt.mapPartitions(lambda own: mined(own, k_negatives, low)), _OUT)
