"""Learned inverted-file index for dense search: coarse lists, product codes, pruned probes, exact rescoring.

Coarse centres and code books are fitted on a bounded sample (the rows with the
smallest id hashes, at most ``SAMPLE_FLOATS`` numbers); then every row is filed:
under its nearest centre, with a code of a byte per group of components for what
is left. Rows are stored partitioned by list, so a search reads only the lists it
probes. It scores codes first, without reading vectors, and rescored candidates
are exact. Each list also knows how far its rows lie from the centre at most:
``exact`` search reads all lists whose bound reaches the ``k``-th score found, which
gives the rows of an exhaustive search.

Null, zero and non-finite vectors are not indexed; vectors must be of one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.operators.dense import _unit_rows, dense_topk
from litspark.operators.keyword import top_ranked
from litspark.operators.topk import OUT, QUERY_BLOCK, as_batches, blocks, offer
from litspark.sizing import join_small

SAMPLE_FLOATS, MAX_LISTS, CODES, ROUNDS = 4_000_000, 4096, 256, 8
#: Components per byte of a code.
GROUP = 4
#: Candidates rescored per wanted row.
REFINE = 10
_ROWS = "list int, chunk_id string, code binary, embedding array<double>, angle double"


@dataclass(frozen=True)
class Model:
    """Centres (lists, dims), code books per component group, and the largest angle between a list's rows and its centre."""

    centres: np.ndarray
    books: list[np.ndarray]
    angles: np.ndarray

    def groups(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.centres.shape[1]), len(self.books))


@dataclass(frozen=True)
class VectorIndex:
    rows: DataFrame
    model: Model


def _clusters(x: np.ndarray, k: int, unit: bool) -> np.ndarray:
    """Lloyd's centres, started from the first rows; an empty one moves to the row that is worst served."""
    centres = x[:k].copy()
    for _ in range(ROUNDS):
        near = x @ centres.T - (0 if unit else (centres**2).sum(axis=1) / 2)
        who = near.argmax(axis=1)
        size = np.bincount(who, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, who, x)
        worst = iter(np.argsort(near[np.arange(len(x)), who] - (0 if unit else (x**2).sum(axis=1) / 2), kind="stable").tolist())
        for i in range(len(centres)):
            centres[i] = sums[i] / size[i] if size[i] else x[next(worst)]
        if unit:
            norm = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(norm > 0, centres / np.where(norm > 0, norm, 1), x[:1])
    return centres


def fit(vectors: DataFrame, n_lists: int | None = None) -> Model | None:
    """Centres and code books from a bounded sample; None without a usable vector."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not size["n"] or not size["d"]:
        return None
    # A bounded sample, spread by a hash of the ids.
    rows = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(max(1, SAMPLE_FLOATS // size["d"])).select(
        F.col("embedding").cast("array<double>").alias("embedding")).toArrow()
    x = _unit_rows(rows.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False), len(rows))
    x = x[np.isfinite(x).all(axis=1)]
    if not len(x):
        return None
    centres = _clusters(x, min(n_lists or int(size["n"] ** 0.5), MAX_LISTS, len(x)), True)
    rest = x - centres[(x @ centres.T).argmax(axis=1)]
    groups = np.array_split(np.arange(x.shape[1]), -(-x.shape[1] // GROUP))
    return Model(centres, [_clusters(rest[:, g], min(CODES, len(x)), False) for g in groups], np.zeros(len(centres)))


def file_rows(vectors: DataFrame, model: Model) -> DataFrame:
    """Every usable row with its list, code and angle to the centre; no shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit_rows(batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.num_rows)
            good = np.flatnonzero(np.isfinite(x).all(axis=1))
            x, kept = x[good], batch.take(pa.array(good))
            near = x @ own.centres.T
            place = near.argmax(axis=1)
            rest = x - own.centres[place]
            codes = np.stack([(rest[:, g] @ b.T - (b**2).sum(axis=1) / 2).argmax(axis=1) for g, b in zip(own.groups(), own.books)], axis=1).astype(np.uint8)
            angle = np.arccos(np.clip(near[np.arange(len(x)), place], -1, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.astype(np.int32)), kept.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), kept.column(1), pa.array(angle)],
                names=["list", "chunk_id", "code", "embedding", "angle"])

    return vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, _ROWS)


def build(vectors: DataFrame, path: str, n_lists: int | None = None) -> VectorIndex:
    """Fit, file and store the index of ``vectors(chunk_id, embedding)``. Range-partitioned by list and id hash, so a list of any size spreads."""
    spark = vectors.sparkSession
    vectors = vectors.where(F.col("embedding").isNotNull())
    model = fit(vectors, n_lists)
    rows = spark.createDataFrame([], _ROWS) if model is None else file_rows(vectors, model).repartitionByRange("list", F.xxhash64("chunk_id"))
    rows.write.partitionBy("list").parquet(f"{path}/rows")
    # Tables of at most MAX_LISTS centres and CODES entries per group.
    centres = [] if model is None else [(i, c.tolist()) for i, c in enumerate(model.centres)]
    books = [] if model is None else [(p, b.tolist()) for p, b in enumerate(model.books)]
    spark.createDataFrame(centres, "list int, centre array<double>").write.parquet(f"{path}/centres")
    spark.createDataFrame(books, "part int, book array<array<double>>").write.parquet(f"{path}/books")
    read(spark, path, with_angles=False).rows.groupBy("list").agg(F.max("angle").alias("angle")).write.parquet(f"{path}/angles")
    return read(spark, path)


def read(spark: SparkSession, path: str, with_angles: bool = True) -> VectorIndex:
    # The schema names the partition column last, as the files do not hold it.
    rows = spark.read.schema("chunk_id string, code binary, embedding array<double>, angle double, list int").parquet(f"{path}/rows")
    centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()]
    books = [np.array(r["book"]) for r in spark.read.parquet(f"{path}/books").orderBy("part").collect()]
    angles = np.zeros(len(centres))
    if with_angles:
        for r in spark.read.parquet(f"{path}/angles").collect():
            angles[r["list"]] = r["angle"]
    return VectorIndex(rows, Model(np.array(centres), books, angles))


def _asked(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Names and unit vectors of the questions; a batch of them is held by every task."""
    rows = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("string"), F.col("embedding").cast("array<double>")).collect()
    if not rows:
        return np.empty(0, dtype=object), np.empty((0, 0))
    x = _unit_rows(np.array([r[1] for r in rows]).ravel(), len(rows))
    good = np.isfinite(x).all(axis=1)
    return np.array([r[0] for r in rows], dtype=object)[good], x[good]


def candidates(index: VectorIndex, names: np.ndarray, asked: np.ndarray, probes: int, k: int) -> DataFrame:
    """``query_id, chunk_id, score`` of the ``k`` best rows by code in each question's ``probes`` nearest lists; vectors are not read."""
    model = index.model
    near = asked @ model.centres.T
    lists = np.argsort(-near, axis=1, kind="stable")[:, :probes]
    wanted = np.zeros(near.shape, dtype=bool)
    np.put_along_axis(wanted, lists, True, axis=1)
    tables = [asked[:, g] @ b.T for g, b in zip(model.groups(), model.books)]
    shared = index.rows.sparkSession.sparkContext.broadcast((names, near, wanted, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_, near_, wanted_, tables_ = shared.value
        bests = blocks(len(names_), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(0).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(place), -1)
            ids = np.array(batch.column(1).to_pylist(), dtype=object)
            for block, best in enumerate(bests):
                rows = slice(block * QUERY_BLOCK, (block + 1) * QUERY_BLOCK)
                scores = near_[rows][:, place]
                for p, table in enumerate(tables_):
                    scores = scores + table[rows][:, codes[:, p]]
                offer(best, scores, wanted_[rows][:, place], ids)
        yield from as_batches(bests, names_)

    probed = [int(i) for i in np.flatnonzero(wanted.any(axis=0))]
    rows = index.rows.where(F.col("list").isin(probed)).select("list", "chunk_id", "code")
    return top_ranked(rows.mapInArrow(run, OUT), k)


def search(index: VectorIndex, queries: DataFrame, k: int = K.TOP_K_RETRIEVAL, probes: int | None = None,
           refine: int = REFINE, exact: bool = False) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``k`` nearest rows found in the probed lists, with exact scores.

    ``exact`` then reads every list that may hold a better row, by the triangle
    inequality of angles.
    """
    spark = queries.sparkSession
    names, asked = _asked(queries)
    n_lists = len(index.model.centres)
    if not n_lists or not len(names):
        return top_ranked(spark.createDataFrame([], OUT), k)
    found = candidates(index, names, asked, min(probes or max(1, n_lists // 2), n_lists), k * refine)
    ids = found.select("chunk_id").distinct()
    near = asked @ index.model.centres.T
    chosen = np.argsort(-near, axis=1, kind="stable")[:, :min(probes or max(1, n_lists // 2), n_lists)]
    rows = index.rows.where(F.col("list").isin([int(i) for i in np.unique(chosen)])).select("chunk_id", "embedding")
    best = dense_topk(queries, join_small(rows, ids, ["chunk_id"], spread=F.xxhash64("chunk_id")), k)
    if not exact:
        return best
    # At most one row per question.
    last = {r["query_id"]: r["score"] for r in best.where(F.col("rank") == k).select("query_id", "score").collect()}
    floor = np.array([last.get(name, -1.0) for name in names])
    reach = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - index.model.angles, 0))
    open_ = np.flatnonzero((reach >= floor[:, None] - 1e-6).any(axis=0))
    return dense_topk(queries, index.rows.where(F.col("list").isin([int(i) for i in open_])).select("chunk_id", "embedding"), k)
