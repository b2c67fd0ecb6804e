"""Mixture-controlled packing: deficit round-robin over source queues fills every window.

Every source is a queue of documents. A window of 4,096 tokens takes from each
queue its share of all tokens; what a queue gets too little or too much in one
window, a quantum of tokens at most, is carried to the next. Serving
quantum ``m`` of a queue with ``T`` tokens falls due at ``(m + 1/2) * quantum / T``;
the order of these times is the round-robin's order with all deficits carried,
and it can be entered anywhere: which window a token belongs to follows from
the queue totals alone. So each task cuts its own documents, and nothing but
sums per (task, source) passes between tasks. Windows are full but the last.

Two passes: the first encodes and writes token ids with running sums per
source, the second reads them with the offsets of its part. No text moves.

Null and empty texts are documents of the end id alone. The null source is a
queue of its own. Every row is a document, also where ids repeat or are null.

Any number of sources: the ``MAX_QUEUES - 1`` largest have queues of their own. The
documents of the others stand in one more, not source after source but by their
own due times, the share of their source's tokens that lies before them, so every
stretch of that queue holds those sources in proportion as well. It is
range-sorted and numbered by prefix sums in Spark. A source's due times start at a
hash of its name, so that sources of one document spread evenly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.common import small
from litspark.llm.tokens import WordEncoder
from litspark.llm.words import slabs, tidy
from litspark.session import arrow_batches, store

LENGTH = 4096
QUANTUM = 64
MAX_QUEUES = 512
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SLAB_BYTES = 4 << 20
#: Tokens of a range of the common queue, and cells (windows by queues) planned at once.
RANGE_TOKENS, CELLS = 4_000_000, 500_000


class Schedule:
    """Due times of the queues' quanta, and what each queue has given before a window."""

    def __init__(self, totals: list[int], length: int = LENGTH, quantum: int = QUANTUM) -> None:
        self.t = np.array(totals, dtype=np.int64)
        self.length, self.q = length, quantum
        self.blocks = -(-self.t // quantum)
        self.all = int(self.t.sum())

    def _due(self, m: np.ndarray, s: np.ndarray | slice) -> np.ndarray:
        return (m + 0.5) * self.q / self.t[s]

    def _before(self, v: np.ndarray, upto: bool = False) -> np.ndarray:
        """Quanta per queue due before ``v`` (``upto``: or at ``v``); shape (len(v), queues)."""
        v = v[:, None]
        m = np.clip(np.floor(v * self.t / self.q - 0.5).astype(np.int64), 0, self.blocks)
        test = np.less_equal if upto else np.less
        # The estimate is off by one at most; the due times themselves decide.
        every = slice(None)
        m = np.where((m > 0) & ~test(self._due(m - 1, every), v), m - 1, m)
        for _ in range(2):
            m = np.where((m < self.blocks) & test(self._due(m, every), v), m + 1, m)
        return m

    def _tokens(self, blocks: np.ndarray) -> np.ndarray:
        return np.minimum(blocks * self.q, self.t)

    def rank(self, s: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place of token ``i`` of queue ``s`` in the common order."""
        m = i // self.q
        v = self._due(m, s)
        low, high = self._tokens(self._before(v)), self._tokens(self._before(v, upto=True))
        earlier = np.where(np.arange(len(self.t)) < s[:, None], high, low)
        earlier[np.arange(len(s)), s] = m * self.q
        return earlier.sum(axis=1) + i - m * self.q

    def given(self, windows: np.ndarray) -> np.ndarray:
        """Tokens each queue has given before each window; shape (windows, queues)."""
        x = np.minimum(windows * self.length, self.all)
        lo, hi = np.zeros(len(x)), np.full(len(x), 2.0 + self.q)
        for _ in range(120):
            mid = lo + (hi - lo) / 2
            under = self._tokens(self._before(mid)).sum(axis=1) <= x
            lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
            if (np.nextafter(lo, 9.0) >= hi).all():
                break
        low = self._tokens(self._before(lo))
        due_now = self._tokens(self._before(lo, upto=True)) - low
        rest = (x - low.sum(axis=1))[:, None]
        return low + np.clip(rest - (np.cumsum(due_now, axis=1) - due_now), 0, due_now)


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Stored ``part, id, source, n, before, ids``: ``before`` counts the source's earlier tokens in its part."""
    schema = "part int, _id long, _source string, n long, before long, ids binary"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, sums = TaskContext.get().partitionId(), WordEncoder(tokenizer), {}
        for batch in batches:
            for at, _, offsets in slabs(batch.column(1), SLAB_BYTES):
                rows = batch.slice(at, len(offsets) - 1)
                ids, ends = encoder.encode(rows.column(1), end_id)
                sources, before = rows.column(2).to_pylist(), []
                for name, n in zip(sources, np.diff(ends).tolist()):
                    before.append(sums.get(name, 0))
                    sums[name] = before[-1] + n
                kind = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
                packed, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                # A leading byte tells the width.
                blobs = [bytes([width]) + packed[a * width:b * width] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(blobs), part, np.int32)), rows.column(0), rows.column(2),
                     pa.array(np.diff(ends)), pa.array(before, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["part", "_id", "_source", "n", "before", "ids"])

    # A batch of 10,000 texts would stand in the JVM, on its way and in Python at once.
    with arrow_batches(docs.sparkSession, SLAB_BYTES):
        return store(docs.mapInArrow(run, schema), "pack-ids")


def _pieces(plan: Schedule, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Pieces of documents that lie at ``start`` in their queues."""
    first, last = plan.rank(queue, start) // plan.length, plan.rank(queue, start + n - 1) // plan.length
    spans = last - first + 1
    doc = np.repeat(np.arange(len(n)), spans)
    window = np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans) + first[doc]
    every, parts = np.unique(window), []
    step = max(16, CELLS // len(plan.t))
    for lo in range(0, len(every), step):
        # A text of any length: only so many windows are planned at once.
        own = every[lo:lo + step]
        at = np.flatnonzero((window >= own[0]) & (window <= own[-1]))
        edges = np.unique(np.concatenate([own, own + 1]))
        given = plan.given(edges)
        ahead = np.cumsum(np.diff(given, axis=0, append=given[-1:]), axis=1)
        row, q, d = np.searchsorted(edges, window[at]), queue[doc[at]], doc[at]
        a, b = given[row, q], given[np.searchsorted(edges, window[at] + 1), q]
        left, right = np.maximum(a, start[d]), np.minimum(b, start[d] + n[d])
        # Windows of ``own`` are followed by their ends, so the difference to the next row is the window's.
        found = np.stack([d, left - start[d], right - left, window[at], ahead[row, q] - (b - a) + left - a])
        parts.append(found[:, right > left])
    doc, first, size, window, offset = np.concatenate(parts, axis=1) if parts else np.empty((5, 0), np.int64)
    order = np.lexsort((window, doc))
    return {k: v[order] for k, v in {"doc": doc, "start": first, "length": size, "sequence_id": window, "offset": offset}.items()}


def _queued(encoded: DataFrame, max_queues: int) -> tuple[DataFrame, list[int]]:
    """``_id, _queue, _at, n, ids``: each document's place in its queue, and the queues' tokens."""
    key = F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")).alias("_key")
    sums = store(encoded.groupBy(key, "part").agg(F.sum("n").alias("n")), "pack-sums")
    totals = store(sums.groupBy("_key").agg(F.sum("n").alias("_all")), "pack-queues")
    more = totals.limit(max_queues + 1).count() > max_queues
    # At most ``max_queues`` sums.
    heads = totals.orderBy(F.desc("_all"), "_key").limit(max_queues - more).collect()
    earlier = Window.partitionBy("_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    numbers = encoded.sparkSession.createDataFrame([(r["_key"], i) for i, r in enumerate(heads)], "_key string, _queue long")
    bases = store(bases.join(totals, "_key").join(F.broadcast(numbers), "_key", "left"), "pack-bases")
    placed = encoded.withColumn("_key", key).join(small(bases), ["_key", "part"]).withColumn("_at", F.col("_base") + F.col("before"))
    own = placed.where("_queue is not null").select("_id", "_queue", "_at", "n", "ids")
    if not more:
        return own, [r["_all"] for r in heads]
    rest = totals.join(F.broadcast(numbers), "_key", "left_anti").agg(F.sum("_all")).first()[0]
    phase = F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) / (1 << 20)
    due = (F.col("_at") + phase * F.col("n")) / F.col("_all")
    tail = placed.where("_queue is null").select(due.alias("_due"), "_key", "_at", "_id", "n", "ids")
    schema = "part int, before long, _id long, n long, ids binary"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(before + np.cumsum(n) - n), *batch.columns[3:]],
                                             names=["part", "before", "_id", "n", "ids"])
            before += int(n.sum())

    ranged = tail.repartitionByRange(int(rest // RANGE_TOKENS) + 1, "_due", "_key", "_at").sortWithinPartitions("_due", "_key", "_at")
    ranged = store(ranged.mapInArrow(run, schema), "pack-common")
    # One row per range.
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.sum("n").alias("_n")).select("part", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_base"))
    common = ranged.join(small(store(starts, "pack-ranges")), "part").select(
        "_id", F.lit(len(heads)).cast("long").alias("_queue"), (F.col("_base") + F.col("before")).alias("_at"), "n", "ids")
    return own.unionByName(common), [*(r["_all"] for r in heads), rest]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", length: int = LENGTH,
         quantum: int = QUANTUM, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False,
         max_queues: int = MAX_QUEUES) -> DataFrame:
    """Per piece: id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, on request, its ``ids``."""
    encoded = _encoded(docs.select(F.col(id_col).cast("long"), F.col(text), F.col(source).cast("string")), tokenizer, end_id)
    placed, totals = _queued(encoded, max_queues)
    fields = [T.StructField(id_col, T.LongType()), *[T.StructField(c, T.LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    names = [f.name for f in fields]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(totals, length, quantum)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                queue, at, n = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
                found = _pieces(plan, queue, at, n)
                blobs = batch.column(4)
                doc, crcs, parts, seen, ids = found.pop("doc"), [], [], -1, None
                for d, a, k in zip(doc.tolist(), found["start"].tolist(), found["length"].tolist()):
                    if d != seen:
                        blob = blobs[d].as_buffer()
                        ids = np.frombuffer(blob, np.uint16 if blob[0] == b"\x02" or blob[0] == 2 else np.uint32, offset=1).astype("<u4")
                        seen = d
                    crcs.append(zlib.crc32(ids[a:a + k]))
                    if with_ids:
                        parts.append(ids[a:a + k].astype(np.int32))
                columns = [batch.column(0).take(pa.array(doc)), pa.array(found["start"]), pa.array(found["length"]),
                           pa.array(crcs, pa.int64()), pa.array(n[doc]), pa.array(found["sequence_id"]), pa.array(found["offset"])]
                if with_ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(run, T.StructType(fields))
