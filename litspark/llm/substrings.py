"""Removal of repeated substrings, by bucket-pointer refinement over sampled suffixes.

Every position's q-gram gives its first bucket identifier; pairing the
identifiers at i and at a later offset refines it to twice the length, and the
results are paired again: q, 2q, 4q, 8q = ``LENGTH`` bytes. Identifiers are hashes of
content, so the buckets of different tasks agree without an exchange.

Not all suffixes travel. Of the 4q-identifiers inside a window of ``LENGTH`` bytes
the smallest is its anchor, equal windows have equal anchors at equal offsets,
and neighbouring windows share one. One record per anchor is sorted by its
bucket and then by the identifiers around it: anchors whose whole
surroundings recur settle all their windows at once. Anchors that recur
with other surroundings are refined once more, window by window. Both rounds
combine inside a task first, so a string in very many places sends a record per
task, not per place. Of the texts only those move that have open windows, or
repeated spans in the end; a bitmap of hashed keys, of bounded size, tells them.

Bytes are UTF-8; null texts are empty. Matches never cross documents, and every
window is judged on the input. Rows that agree in id and text are
occurrences of each other. Texts shorter than ``LENGTH`` keep all. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.words import mix, raw, tidy
from litspark.session import store

#: Bytes of a repeated string: eight q-grams.
LENGTH = 200
#: A record tells in one byte how many windows share its anchor.
MAX_LENGTH = 504
#: Text per hash bucket, and records combined in a task before they are sent.
BUCKET_BYTES, COMBINED = 32 << 20, 150_000
#: Windows refined singly per hash bucket, at most.
BUCKET_WINDOWS = 1_000_000
#: A bucket that outgrows this is sorted in parts; what a part can't settle is refined by window.
BUCKET_RECORDS = 6_000_000
#: Text hashed at once.
SEGMENT = 1 << 18
#: Bits a key has in the bitmap of keys, and the bitmap's largest size: 4 MB.
KEY_BITS, MAX_BITS = 16, 1 << 25
_BITMAP_BITS = 1 << 15
_POS_BITS = np.uint64(22)
_C1, _C2, _C3 = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _C1)
RECORD = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8"), ("h", "<u4"), ("at", "<i4"), ("more", "u1"), ("many", "u1")])
SPAN = np.dtype([("id", "<i8"), ("h", "<u4"), ("first", "<i4"), ("last", "<i4"), ("many", "u1")])
_OUT = "kind int, bucket int, blob binary"
SETTLED, OPEN, SENT = 0, 1, 2
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _R), ("down", _R_INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def _pair(x: np.ndarray, y: np.ndarray, by: np.uint64 = _C1) -> np.ndarray:
    return mix(x * by + y)


def bucket_ids(data: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of the strings of half of ``length`` at every position."""
    q = length // 8
    if len(data) < 4 * q:
        return np.empty(0, dtype=np.uint64)
    up, down = _power(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:-1])])
    ids = mix((sums[q:] - sums[:-q]) * down[:len(sums) - q])
    for step in (q, 2 * q):
        ids = _pair(ids[:-step], ids[step:])
    return ids


def _full(ids: np.ndarray, at: np.ndarray, length: int, by: np.uint64 = _C1) -> np.ndarray:
    """Identifiers of the whole strings at some positions, from those of their halves."""
    return _pair(ids[at], ids[at + length // 2], by)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first and last window, anchor and surroundings identifiers."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    ids, width = bucket_ids(data, length), length // 2 + 1
    low = (np.uint64(1) << _POS_BITS) - np.uint64(1)
    least = (ids & ~low) | np.arange(len(ids), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span:width - span + n]) & low
    begins = np.ones(n, dtype=bool)
    begins[1:] = least[1:] != least[:-1]
    begins[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(begins)
    row = np.searchsorted(offsets, start, "right") - 1
    last = offsets[row + 1] - length
    end = np.minimum(np.append(start[1:] - 1, n - 1), last)
    keep = start <= last
    start, end, row = start[keep], end[keep], row[keep]
    around = mix(_full(ids, start, length) * _C2 + _full(ids, end, length) + (end - start).astype(np.uint64))
    return row, start, end, ids[least[start].astype(np.int64)], around


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, first byte in the row) of bounded pieces; long texts overlap by a window."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, "right")) - 1)
        a, b = offsets[at], offsets[end]
        if b - a <= 2 * SEGMENT:
            yield data[a:b], offsets[at:end + 1] - a, np.arange(at, end), np.zeros(end - at, np.int64)
        else:
            for lo in range(int(a), int(b) - length + 1, SEGMENT):
                hi = min(lo + SEGMENT + length - 1, int(b))
                yield data[lo:hi], np.array([0, hi - lo]), np.array([at]), np.array([lo - a])
        at = end


def _merge(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    head = np.flatnonzero(np.append(True, start[1:] > stop[:-1])) if len(start) else np.empty(0, np.int64)
    return start[head], stop[np.append(head[1:] - 1, len(start) - 1)] if len(start) else stop


def _home(ids: np.ndarray, hs: np.ndarray, homes: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) ^ (hs.astype(np.uint64) << np.uint64(32))) >> np.uint64(20)) % np.uint64(homes)


def _to_docs(found: np.ndarray, kind: int, homes: int, length: int) -> list[tuple]:
    """A row per home of documents: their merged spans, or (first, last, many) of open runs."""
    if not len(found):
        return []
    found = found[np.lexsort((found["at"], found["h"], found["id"]))]
    out = np.empty(len(found), dtype=SPAN)
    out["id"], out["h"], out["first"], out["many"] = found["id"], found["h"], found["at"], found["many"]
    out["last"] = found["at"].astype(np.int64) + found["more"] + (length if kind == SETTLED else 0)
    if kind == SETTLED:
        new = np.append(False, (out["id"][1:] != out["id"][:-1]) | (out["h"][1:] != out["h"][:-1]))
        base = np.cumsum(new) << 32
        reach = np.maximum.accumulate(base + out["last"])
        head = np.flatnonzero(np.append(True, (base + out["first"])[1:] > reach[:-1]))
        out = out[head]
        out["last"] = (reach & 0xFFFFFFFF)[np.append(head[1:] - 1, len(found) - 1)]
    home = _home(out["id"], out["h"], homes)
    order = np.argsort(home, kind="stable")
    out, cut = out[order], np.searchsorted(home[order], np.arange(homes + 1))
    return [(kind, k, out[cut[k]:cut[k + 1]].tobytes()) for k in range(homes) if cut[k] < cut[k + 1]]


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by both identifiers, and where their runs of both begin."""
    found = found[np.lexsort((found["b"], found["a"]))]
    new = np.append(True, (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1]))
    return found, np.flatnonzero(new)


def _settle(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted records, whether each recurs as a whole, and the first of each run."""
    found, heads = _runs(found)
    sizes = np.diff(np.append(heads, len(found)))
    many = (sizes > 1) | (np.maximum.reduceat(found["many"], heads) > 0)
    first = np.zeros(len(found), dtype=bool)
    first[heads] = True
    return found, np.repeat(many, sizes), first


def _combine(parts: list[np.ndarray], buckets: int, homes: int, length: int) -> list[tuple]:
    """Settles what recurs inside a task; sends one record of each string on to its bucket."""
    found, many, first = _settle(np.concatenate(parts))
    out = _to_docs(found[many], SETTLED, homes, length)
    sent = found[first].copy()
    sent["many"] = many[first]
    bucket = (sent["a"] >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    sent = sent[order]
    return out + [(SENT, k, sent[cut[k]:cut[k + 1]].tobytes()) for k in range(buckets) if cut[k] < cut[k + 1]]


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 200):
        cols = list(zip(*rows[lo:lo + 200]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()))],
                                         names=["kind", "bucket", "blob"])


def _in_buckets(sent: DataFrame, homes: int, length: int, windows: bool) -> DataFrame:
    """Second half of a round: each bucket's records meet; settled spans pass through.

    ``windows``: records are single windows, and what doesn't recur is unique.
    Otherwise an anchor that recurs with other surroundings stays open.
    """
    place = F.when(F.col("kind") == SENT, F.col("bucket")).otherwise(-1 - F.col("bucket"))
    ordered = sent.withColumn("_place", place).repartition("_place").sortWithinPartitions("_place").drop("_place")

    def decide(parts: list[np.ndarray], partial: bool) -> list[tuple]:
        found, many, first = _settle(np.concatenate(parts))
        out = _to_docs(found[many], SETTLED, homes, length)
        if windows:
            return out
        # A bucket with more than one kind of surroundings.
        heads = np.flatnonzero(np.append(True, found["a"][1:] != found["a"][:-1]))
        kinds = np.add.reduceat(first.astype(np.int64), heads)
        open_ = (np.repeat(kinds, np.diff(np.append(heads, len(found)))) > 1) | partial
        left = found[open_ & first].copy()
        left["many"] = many[open_ & first]
        return out + _to_docs(left, OPEN, homes, length)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size, partial = None, [], 0, False
        for batch in batches:
            kinds, buckets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            through = batch.filter(pa.array(kinds != SENT))
            if through.num_rows:
                yield through
            for i in np.flatnonzero(kinds == SENT):
                if buckets[i] != now or (not windows and size > BUCKET_RECORDS):
                    partial = partial or buckets[i] == now
                    if parts:
                        yield from _batches(decide(parts, partial))
                    partial = partial and buckets[i] == now
                    now, parts, size = buckets[i], [], 0
                parts.append(np.frombuffer(batch.column(2)[int(i)].as_buffer(), RECORD))
                size += len(parts[-1])
        if parts:
            yield from _batches(decide(parts, partial))

    return ordered.mapInArrow(run, _OUT)


def _records(a: np.ndarray, b: np.ndarray, ids: np.ndarray, hs: np.ndarray, at: np.ndarray, more: np.ndarray, many) -> np.ndarray:
    out = np.empty(len(a), dtype=RECORD)
    for name, value in (("a", a), ("b", b), ("id", ids), ("h", hs), ("at", at), ("more", more), ("many", many)):
        out[name] = value
    return out


def _anchor_round(keyed: DataFrame, buckets: int, homes: int, length: int) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            data, offsets = raw(batch.column(2))
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for piece, cuts, rows, shift in segments(data, offsets, length):
                row, start, end, bucket, around = anchors(piece, cuts, length)
                at = start - cuts[row] + shift[row]
                doc = rows[row]
                parts.append(_records(bucket, around, ids[doc], hs[doc], at, end - start, 0))
                size += len(row)
                if size >= COMBINED:
                    yield from _batches(_combine(parts, buckets, homes, length))
                    parts, size = [], 0
        if size:
            yield from _batches(_combine(parts, buckets, homes, length))

    return _in_buckets(keyed.mapInArrow(run, _OUT), homes, length, windows=False)


def _window_round(opened: DataFrame, buckets: int, homes: int, length: int) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            data, offsets = raw(batch.column(2))
            for i in range(batch.num_rows):
                own, runs = data[offsets[i]:offsets[i + 1]], np.frombuffer(batch.column(3)[i].as_py(), "<i4").reshape(-1, 3)
                for first, last, many in runs.tolist():
                    near = own[first:last + length]
                    halves, at = bucket_ids(near, length), np.arange(last - first + 1)
                    parts.append(_records(_full(halves, at, length), _full(halves, at, length, _C3), batch.column(0)[i].as_py(),
                                          batch.column(1)[i].as_py(), at + first, 0, many))
                    size += len(at)
                    if size >= COMBINED:
                        yield from _batches(_combine(parts, buckets, homes, length))
                        parts, size = [], 0
        if size:
            yield from _batches(_combine(parts, buckets, homes, length))

    return _in_buckets(opened.mapInArrow(run, _OUT), homes, length, windows=True)


def _gathered(found: DataFrame) -> DataFrame:
    """``_id, _h, runs``: a row per document with its (first, last, many) in order, as 32-bit numbers."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            own = np.unique(np.concatenate(parts))
            cut = np.flatnonzero(np.append(True, (own["id"][1:] != own["id"][:-1]) | (own["h"][1:] != own["h"][:-1])))
            triples = np.stack([own["first"], own["last"], own["many"].astype(np.int32)], axis=1).astype("<i4")
            blobs = [triples[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(own)))]
            for lo in range(0, len(cut), 5000):
                at = cut[lo:lo + 5000]
                yield pa.RecordBatch.from_arrays([pa.array(own["id"][at]), pa.array(own["h"][at].astype(np.int64)), pa.array(blobs[lo:lo + 5000], pa.binary())],
                                                 names=["_id", "_h", "runs"])

        now, parts = None, []
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != now and parts:
                    yield from flush(parts)
                    parts = []
                now = k
                parts.append(np.frombuffer(blob.as_buffer(), SPAN))
        if parts:
            yield from flush(parts)

    return found.select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "_id long, _h long, runs binary")


def _among(keyed: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``keyed`` with ``_among``: false only where ``_id, _h`` is not among the ``n`` keys; a few others may be true."""
    bits = _BITMAP_BITS
    while bits < min(n * KEY_BITS, MAX_BITS):
        bits *= 2
    slot = 1 + F.pmod(F.xxhash64("_id", "_h"), F.lit(bits))
    number, at = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    # At most MAX_BITS / 8 bytes: 4,096 in a row.
    slots = keys.select(number.alias("_number"), at.alias("_at")).repartition("_number")
    bitmaps = slots.groupBy("_number").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return keyed.withColumn("_number", number).join(F.broadcast(bitmaps), "_number", "left").withColumn("_among", found).drop("_number", "_bits")


def repeated_spans(docs: DataFrame, id_col: str, text: str, length: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the keys ``_id, _h`` and ``_among`` (false: no spans), and per key its repeated spans."""
    if length % 8 or length > MAX_LENGTH:
        raise ValueError(f"length must be a multiple of 8 and at most {MAX_LENGTH}")
    keyed = docs.withColumns({
        "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "_h": F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1))})
    narrow = keyed.select("_id", "_h", text)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = int(total // BUCKET_BYTES) + 1
    found = store(_anchor_round(narrow, buckets, buckets, length), "substring-anchors")
    opened = store(_gathered(found.where(F.col("kind") == OPEN)), "substring-open")
    size, n = opened.agg(F.sum(F.octet_length("runs")), F.count("*")).first()
    parts = (size or 0) // 12 * (length // 2 + 1) // BUCKET_WINDOWS + 1
    texts = _among(narrow, opened, n).where("_among").drop("_among")
    windows = store(_window_round(texts.join(opened, ["_id", "_h"]), parts, buckets, length), "substring-windows")
    spans = store(_gathered(found.where(F.col("kind") == SETTLED).unionByName(windows)), "substring-spans")
    return _among(keyed, spans, spans.count()), spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", cleaned: str | None = "cleaned") -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256`` and, unless null, the cleaned text.

    The digest is of the remaining bytes. In the cleaned text, signs that a
    removal has cut in the middle go as a whole. Columns of ``docs`` that clash
    with a result column are replaced; without ``cleaned`` texts are not returned.
    """
    added = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", **({cleaned: "string"} if cleaned else {})}
    keyed, spans = repeated_spans(docs, id_col, text, length)
    carry = [f for f in docs.schema.fields if f.name not in added and (cleaned or f.name != text)]
    names = [f.name for f in carry]
    # Texts without spans stay where they lie.
    moved = keyed.where("_among").join(spans, ["_id", "_h"], "left").select(F.col(text).alias("_text"), "runs", *[f"`{n}`" for n in names])
    stay = keyed.where("not _among").select(F.col(text).alias("_text"), F.lit(None).cast("binary").alias("runs"), *[f"`{n}`" for n in names])
    source = moved.union(stay)
    schema = T.StructType([*carry, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in added.items())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(0))
            whole, blobs, rows = data.tobytes(), batch.column(1).to_pylist(), []
            for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), blobs):
                body, spans_ = whole[a:b], np.empty((0, 2), np.int64)
                if own:
                    every = np.frombuffer(own, "<i4").reshape(-1, 3).astype(np.int64)
                    spans_ = np.stack(_merge(every[:, 0], every[:, 1]), axis=1)
                edges = [0, *spans_.ravel().tolist(), b - a]
                kept = b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2]))
                row = [b - a, b - a - len(kept), len(spans_), hashlib.sha256(kept).hexdigest()]
                rows.append(row + [kept.decode("utf-8", "ignore")] * bool(cleaned))
            cols = [pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(zip(*rows))] or [
                pa.array([], pa.int64() if i < 3 else pa.string()) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *cols], names=[*names, *added])

    return source.mapInArrow(run, schema)
