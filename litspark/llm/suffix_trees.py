"""Removal of passages that stand in an earlier document, by prefix-partitioned suffix trees over words.

A window is ``LENGTH`` consecutive words. A word goes if a window over it also
starts in a document with a smaller id. Suffixes are the windows' starts.
Neighbouring suffixes share most of their words, so they travel together: the
least five-word string (by hash) that begins among a window's first
``LENGTH // 2 + 1`` words is its pivot, equal windows have equal pivots, and a
record is a run of suffixes with one pivot and the words they need.

1. Records are counted by the 25 words from their pivot, which lie in all
   their windows. Strings that occur under one id only can't repeat elsewhere; their
   records go no further. Where all records of a string are equal as a whole,
   they are one leaf of the tree and the smallest id alone decides.
2. Of the others, one record per whole text goes on, split by variable-length
   prefixes at the pivot: 5 words if those hold at most ``GROUP_RECORDS`` records,
   else 25, else the whole window. So every group fits a task, whatever a
   common passage's frequency.
3. A group's words form a suffix tree: its suffixes are sorted by prefix doubling
   over word numbers, and neighbours that agree in ``LENGTH`` words or more hang
   below one deep internal node, a repeat. All leaves whose id isn't the node's
   smallest are removed. A prefix as long as the window is such a node already,
   and only its smallest id is needed.

Equal records meet in aggregations, which combine inside tasks, so a passage in a
third of all documents is a row per task. Hashes of 128 bits stand for whole
records and whole windows; inside a tree words are compared as they are. Memory
is bounded by a group and by the longest text. The texts are shuffled once, and
read from that shuffle for the records and for the result.

Null and empty texts have no words. Null ids count as larger than all others;
rows with one id never remove one another's words, in repeats inside one
document neither. Rows that agree in id and text share their result. Texts
shorter than a window keep all words. Extra columns pass through, those that
clash with a result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm import words as W
from litspark.llm.periodic_runs import _row_texts
from litspark.session import store

#: Words of a window.
LENGTH = 50
#: Prefix lengths below the whole window: of pivots, and of what is counted.
SHORT, LONG = 5, 25
#: Records of one prefix that a group may hold, and of a shuffle bucket.
GROUP_RECORDS, BUCKET_RECORDS = 20_000, 100_000
#: Words of a tree.
TREE_WORDS = 1_500_000
#: Suffixes hashed at once.
SEGMENT = 1 << 20
_LAST_ID = (1 << 63) - 1
_WIDE = np.uint64(0x9E3779B97F4A7C15)
BY_SHORT, BY_LONG, WHOLE = 0, 1, 2
#: A key's upper bits tell the short prefix, so longer prefixes extend shorter ones.
_SHORT_SHIFT = 40
_RECORD = "bucket int, prefix long, _id long, _h long, first int, last int, body string"
_RECORD_ARROW = pa.schema([("bucket", pa.int32()), ("prefix", pa.int64()), ("_id", pa.int64()), ("_h", pa.int64()),
                           ("first", pa.int32()), ("last", pa.int32()), ("body", pa.string())])
_SPAN = ("_id", "_h", "first", "last")


def _hash_at(hashes: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``n`` words from each position."""
    total = np.full(len(at), seed, dtype=np.uint64)
    for k in range(n):
        total = total * _WIDE + hashes[at + k]
    return W.mix(total)


def pivots(hashes: np.ndarray, rows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one row with one pivot: first and last window, and the pivot, as word places."""
    out, reach = [], length - LONG + 1
    low = np.uint64((1 << 21) - 1)
    for lo in range(0, max(len(hashes) - length + 1, 0), SEGMENT):
        own = hashes[lo:lo + SEGMENT + length - 1]
        n = len(own) - length + 1
        least = np.zeros(len(own) - SHORT + 1, dtype=np.uint64)
        for k in range(SHORT):
            least = least * _WIDE + own[k:len(own) - SHORT + 1 + k]
        # Ties go to the leftmost: the place stands in the lowest bits.
        least = (W.mix(least) & ~low) | np.arange(len(least), dtype=np.uint64)
        span = 1
        while span * 2 <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        place = (np.minimum(least[:n], least[reach - span:reach - span + n]) & low).astype(np.int64) + lo
        start = np.arange(lo, lo + n)
        whole = rows[start] == rows[start + length - 1]
        new = whole & np.append(True, ~whole[:-1] | (place[1:] != place[:-1]) | (rows[start[1:]] != rows[start[:-1]]))
        close = whole & np.append(new[1:] | ~whole[1:], True)
        out.append((start[new], start[close], place[new]))
    return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), (), ())))


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    start, end, row = W.word_spans(data, offsets)
    return start, end, row, W.span_hashes(data, start, end), np.searchsorted(row, np.arange(len(offsets) - 1))


def _keys(hashes: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << _SHORT_SHIFT) - 1)
    return ((_hash_at(hashes, pivot, SHORT) & ~low) | (_hash_at(hashes, pivot, LONG) & low)).view(np.int64)


def _run_hashes(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of ``size`` words from each position."""
    total, at = np.zeros(len(first), dtype=np.uint64), np.arange(len(first))
    for k in range(int(size.max()) if len(size) else 0):
        at = at[size[at] > k]
        total[at] = total[at] * _WIDE + hashes[first[at] + k]
    return W.mix(total + size.astype(np.uint64))


def _records(keyed: DataFrame, length: int) -> DataFrame:
    """``_id, _h, key, whole, place`` of every record: hashes from the pivot and of all words; ``place`` packs first window, windows less one and pivot."""
    @W.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.slabs(batch.column(2)):
                part = batch.slice(at, len(offsets) - 1)
                _, _, row, hashes, base = _hashed(data, offsets)
                first, last, pivot = pivots(hashes, row, length)
                own = row[first]
                place = ((first - base[own]) << 16) | ((last - first) << 8) | (pivot - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array(_keys(hashes, pivot)),
                     pa.array(_run_hashes(hashes, first, last - first + length).view(np.int64)), pa.array(place)],
                    names=["_id", "_h", "key", "whole", "place"])

    return store(keyed.mapInArrow(run, "_id long, _h long, key long, whole long, place long"), "suffix-records")


def shared_records(records: DataFrame) -> DataFrame:
    """Records whose key stands under more than one id, with its smallest id and whether all of them are equal."""
    keys = records.groupBy("key").agg(F.min("_id").alias("least"), F.max("_id").alias("_most"), F.min("whole").alias("_a"), F.max("whole").alias("_b"))
    keys = store(keys.where("least < _most").select("key", "least", (F.col("_a") == F.col("_b")).alias("same")), "suffix-keys")
    return store(records.join(keys, "key"), "suffix-found")


def planned(wholes: DataFrame, group_records: int = GROUP_RECORDS) -> DataFrame:
    """``key, n, ladder`` for ``wholes(key, whole)``: which prefix length keeps the group in a task."""
    keys = wholes.groupBy("key").agg(F.count("*").alias("n")).withColumn("_short", F.shiftright("key", _SHORT_SHIFT))
    fit = keys.groupBy("_short").agg(F.sum("n").alias("_all")).where(F.col("_all") <= group_records).select("_short", F.lit(True).alias("_fits"))
    ladder = F.when(F.col("_fits"), BY_SHORT).when(F.col("n") <= group_records, BY_LONG).otherwise(WHOLE)
    return store(keys.join(fit, "_short", "left").select("key", "n", ladder.alias("ladder")), "suffix-prefixes")


def _windows_of(found: DataFrame) -> DataFrame:
    first = F.shiftright("place", 16)
    return found.select("_id", "_h", first.cast("int").alias("first"), (first + F.shiftright("place", 8).bitwiseAND(255)).cast("int").alias("last"))


def _listed(asked: DataFrame, keyed: DataFrame) -> DataFrame:
    """``keyed`` with the packed places of each document's records. All columns stay, so that the result's join shares the exchange."""
    places = asked.groupBy("_id", "_h").agg(F.collect_list((F.col("place") * 4 + F.col("ladder"))).alias("places"))
    return keyed.join(places, ["_id", "_h"]).select("_id", "_h", "_text", "places", *keyed.columns[3:])


def _documents(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Slabs of documents with their words and listed records: row, first window, windows less one, pivot and ladder."""
    for at, data, offsets in W.slabs(batch.column(2)):
        part = batch.slice(at, len(offsets) - 1)
        start, end, _, hashes, base = _hashed(data, offsets)
        sizes = np.diff(part.column(3).offsets.to_numpy())
        packed = part.column(3).flatten().to_numpy()
        own = np.repeat(np.arange(len(sizes)), sizes)
        ladder, place = packed & 3, packed >> 2
        first = (place >> 16) + base[own]
        yield part, data.tobytes(), start, end, hashes, (own, first, (place >> 8) & 255, first + (place & 255), ladder, base[own])


def _sent(listed: DataFrame, buckets: int, length: int) -> DataFrame:
    """The records asked for, with their words, by group."""
    @W.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, start, end, hashes, (own, first, more, pivot, ladder, base) in _documents(batch):
                keep = np.flatnonzero(ladder != WHOLE)
                own, first, more, pivot, ladder, base = (x[keep] for x in (own, first, more, pivot, ladder, base))
                key = _keys(hashes, pivot)
                prefix = np.where(ladder == BY_SHORT, key >> _SHORT_SHIFT, key)
                for lo in range(0, len(own), 2000):
                    some = slice(lo, lo + 2000)
                    bodies = [b" ".join([data[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist())])
                              for a, b in zip(first[some].tolist(), (first + more + length)[some].tolist())]
                    rows, at = pa.array(own[some]), first[some] - base[some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((prefix[some] % buckets).astype(np.int32)), pa.array(prefix[some]), part.column(0).take(rows), part.column(1).take(rows),
                         pa.array(at.astype(np.int32)), pa.array((at + more[some]).astype(np.int32)), pa.array(bodies, pa.binary()).cast(pa.string())],
                        schema=_RECORD_ARROW)

    return listed.mapInArrow(run, _RECORD)


def deep_nodes(text: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix, the number of the tree's topmost node of at least ``depth`` words above it, in suffix order.

    Prefix doubling: ranks of 2h words from pairs of ranks of h words.
    """
    rank, h = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while h * 2 <= depth:
        pair = rank * (int(rank.max()) + 2)
        pair[:-h] += rank[h:] + 1
        rank, h = np.unique(pair, return_inverse=True)[1].astype(np.int64), h * 2
    top = rank[suffixes] * (int(rank.max()) + 1) + rank[suffixes + depth - h]
    return np.unique(top, return_inverse=True)[1]


def group_repeats(ids: np.ndarray, bodies: pa.Array, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record, first and last window of the runs whose node has a smaller id below it."""
    distinct = bodies.dictionary_encode()
    text = distinct.indices.to_numpy().astype(np.int64)
    data, offsets = W.raw(distinct.dictionary)
    start, end, row = W.word_spans(data, offsets)
    size = np.bincount(row, minlength=len(distinct.dictionary))
    # Words by number: equal numbers are equal words.
    whole = data.tobytes()
    numbers: dict[bytes, int] = {}
    word = np.fromiter((numbers.setdefault(whole[a:b], len(numbers)) for a, b in zip(start.tolist(), end.tolist())), np.int64, len(start))
    base, windows = np.cumsum(size) - size, size - length + 1
    owner = np.repeat(np.arange(len(size)), windows)
    suffix = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + base[owner]
    node = deep_nodes(word, suffix, length)
    smallest = np.full(len(size), _LAST_ID, dtype=np.int64)
    np.minimum.at(smallest, text, ids)
    least = np.full(int(node.max()) + 1, _LAST_ID, dtype=np.int64)
    np.minimum.at(least, node, smallest[owner])
    bound = least[node]
    # Every record looks up its text's leaves.
    count = windows[text]
    record = np.repeat(np.arange(len(text)), count)
    within = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
    gone = ids[record] > bound[(np.cumsum(windows) - windows)[text[record]] + within]
    head = gone & ~(np.append(False, gone[:-1]) & (within > 0))
    tail = gone & ~(np.append(gone[1:], False) & np.append(within[1:] > 0, False))
    return record[head], within[head], within[tail]


def _in_trees(sent: DataFrame, length: int, tree_words: int) -> DataFrame:
    """Spans ``_id, _h, first, last`` of windows to remove."""
    def decide(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids, hs, first = (rows.column(c).to_numpy() for c in ("_id", "_h", "first"))
        record, a, b = group_repeats(ids, rows.column("body").combine_chunks(), length)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[record], hs[record], (first[record] + a).astype(np.int32),
                                                                 (first[record] + b).astype(np.int32))], names=list(_SPAN))

    @W.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, now = [], 0, None
        for batch in batches:
            prefix, at = batch.column(1).to_numpy(), 0
            words = np.cumsum(batch.column(5).to_numpy().astype(np.int64) - batch.column(4).to_numpy() + length)
            for cut in [*(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1).tolist(), len(prefix)] if len(prefix) else []:
                if parts and prefix[at] != now and size > tree_words:
                    yield decide(parts)
                    parts, size = [], 0
                parts.append(batch.slice(at, cut - at))
                size += int(words[cut - 1] - (words[at - 1] if at else 0))
                now, at = prefix[cut - 1], cut
        if parts:
            yield decide(parts)

    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "prefix")
    return dealt.mapInArrow(run, "_id long, _h long, first int, last int")


def _whole_windows(listed: DataFrame, length: int) -> DataFrame:
    """Spans of windows under prefixes too common for a group: the prefix is the window itself."""
    @W.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, _, hashes, (own, first, more, _, ladder, base) in _documents(batch):
                hot = ladder == WHOLE
                own, first, n, base = own[hot], first[hot], more[hot] + 1, base[hot]
                record = np.repeat(np.arange(len(own)), n)
                at = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n) + first[record]
                for lo in range(0, len(at), SEGMENT):
                    some, rows = at[lo:lo + SEGMENT], pa.array(own[record[lo:lo + SEGMENT]])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(rows), part.column(1).take(rows), pa.array((some - base[record[lo:lo + SEGMENT]]).astype(np.int32)),
                         pa.array(_hash_at(hashes, some, length).view(np.int64)), pa.array(_hash_at(hashes, some, length, 1).view(np.int64))],
                        names=["_id", "_h", "first", "k1", "k2"])

    windows = store(listed.mapInArrow(run, "_id long, _h long, first int, k1 long, k2 long"), "suffix-windows")
    nodes = windows.groupBy("k1", "k2").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).where("_least < _most")
    nodes = store(nodes.select("k1", "k2", "_least"), "suffix-nodes")
    return windows.join(nodes, ["k1", "k2"]).where("_id > _least").select("_id", "_h", "first", F.col("first").alias("last"))


def repeated_windows(keyed: DataFrame, length: int, group_records: int, tree_words: int) -> DataFrame:
    """``_id, _h, first, last``: runs of windows that also start under a smaller id."""
    found = shared_records(_records(keyed.select("_id", "_h", "_text"), length))
    mixed = found.where("not same").drop("least", "same")
    wholes = store(mixed.groupBy("key", "whole").agg(F.min("_id").alias("least")), "suffix-wholes")
    prefixes = planned(wholes, group_records)
    sums = {r["hot"]: r["n"] for r in prefixes.groupBy((F.col("ladder") == WHOLE).alias("hot")).agg(F.sum("n").alias("n")).collect()}
    leaves = store(mixed.join(wholes, ["key", "whole"]).select("_id", "_h", "key", "place", "least"), "suffix-leaves")
    settled = _windows_of(found.where("same and _id > least")).unionByName(_windows_of(leaves.where("_id > least")))
    asked = leaves.where("_id = least").join(prefixes.select("key", "ladder"), "key")
    buckets = sums.get(False, 0) // BUCKET_RECORDS + 1
    spans = settled.unionByName(_in_trees(_sent(_listed(asked.where(F.col("ladder") != WHOLE), keyed), buckets, length), length, tree_words))
    if sums.get(True):
        spans = spans.unionByName(_whole_windows(_listed(asked.where(F.col("ladder") == WHOLE), keyed), length))
    return spans


def remove_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", kept: str = "kept_text",
                    group_records: int = GROUP_RECORDS, tree_words: int = TREE_WORDS) -> DataFrame:
    """``docs`` with ``n_words, n_removed`` and the kept words, joined by one space."""
    if length < 2 * LONG:
        raise ValueError(f"length must be at least {2 * LONG}")
    added = {"n_words": T.LongType(), "n_removed": T.LongType(), kept: T.StringType()}
    carry = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in carry]
    others = [F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names) if n != text]
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("_id"), F.xxhash64(text).alias("_h"),
                        F.col(text).alias("_text"), *others)
    spans = repeated_windows(keyed, length, group_records, tree_words)
    lists = spans.groupBy("_id", "_h").agg(F.collect_list(F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")).alias("_spans"))
    source = keyed.join(lists, ["_id", "_h"], "left").select("_text", "_spans", *[f"_c{i}" for i, n in enumerate(names) if n != text])
    schema = T.StructType([*carry, *(T.StructField(n, t) for n, t in added.items())])

    @W.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.slabs(batch.column(0)):
                part = batch.slice(at, len(offsets) - 1)
                start, end, row = W.word_spans(data, offsets)
                n = len(offsets) - 1
                base = np.searchsorted(row, np.arange(n))
                own = part.column(1)
                sizes = np.diff(own.offsets.to_numpy())
                packed, doc = own.flatten().to_numpy(), np.repeat(np.arange(n), sizes)
                cover = np.zeros(len(start) + 1, dtype=np.int64)
                np.add.at(cover, base[doc] + (packed >> 32), 1)
                np.add.at(cover, base[doc] + (packed & 0xFFFFFFFF) + length, -1)
                keep = np.cumsum(cover)[:-1] == 0
                texts = _row_texts(data, start[keep], end[keep], row[keep], n)
                rest = iter(part.columns[2:])
                through = [part.column(0) if name == text else next(rest) for name in names]
                yield pa.RecordBatch.from_arrays(
                    [*through, pa.array(W.count_by(row, n)), pa.array(W.count_by(row[~keep], n)), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=[*names, *added])

    return source.mapInArrow(run, schema)
