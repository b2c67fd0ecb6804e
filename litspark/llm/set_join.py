"""Exact Jaccard join of word-shingle sets by prefix index lists with set-relation skipping.

A set's shingles are ordered by how common they are (counts of all shingles, in
hashed cells) and then by hash; sets that link share one of their first
n - ceil(0.8 n) + 1 shingles. Two relations between sets keep the index lists
short and the work off pairs that need none:

* Highly similar sets. Sets that agree in one of three minimum hashes are compared
  with one of their group, and those very close to it follow it from then on: a
  list holds one entry for all of them. Their other answers derive from their
  centre's by the triangle inequality of the Jaccard distance: a centre farther
  away than 0.2 and both radii rules out every member pair, a linked centre
  settles them all, and only in between are members compared, those the
  inequality allows. Candidates meet in blocks, and what earlier comparisons of a
  block have connected is not compared again.
* Position. List entries lie in order of set size, in blocks; a block whose sizes,
  or whose lengths before and behind the shared position, can't reach the overlap
  is skipped as a whole.

Every comparison counts the intersection exactly. Components of the links
come from star contraction. Nothing but counts per cell and small tables of
checked size reach the driver or are broadcast; hot centres are split by salts.

Words and sets are as in ``shingle_sets``; sets without a shingle link with
nothing. Null ids are kept, as rows of their own where nothing links them
(their component is null). Repeated rows are copies of each other. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import small
from litspark.llm.words import mix, slabs, span_hashes, tidy, window_hashes, word_spans
from litspark.session import store

#: Two sets link when their intersection holds at least so many hundredths of their union.
LINK = 80
WORDS = 5
CELL_BITS, CHUNK_BITS = 20, 14
#: Index entries per hash bucket, about; entries combined in a task; list blocks; members per salt of a centre.
BUCKET_ENTRIES, COMBINED, BLOCK, SALT_MEMBERS = 500_000, 150_000, 64, 2000
#: Pairs a task counts at once, offered and distinct ones; homes of pairs for each bucket of entries; bytes of blobs sent together.
OFFERED, PAIRS, PAIR_HOMES, BLOB_BYTES = 300_000, 1_000_000, 16, 1 << 20
BROADCAST_ROWS = 200_000
#: Sets this close to the head of their group follow it; sets of a comparison block.
FOLLOW_WITHIN, BLOCK_SETS = 0.05, 256
_SEEDS = tuple(np.uint64(x) for x in (0x51ED270B3F2A9A57, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_SIGN = np.uint64(0x8EBC6AF09C88C6E3)
ENTRY = np.dtype([("token", "<u4"), ("centre", "<i8"), ("n", "<u4"), ("at", "<u4"), ("many", "u1")])
PAIR = np.dtype([("y", "<i8"), ("x", "<i8"), ("c", "<u4"), ("nx", "<u4"), ("ny", "<u4"), ("many", "u1")])
SENT = np.dtype([("x", "<i8"), ("label", "<i8"), ("sub", "<i4")])
NONE = -(1 << 63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and shingle hashes, with repeats: five words each, or all words of a shorter text."""
    start, end, row = word_spans(data, offsets)
    words = span_hashes(data, start, end, fold=True)
    count = np.bincount(row, minlength=len(offsets) - 1)
    found = []
    for k in range(1, WORDS + 1):
        hashes, first = window_hashes(words, row, k)
        if k < WORDS:
            whole = count[row[first]] == k
            hashes, first = mix(hashes[whole] + np.uint64(k)), first[whole]
        found.append((row[first], hashes))
    rows, hashes = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(rows, kind="stable")
    return rows[order], hashes[order]


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])) if len(rows) else np.empty(0, bool)
    return rows[new], keys[new]


def need(n: np.ndarray) -> np.ndarray:
    """Smallest size of a set that can link with one of ``n``, and so the least overlap with it."""
    return -(-LINK * n // 100)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return -(-LINK * (a + b) // (100 + LINK))


def cell_levels(docs: DataFrame, text: str) -> np.ndarray:
    """How common the shingles of each hashed cell are, 0 for the ordinary, from counts over all texts."""
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in slabs(batch.column(0)):
                _, hashes = shingle_sets(data, offsets)
                cells += np.bincount((hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
        parts = np.split(cells, 1 << CELL_BITS - CHUNK_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary())],
                                         names=["part", "counts"])

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(blob, "<i4").astype(np.int64)
                sums[part] = sums[part] + own if part in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                             names=["part", "counts"])

    # A fixed number of counts, whatever the corpus holds.
    rows = docs.select(text).mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary").collect()
    cells = np.zeros(1 << CELL_BITS)
    for r in rows:
        at = r["part"] << CHUNK_BITS
        cells[at:at + (1 << CHUNK_BITS)] += np.frombuffer(r["counts"], np.int64)
    mean = max(cells.mean(), 1.0)
    level = np.where(cells > mean + 6 * mean ** 0.5 + 3, 1 + np.floor(2 * np.log2(np.maximum(cells / mean, 1))), 0)
    return np.minimum(level, 62).astype(np.uint8)


def _prefixes(docs: DataFrame, text: str, levels: np.ndarray) -> DataFrame:
    """Stored per row: set size, identity, three minimum hashes, and the first shingles in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    schema = "_key long, _h long, n long, sid long, k0 long, k1 long, k2 long, prefix binary"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value.astype(np.uint64)
        for batch in batches:
            for at, data, offsets in slabs(batch.column(2)):
                rows, hashes = shingle_sets(data, offsets)
                rank = (level[(hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)] << np.uint64(58)) | (hashes >> np.uint64(6))
                rows, rank = _distinct(rows, rank)
                n = np.bincount(rows, minlength=len(offsets) - 1)
                starts = (np.cumsum(n) - n)[n > 0]
                sid, keys = np.full(len(n), NONE, dtype=np.int64), np.zeros((3, len(n)), dtype=np.int64)
                if len(rows):
                    bare = rank & np.uint64((1 << 58) - 1)
                    sid[n > 0] = np.add.reduceat(mix(bare * _SIGN), starts).view(np.int64)
                    for k, seed in enumerate(_SEEDS):
                        keys[k, n > 0] = np.minimum.reduceat(mix(bare ^ seed), starts).view(np.int64)
                first = np.cumsum(n) - n
                size = np.where(n > 0, n - need(n) + 1, 0)
                blobs = [rank[a:a + p].tobytes() for a, p in zip(first.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), batch.column(1).slice(at, len(n)), pa.array(n), pa.array(sid), *map(pa.array, keys), pa.array(blobs, pa.binary())],
                    names=["_key", "_h", "n", "sid", "k0", "k1", "k2", "prefix"])

    return store(docs.select("_key", "_h", text).mapInArrow(run, schema), "join-prefixes")


def compare(pairs: DataFrame, docs: DataFrame, sets: DataFrame, text: str) -> DataFrame:
    """``pairs(x, y)`` with the exact intersection and sizes; ``sets(sid, _key, _h)`` names a row that holds each set.

    Every x sends its set to its y's; a hot y is split by salts.
    """
    pairs = store(pairs.select("x", "y").distinct(), "join-pairs")
    salts = pairs.groupBy("y").agg((F.floor(F.count("*") / SALT_MEMBERS) + 1).cast("int").alias("salts"))
    sends = pairs.join(small(salts, BROADCAST_ROWS), "y").groupBy(F.col("x").alias("sid")).agg(F.collect_list(F.struct("y", "salts")).alias("ys"))
    wanted = sends.join(salts.withColumnRenamed("y", "sid"), "sid", "full_outer").join(sets, "sid")
    wanted = store(wanted, "join-wanted")
    source = docs.select("_key", "_h", text).join(small(wanted, BROADCAST_ROWS), ["_key", "_h"]).select("sid", "ys", "salts", text)

    @tidy
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slabs(batch.column(3)):
                rows, hashes = shingle_sets(data, offsets)
                rows, bare = _distinct(rows, hashes >> np.uint64(6))
                n = np.bincount(rows, minlength=len(offsets) - 1)
                cut = np.concatenate([[0], np.cumsum(n)])
                part, out = batch.slice(at, len(n)), []
                for i, (sid, ys, salts_) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)))):
                    own = bare[cut[i]:cut[i + 1]]
                    # Rows may share an id; only the one that holds the set counts.
                    if len(own) and int(np.add.reduce(mix(own * _SIGN)).view(np.int64)) == sid:
                        blob = own.tobytes()
                        out += [(sid, s, 0, sid, blob) for s in range(salts_ or 0)]
                        out += [(y["y"], sid % y["salts"], 1, sid, blob) for y in ys or []]
                for lo in range(0, len(out), 500):
                    cols = list(zip(*out[lo:lo + 500]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                        pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["y", "salt", "role", "x", "members"])

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, last = None, None, None
        for batch in batches:
            out = []
            for y, salt, role, x, blob in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if role == 0:
                    now, own, last = (y, salt), np.frombuffer(blob, np.uint64), None
                elif (y, salt) == now and x != last:
                    other = np.frombuffer(blob, np.uint64)
                    at = np.searchsorted(own, other)
                    hit = int((own[np.minimum(at, len(own) - 1)] == other).sum())
                    out.append((x, y, hit, len(other), len(own)))
                    last = x
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["x", "y", "both", "nx", "ny"])

    sent = source.mapInArrow(sets_of, "y long, salt int, role int, x long, members binary")
    met = sent.repartition("y", "salt").sortWithinPartitions("y", "salt", "role", "x").mapInArrow(meet, "x long, y long, both long, nx long, ny long")
    union = F.col("nx") + F.col("ny") - F.col("both")
    return store(met.select("x", "y", (100 * F.col("both") >= LINK * union).alias("linked"), (1 - F.col("both") / union).alias("d")), "join-compared")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of ``edges(a, b)``, by star contraction; nodes without an edge are left out."""
    edges = store(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "join-edges")
    while True:
        # Larger neighbours go to the least neighbour or the node itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Then each node and its smaller neighbours to the least of them.
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        new = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(
            least.select("a", F.col("m").alias("b"))).distinct()
        new = store(new, "join-edges")
        changed = new.exceptAll(edges).limit(1).count() + edges.exceptAll(new).limit(1).count()
        edges = new
        if not changed:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _families(sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of a set and the first of its group under each of three minimum hashes."""
    pairs = None
    for k in ("k0", "k1", "k2"):
        heads = sets.groupBy(k).agg(F.min(F.struct("sid", "n")).alias("_y"), F.count("*").alias("_c")).where("_c > 1")
        found = sets.join(heads, k).where("sid != _y.sid").where(
            (100 * F.col("n") >= LINK * F.col("_y.n")) & (100 * F.col("_y.n") >= LINK * F.col("n"))).select(
            F.col("sid").alias("x"), F.col("_y.sid").alias("y"))
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def _counted(codes: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    if c is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, c = codes[order], c[order]
    head = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    if c is None:
        return codes[head], np.diff(np.append(head, len(codes)))
    return codes[head], np.add.reduceat(c, head) if len(head) else c


def list_pairs(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of ``pair_runs`` at once, each pair once."""
    known = np.unique(entries["centre"])
    runs = [(np.searchsorted(known, x) * len(known) + np.searchsorted(known, y), c) for x, y, c in pair_runs(entries)]
    codes, c = _counted(*(np.concatenate(x) for x in zip(*runs))) if runs else (np.empty(0, np.int64),) * 2
    return known[codes // max(len(known), 1)], known[codes % max(len(known), 1)], c


def pair_runs(entries: np.ndarray, offered: int = OFFERED, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Centre pairs of one bucket's lists that no size or position rules out, and in how many lists each.

    Lists give pairs by the square of their length, so pairs come in runs of
    about ``most`` at most, and ``offered`` are gathered before they are counted; a
    pair may be in several runs, its counts add up. Entries of
    centres with followers stand for sizes between 0.8 and 1.25 times their own,
    at any position.
    """
    entries = entries[np.lexsort((entries["at"], entries["centre"], entries["n"], entries["token"]))]
    cut = np.flatnonzero(np.append(True, entries["token"][1:] != entries["token"][:-1]))
    sizes = np.diff(np.append(cut, len(entries)))
    cut, sizes = cut[sizes > 1], sizes[sizes > 1]
    # A pair is one number, made of its centres' places.
    known, place = np.unique(entries["centre"], return_inverse=True)
    n, many = entries["n"].astype(np.int64), entries["many"] > 0
    low, high = np.where(many, need(n), n), np.where(many, -(-100 * n // LINK), n)
    before, rest = np.where(many, high, entries["at"]), np.where(many, high, n - entries["at"])

    def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = (place[i] != place[j]) & (high[i] >= need(low[j])) & (high[j] >= need(low[i]))
        # Sets share at most what lies before the nearer position and behind the farther one.
        ok &= np.minimum(before[i], before[j]) + np.minimum(rest[i], rest[j]) >= overlap(low[i], low[j])
        x, y = place[i[ok]], place[j[ok]]
        return np.minimum(x, y) * len(known) + np.maximum(x, y)

    parts, kept, size = [], [], 0
    for i, j in _neighbours(cut, sizes, n, low, high, before, rest):
        parts.append(allowed(i, j))
        size += len(parts[-1])
        if size > offered:
            kept.append(_counted(np.concatenate(parts)))
            parts, size = [], 0
            if sum(len(x) for x, _ in kept) > most:
                kept = [_counted(*map(np.concatenate, zip(*kept)))]
                if len(kept[0][0]) > most // 2:
                    codes, c = kept.pop()
                    yield known[codes // len(known)], known[codes % len(known)], c
    kept += [_counted(np.concatenate(parts))] if parts else []
    if kept:
        codes, c = _counted(*map(np.concatenate, zip(*kept)))
        yield known[codes // len(known)], known[codes % len(known)], c


def _neighbours(cut: np.ndarray, sizes: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray,
                rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two entries of one list, without blocks that sizes or positions rule out; lists begin at ``cut``."""
    short = sizes <= BLOCK
    for s in np.unique(sizes[short]):
        a, b = np.triu_indices(s, 1)
        heads = cut[short & (sizes == s)]
        for lo in range(0, len(heads), max(1, 150_000 // len(a))):
            own = heads[lo:lo + max(1, 150_000 // len(a)), None]
            yield (own + a).ravel(), (own + b).ravel()
    for head, size in zip(cut[~short], sizes[~short]):
        blocks = [(k, min(k + BLOCK, head + size)) for k in range(head, head + size, BLOCK)]
        most = [(rest[a:b].max(), high[a:b].max(), low[a:b].min(), before[a:b].max()) for a, b in blocks]
        for p, (a, b) in enumerate(blocks):
            for q in range(p, len(blocks)):
                c, d = blocks[q]
                # Sizes ascend: once even the smallest is too large, all further blocks are, followers' margin aside.
                if most[p][1] < need(most[q][2]):
                    if n[c] * LINK * LINK > 10_000 * most[p][1]:
                        break
                    continue
                if min(most[p][3], most[q][3]) + min(most[p][0], most[q][0]) < overlap(most[p][2], most[q][2]):
                    continue
                i, j = (x.ravel() for x in np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij"))
                yield i[i < j], j[i < j]


def _entries(parts: list[np.ndarray]) -> np.ndarray:
    """One entry per (token, centre): the earliest position, followers included."""
    found = np.concatenate(parts)
    order = np.lexsort((found["at"], found["centre"], found["token"]))
    found = found[order]
    head = np.append(True, (found["token"][1:] != found["token"][:-1]) | (found["centre"][1:] != found["centre"][:-1]))
    return found[head]


def _candidates(prefixes: DataFrame, centres: DataFrame, total: int) -> DataFrame:
    """``x, y, c``: pairs of centres that share c prefix shingles and that no filter rules out."""
    buckets = int(total // BUCKET_ENTRIES) + 1
    placed = prefixes.where("n > 0").select("sid", "n", "prefix").join(small(centres, BROADCAST_ROWS), "sid", "left").select(
        F.coalesce("centre", "sid").alias("centre"), F.coalesce("centre_n", "n").alias("n"), F.col("centre").isNotNull().alias("many"), "prefix")

    @tidy
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, homes, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, home = np.concatenate(parts), np.concatenate(homes)
            order = np.argsort(home, kind="stable")
            found, cuts = found[order], np.searchsorted(home[order], np.arange(buckets + 1))
            for k in range(buckets):
                if cuts[k] < cuts[k + 1]:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_entries([found[cuts[k]:cuts[k + 1]]]).tobytes()], pa.binary())],
                                                     names=["bucket", "entries"])

        for batch in batches:
            centre, n, many = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            blobs = batch.column(3)
            counts = np.diff(np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset:blobs.offset + len(blobs) + 1]) // 8
            rank = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in blobs]) if len(blobs) else np.empty(0, np.uint64)
            own = np.empty(len(rank), dtype=ENTRY)
            own["token"] = rank & np.uint64(0xFFFFFFFF)
            own["centre"], own["n"], own["many"] = np.repeat(centre, counts), np.repeat(n, counts), np.repeat(many, counts)
            own["at"] = np.arange(len(rank)) - np.repeat(np.cumsum(counts) - counts, counts)
            parts.append(own)
            homes.append(((rank >> np.uint64(32)) * np.uint64(0x9E3779B1) >> np.uint64(8)) % np.uint64(buckets))
            size += len(own)
            if size >= COMBINED:
                yield from flush()
                parts, homes, size = [], [], 0
        if size:
            yield from flush()

    @tidy
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _grouped(batches, ENTRY):
            found = _entries(parts)
            known, first = np.unique(found["centre"], return_index=True)
            for x, y, c in pair_runs(found, OFFERED, PAIRS):
                out = np.empty(len(x), dtype=PAIR)
                at, to = first[np.searchsorted(known, x)], first[np.searchsorted(known, y)]
                out["x"], out["y"], out["c"], out["nx"], out["ny"] = x, y, c, found["n"][at], found["n"][to]
                out["many"] = found["many"][at] | found["many"][to]
                yield from _homed(out, out["y"], buckets * PAIR_HOMES)

    @tidy
    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _grouped(batches, PAIR):
            found = np.concatenate(parts)
            found = found[np.lexsort((found["x"], found["y"]))]
            head = np.flatnonzero(np.append(True, (found["y"][1:] != found["y"][:-1]) | (found["x"][1:] != found["x"][:-1])))
            c, found = np.add.reduceat(found["c"].astype(np.int64), head), found[head]
            nx, ny = found["nx"].astype(np.int64), found["ny"].astype(np.int64)
            # What neither prefix holds can be shared at most behind the longer remainder.
            most = c + np.maximum(need(nx), need(ny)) - 1
            found = found[(found["many"] > 0) | (most >= overlap(nx, ny))]
            yield from _listed(found["y"], found["x"], ["y", "xs"])

    blobs = placed.mapInArrow(spread, "bucket int, entries binary").repartition("bucket").sortWithinPartitions("bucket")
    pairs = blobs.mapInArrow(lists, "bucket int, entries binary").repartition("bucket").sortWithinPartitions("bucket")
    return pairs.mapInArrow(partners, "y long, xs array<long>")


def _grouped(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[list[np.ndarray]]:
    """The records of each bucket of sorted (bucket, blob) rows."""
    now, parts = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != now and parts:
                yield parts
                parts = []
            now = k
            parts.append(np.frombuffer(blob.as_buffer(), kind))
    if parts:
        yield parts


def _homed(records: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, blob) rows of records, by a hash of their keys."""
    home = (mix(keys.view(np.uint64) if keys.flags.c_contiguous else np.ascontiguousarray(keys).view(np.uint64)) >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(home, kind="stable")
    records, cut = records[order], np.searchsorted(home[order], np.arange(buckets + 1))
    homes, blobs, size = [], [], 0
    for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        homes.append(k)
        blobs.append(records[cut[k]:cut[k + 1]].tobytes())
        size += len(blobs[-1])
        if size >= BLOB_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])
            homes, blobs, size = [], [], 0
    if homes:
        yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])


def _listed(keys: np.ndarray, values: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row per run of equal keys with the array of its values."""
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    ends = np.append(head, len(keys))
    for lo in range(0, len(head), 1000):
        cut = ends[lo:min(lo + 1000, len(head)) + 1]
        lists = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(np.ascontiguousarray(values[cut[0]:cut[-1]])))
        yield pa.RecordBatch.from_arrays([pa.array(keys[cut[:-1]]), lists], names=names)


def _destinations(blocks: DataFrame, homes: int) -> DataFrame:
    """``sid, to``: the blocks that need a set, from ``blocks(xs, label, sub)``."""
    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(batch.column(0).offsets.to_numpy())
            out = np.empty(int(counts.sum()), dtype=SENT)
            out["x"] = batch.column(0).flatten().to_numpy()
            out["label"], out["sub"] = (np.repeat(batch.column(i).to_numpy(), counts) for i in (1, 2))
            out = np.unique(out)
            yield from _homed(out, out["x"], homes)

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _grouped(batches, SENT):
            found = np.unique(np.concatenate(parts))
            # A block's two numbers go as one record of three halves.
            packed = np.array([f"{a}/{b}" for a, b in zip(found["label"].tolist(), found["sub"].tolist())], dtype=object)
            head = np.flatnonzero(np.append(True, found["x"][1:] != found["x"][:-1]))
            ends = np.append(head, len(found))
            for lo in range(0, len(head), 1000):
                cut = ends[lo:min(lo + 1000, len(head)) + 1]
                lists = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(packed[cut[0]:cut[-1]].tolist(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(found["x"][cut[:-1]]), lists], names=["sid", "to"])

    blobs = blocks.select("xs", "label", "sub").mapInArrow(send, "bucket int, entries binary")
    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "sid long, to array<string>")


def compare_blocks(partners: DataFrame, docs: DataFrame, sets: DataFrame, state: DataFrame, text: str, homes: int) -> DataFrame:
    """Compares every y with its xs where that can still matter: ``x, y, d, linked``.

    ``state(sid, comp, r)`` tells what is known to be connected and how far
    followers are. Sets that share partners meet in blocks; pairs connected
    by then need no comparison. Rows come back for links that connected two
    parts, and for unlinked pairs whose followers may still link.
    """
    partners = store(partners.withColumn("label", F.array_min("xs")), "join-partners")
    subs = partners.groupBy("label").agg((F.floor(F.count("*") / BLOCK_SETS) + 1).cast("int").alias("subs"))
    blocks = store(partners.join(small(subs, BROADCAST_ROWS), "label").withColumn(
        "sub", F.pmod(F.xxhash64("y"), F.col("subs")).cast("int")).drop("subs"), "join-blocks")
    own = blocks.select(F.col("y").alias("sid"), F.concat_ws("/", "label", "sub").alias("own"), "xs")
    wanted = own.join(_destinations(blocks, homes), "sid", "full_outer").join(sets, "sid").join(state, "sid", "left").withColumn(
        "comp", F.coalesce("comp", "sid"))
    wanted = store(wanted, "join-wanted")
    source = docs.select("_key", "_h", text).join(small(wanted, BROADCAST_ROWS), ["_key", "_h"]).select("sid", "own", "xs", "to", "comp", "r", text)
    schema = "block string, role int, sid long, comp long, r double, xs array<long>, members binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.binary())
    slack = 1 - LINK / 100 + 1e-9

    @tidy
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slabs(batch.column(6)):
                rows, hashes = shingle_sets(data, offsets)
                rows, bare = _distinct(rows, hashes >> np.uint64(6))
                cut = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(offsets) - 1))])
                part, out = batch.slice(at, len(offsets) - 1), []
                for i, (sid, home, xs, to, comp, r) in enumerate(zip(*(part.column(c).to_pylist() for c in range(6)))):
                    members = bare[cut[i]:cut[i + 1]]
                    if len(members) and int(np.add.reduce(mix(members * _SIGN)).view(np.int64)) == sid:
                        blob = members.tobytes()
                        out += [(home, 0, sid, comp, r, xs, blob)] * (home is not None)
                        out += [(block, 1, sid, comp, r, None, blob) for block in to or []]
                for lo in range(0, len(out), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo:lo + 500]), kinds)], names=names)

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ys, wants, parent, out, last = None, {}, {}, {}, [], None

        def find(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def rows() -> Iterator[pa.RecordBatch]:
            left = [o[:4] for o in out if o[3] or find(o[4]) != find(o[5])]
            for lo in range(0, len(left), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*left[lo:lo + 5000]), (
                    pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["x", "y", "d", "linked"])

        for batch in batches:
            for block, role, sid, comp, r, xs, blob in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if block != now:
                    yield from rows()
                    now, ys, wants, parent, out, last = block, {}, {}, {}, [], None
                members = np.frombuffer(blob, np.uint64)
                if role == 0:
                    if sid not in ys:
                        ys[sid] = (members, comp, r)
                        for x in xs:
                            wants.setdefault(x, []).append(sid)
                elif sid != last:
                    last = sid
                    for y in wants.get(sid, []):
                        other, comp_y, r_y = ys[y]
                        a, b = find(comp), find(comp_y)
                        if a == b:
                            continue
                        at = np.searchsorted(other, members)
                        hit = int((other[np.minimum(at, len(other) - 1)] == members).sum())
                        union = len(members) + len(other) - hit
                        d = 1 - hit / union
                        if 100 * hit >= LINK * union:
                            parent[max(a, b)] = min(a, b)
                            out.append((sid, y, d, True, comp, comp_y))
                        elif (r is not None or r_y is not None) and d <= slack + (r or 0.0) + (r_y or 0.0):
                            out.append((sid, y, d, False, comp, comp_y))
        yield from rows()

    met = source.mapInArrow(sets_of, schema).repartition("block").sortWithinPartitions("block", "role", "sid")
    return store(met.mapInArrow(meet, "x long, y long, d double, linked boolean"), "join-judged")


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``_key, _h, n, _group`` of every row; the group, a set of those linked, is null for rows without a shingle."""
    docs = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("_key"), F.col(text).alias("_text")).withColumn(
        "_h", F.xxhash64("_text"))
    prefixes = _prefixes(docs, "_text", cell_levels(docs, "_text"))
    sets = prefixes.where("n > 0").groupBy("sid").agg(
        *[F.min(c).alias(c) for c in ("n", "k0", "k1", "k2")], F.min(F.struct("_key", "_h")).alias("_holder"))
    sets = store(sets.select("sid", "n", "k0", "k1", "k2", "_holder.*"), "join-sets")
    holders = sets.select("sid", "_key", "_h")

    close = compare(_families(sets), docs, holders, "_text").where("linked")
    # Nobody follows a follower. Whoever linked to one is compared with whom that one follows.
    heads = close.select("x").distinct()
    first = store(close.join(heads.select(F.col("x").alias("y")), "y", "left_anti"), "join-first")
    led = first.groupBy("x").agg(F.min(F.struct("d", "y")).alias("_b")).select("x", F.col("_b.y").alias("root"))
    more = close.join(led.withColumnRenamed("x", "y"), "y").join(led, "x", "left_anti").select("x", F.col("root").alias("y")).where("x != y")
    second = compare(more, docs, holders, "_text").where("linked")
    close = close.unionByName(second)
    follows = first.unionByName(second).where(F.col("d") <= FOLLOW_WITHIN).groupBy("x").agg(F.min(F.struct("d", "y")).alias("_b")).select("x", "_b.y", "_b.d")
    centres = store(follows.unionByName(follows.select(F.col("y").alias("x"), "y", F.lit(0.0).alias("d")).distinct()).join(
        sets.select(F.col("sid").alias("y"), F.col("n").alias("centre_n")), "y").select(
        F.col("x").alias("sid"), F.col("y").alias("centre"), "centre_n", "d"), "join-centres")
    known = components(close.select(F.col("x").alias("a"), F.col("y").alias("b")))

    total = prefixes.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    radius = centres.groupBy("centre").agg(F.max("d").alias("r")).withColumnRenamed("centre", "sid")
    state = store(radius.join(known.select(F.col("node").alias("sid"), F.col("component").alias("comp")), "sid", "full_outer"), "join-state")
    judged = compare_blocks(_candidates(prefixes, centres, total // 8), docs, holders, state, "_text", (int(total // 8 // BUCKET_ENTRIES) + 1) * PAIR_HOMES)
    linked = judged.where("linked").select("x", "y")

    # Members whose centres are neither linked nor too far apart.
    slack = 1 - LINK / 100 + 1e-9
    sofar = components(close.select("x", "y").unionByName(linked).select(F.col("x").alias("a"), F.col("y").alias("b")))
    comp = lambda s: small(sofar.select(F.col("node").alias(s), F.col("component").alias("c" + s)), BROADCAST_ROWS)
    near = judged.where("not linked").select("x", "y", "d").join(comp("x"), "x", "left").join(comp("y"), "y", "left").where(
        F.coalesce("cx", "x") != F.coalesce("cy", "y")).drop("cx", "cy")
    members = lambda s: centres.select(F.col("centre").alias(s), F.col("sid").alias("m" + s), F.col("d").alias("d" + s))
    inner = near.join(members("x"), "x", "left").join(members("y"), "y", "left").select(
        F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y"), "d",
        F.coalesce("dx", F.lit(0.0)).alias("dx"), F.coalesce("dy", F.lit(0.0)).alias("dy")).where(
        (F.col("d") <= slack + F.col("dx") + F.col("dy")) & (F.col("x") != F.col("y")))
    linked = linked.unionByName(compare(inner, docs, holders, "_text").where("linked").select("x", "y"))

    edges = close.select("x", "y").unionByName(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    whole = components(edges)
    labelled = prefixes.select("_key", "_h", "n", "sid").join(small(whole.withColumnRenamed("node", "sid"), BROADCAST_ROWS), "sid", "left").withColumn(
        "_group", F.when(F.col("n") > 0, F.coalesce("component", "sid")))
    return labelled.select("_key", "_h", "n", "_group")


def link_sets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links (null only without an id)."""
    labelled = _rows(docs, id_col, text)
    ids = labelled.where(F.col("_group").isNotNull() & (F.col("_key") != NONE)).groupBy("_group").agg(F.min("_key").alias("_least"))
    return labelled.join(ids, "_group", "left").select(
        F.when(F.col("_key") != NONE, F.col("_key")).alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("_least", F.when(F.col("_key") != NONE, F.col("_key"))).alias("component_id"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of each group of linked rows, and all rows that link with none; nulls count as the largest id.

    Rows go by id and text, so another text under the id of a duplicate stays.
    Of rows equal in both, one stays, also where they hold no shingle.
    """
    labelled = store(_rows(docs, id_col, text), "join-rows")
    order = F.struct((F.col("_key") == NONE).alias("none"), "_key", "_h")
    first = labelled.where("_group is not null").groupBy("_group").agg(F.min(order).alias("_first"))
    row = F.struct("_key", "_h")
    gone = labelled.select("_group", row.alias("_row")).join(small(first, BROADCAST_ROWS), "_group").where(
        F.col("_row") != F.struct("_first._key", "_first._h")).select("_row.*").distinct()
    again = store(labelled.groupBy("_key", "_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_key", "_h"), "join-repeated")
    keyed = docs.withColumns({"_key": F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)), "_h": F.xxhash64(text)})
    kept = keyed.join(small(gone, BROADCAST_ROWS), ["_key", "_h"], "left_anti")
    if again.limit(1).count():
        # Only rows that share id and text can be repeats of one another.
        again = small(again, BROADCAST_ROWS)
        kept = kept.join(again, ["_key", "_h"], "left_anti").unionByName(kept.join(again, ["_key", "_h"], "left_semi").dropDuplicates(["_key", "_h"]))
    return kept.drop("_key", "_h")
