"""Postings in parts: all postings of some thousand chunks, term by term, best first, in blocks with bounds.

A task that counts the terms of its chunks writes their part, and a task that
searches a part has all the postings of its chunks, so postings are never
shuffled. A part is one row: its chunks, its terms, their postings and the bounds
of their blocks are compressed Arrow batches in binary columns, of which a task reads those it needs.
Terms are stored by their lengths, and the chunks of a block in order, by the steps from one to the next.

A search leaves out blocks whose bound and the best of the question's other terms in
the part stay below the question's floor. The terms that together can't reach the
floor open no chunk; they are looked up for the chunks that the others bring near it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.text import tokens

#: Chunks of a part at most (the bits of one of Spark's bitmaps), and chunks counted at once.
MAX_ROWS, ROWS = 1 << 15, 1024
#: Distinct terms, and found chunks, that a task holds before it passes them on.
_HELD_TERMS, _HELD_ROWS = 1_000_000, 100_000
PARTS = "part bigint, n int, tokens bigint, block int, chunks binary, words binary, terms binary, postings binary, blocks binary"
PLACES = "chunk_id string, of bigint, part bigint, row int, dl int"
#: Texts whose characters' class and lower case are looked up here: up to U+02BF but for three that get longer, and general punctuation.
_PLAIN = r"\A[\x00-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u02bf\u2000-\u206f]*\z"
#: Bytes of words in UTF-8 up to U+02BF; after 0xC2 and 0xC3 some are of other signs.
_WORD = np.array([chr(b) == "_" or chr(b).isalnum() if b < 0x80 else b < 0xCB for b in range(256)])
_AFTER = {0xC2: np.isin(np.arange(256), [0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]), 0xC3: ~np.isin(np.arange(256), [0x97, 0xB7])}


def counted_input(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, text, tokens)``: the texts whose words are found in Arrow, the tokens of the others."""
    text = F.coalesce("text", F.lit(""))
    plain = text.rlike(_PLAIN)
    return chunks.select("chunk_id", F.when(plain, text).alias("text"), F.when(~plain, tokens(text)).alias("tokens"))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts that are ``_PLAIN``, as :func:`tokens` has them, and how many each text has."""
    texts = pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _WORD[data]
    for lead, letters in _AFTER.items():
        at = np.flatnonzero(data == lead)
        at = at[~letters[data[at + 1]]]
        inside[at] = inside[at + 1] = False
    at = np.flatnonzero(data == 0xE2)
    inside[at] = inside[at + 1] = inside[at + 2] = False
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    begin = np.flatnonzero(begins)
    places = (np.cumsum(inside, dtype=np.int32)[begin] - 1).astype(np.int32)
    kept = data[inside]
    found = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.r_[places, np.int32(len(kept))].astype(np.int32)), pa.py_buffer(kept))
    return found, np.diff(np.searchsorted(begin, offsets))


@dataclass(frozen=True)
class Piece:
    """Chunks with their lengths, and their terms' frequencies as rows of chunks and places of ``names``."""

    ids: pa.Array
    dl: np.ndarray
    names: pa.Array
    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """Pieces of :func:`counted_input`."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            ids, texts, listed = batch.slice(at, ROWS).columns
            found, n = words(pc.fill_null(texts, "").cast(pa.string()))
            other = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
            coded = pa.concat_arrays([found, listed.flatten().cast(pa.string())]).dictionary_encode()
            row = np.concatenate([np.repeat(np.arange(len(ids)), n), np.repeat(np.arange(len(ids)), other)])
            width = max(len(coded.dictionary), 1)
            pair, tf = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
            yield Piece(ids, n + other, coded.dictionary, pair // width, pair % width, tf)


def _bytes(**columns) -> bytes:
    batch, sink = pa.record_batch(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _batch(column: pa.Array, i: int) -> pa.RecordBatch:
    return pa.ipc.open_stream(column[i].as_buffer()).read_next_batch()


def _text(values: pa.Array) -> bytes:
    """All values, one after the other."""
    ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[[values.offset, values.offset + len(values)]] if len(values) else (0, 0)
    return values.buffers()[2].to_pybytes()[ends[0]:ends[1]] if ends[1] else b""


def _terms(batch: pa.RecordBatch, i: int) -> tuple[pa.Array, np.ndarray]:
    """The terms of a part and in how many of its chunks each is."""
    terms, text = _batch(batch.column("terms"), i), _batch(batch.column("words"), i).column("text")[0].as_buffer()
    ends = np.r_[0, np.cumsum(_ints(terms, "length"))].astype(np.int32)
    return pa.StringArray.from_buffers(terms.num_rows, pa.py_buffer(ends), text), _ints(terms, "df")


def _rows(postings: pa.RecordBatch) -> np.ndarray:
    """The chunks of all postings."""
    steps = postings.column("low").to_numpy().astype(np.uint16) | postings.column("high").to_numpy().astype(np.uint16) << 8
    return np.cumsum(steps, dtype=np.uint16).astype(np.int64)


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy().astype(np.int64)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _row(held: list[Piece], number: int, block: int) -> pa.RecordBatch:
    rows, names = (np.cumsum([0, *(len(x) for x in some)]) for some in ([p.dl for p in held], [p.names for p in held]))
    coded = pa.concat_arrays([p.names for p in held]).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    term = np.concatenate([code[p.term + at] for p, at in zip(held, names)])
    row, tf, dl = (np.concatenate(x) for x in ([p.row + at for p, at in zip(held, rows)], [p.tf for p in held], [p.dl for p in held]))
    df = np.bincount(term, minlength=len(coded.dictionary))
    # Terms of one block need no order but that of their chunks.
    order = np.argsort(term << 32 | np.where(df[term] > block, (dl[row] / (tf + dl[row]) * (1 << 31)).astype(np.int64), row))
    several = np.flatnonzero(df[term[order]] > block)
    place = (several - (np.cumsum(df) - df)[term[order[several]]]) // block
    order[several] = order[several][np.argsort(term[order[several]] << 32 | place << 16 | row[order[several]])]
    row, tf = row[order], tf[order]
    steps = np.diff(row, prepend=0).astype(np.uint16)
    n_blocks = -(-df // block)
    at = np.repeat(np.cumsum(df) - df, n_blocks) + block * _ranges(np.zeros_like(df), n_blocks)
    bounds = (np.maximum.reduceat(tf, at), np.minimum.reduceat(dl[row], at)) if len(at) else (tf, row)
    values = [number, len(dl), int(dl.sum()), block, _bytes(chunk_id=pa.concat_arrays([p.ids for p in held]), dl=_narrow(dl)), _bytes(text=pa.array([_text(coded.dictionary)], pa.binary())),
              _bytes(length=_narrow(pc.binary_length(coded.dictionary).to_numpy()), df=_narrow(df)),
              _bytes(low=steps.astype(np.uint8), high=(steps >> 8).astype(np.uint8), tf=_narrow(tf)), _bytes(max_tf=_narrow(bounds[0]), min_dl=_narrow(bounds[1]))]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split(" ")[0] for c in PARTS.split(", ")])


def _packed(pieces: Iterator[Piece], most: int, block: int) -> Iterator[pa.RecordBatch]:
    """Parts of about ``most`` postings."""
    held, rows, postings, number = [], 0, 0, TaskContext.get().partitionId() << 32
    for piece in pieces:
        if held and (postings >= most or rows + len(piece.dl) > MAX_ROWS):
            yield _row(held, number, block)
            held, rows, postings, number = [], 0, 0, number + 1
        if len(piece.dl):
            held, rows, postings = [*held, piece], rows + len(piece.dl), postings + len(piece.tf)
    if held:
        yield _row(held, number, block)


def of_chunks(chunks: DataFrame, most: int, block: int) -> DataFrame:
    """Parts of ``chunks(chunk_id, text)``, of about ``most`` postings and in blocks of ``block``."""
    return counted_input(chunks).mapInArrow(lambda batches: _packed(counted(batches), most, block), PARTS)


def _gone(column: pa.Array, i: int, n: int) -> np.ndarray | None:
    """The bits of a bitmap for the rows of a part."""
    value = column[i]
    return np.unpackbits(np.frombuffer(value.as_buffer(), dtype=np.uint8), bitorder="little")[:n].astype(bool) if value.is_valid else None


def repacked(parts: DataFrame, most: int, block: int) -> DataFrame:
    """The chunks of ``parts`` that are not in ``dead`` as new parts; small ones are put together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunks, postings, (names, df) = _batch(batch.column("chunks"), i), _batch(batch.column("postings"), i), _terms(batch, i)
                ids, dl, row, tf, term = chunks.column("chunk_id"), _ints(chunks, "dl"), _rows(postings), _ints(postings, "tf"), np.repeat(np.arange(len(df)), df)
                dead = _gone(batch.column("dead"), i, len(dl))
                if dead is not None:
                    live = np.flatnonzero(~dead)
                    kept = ~dead[row]
                    row, term, tf = np.cumsum(~dead)[row[kept]] - 1, term[kept], tf[kept]
                    used, term = np.unique(term, return_inverse=True)
                    ids, dl, names = ids.take(pa.array(live)), dl[live], names.take(pa.array(used))
                yield Piece(ids, dl, names, row, term, tf)

    return parts.select("chunks", "words", "terms", "postings", "dead").mapInArrow(lambda batches: _packed(run(batches), most, block), PARTS)


def places(parts: DataFrame) -> DataFrame:
    """``(chunk_id, of, part, row, dl)`` of the chunks that are not in ``dead``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunks = _batch(batch.column("chunks"), i)
                dead = _gone(batch.column("dead"), i, chunks.num_rows)
                row = np.arange(chunks.num_rows) if dead is None else np.flatnonzero(~dead)
                some = chunks.take(pa.array(row))
                yield pa.record_batch([
                    some.column("chunk_id"), *(pa.array(np.full(len(row), batch.column(c)[i].as_py()), pa.int64()) for c in ("step", "part")),
                    pa.array(row, pa.int32()), some.column("dl").cast(pa.int32())], names=["chunk_id", "of", "part", "row", "dl"])

    return parts.select("step", "part", "chunks", "dead").mapInArrow(run, PLACES)


def bitmaps(rows: DataFrame, name: str) -> DataFrame:
    """``(step, part, <name>)``: a bitmap of the ``row`` of every part, from places."""
    return rows.groupBy(F.col("of").alias("step"), "part").agg(F.bitmap_construct_agg(F.col("row").cast("bigint")).alias(name))


def frequencies(parts: DataFrame, removed: Column | None = None) -> DataFrame:
    """``(term, df)``, a term for any number of times: in how many chunks of the parts it is, or in how many of the ``removed`` bitmap."""
    def counts(batch: pa.RecordBatch, i: int) -> pa.Table:
        names, df = _terms(batch, i)
        if batch.num_columns > 2:
            row = _rows(_batch(batch.column("postings"), i))
            term = np.repeat(np.arange(len(df)), df)[_gone(batch.column("removed"), i, MAX_ROWS)[row]]
            df = np.bincount(term, minlength=len(df))
        return pa.table({"term": names, "df": df}).filter(pa.array(df > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, most = [], _HELD_TERMS
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(counts(batch, i))
                if sum(t.num_rows for t in held) > most:
                    held = [summed(held)]
                    if held[0].num_rows > _HELD_TERMS // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("term").aggregate([("df", "sum")]).rename_columns(["term", "df"])

    kept = parts.select("words", "terms") if removed is None else parts.select("words", "terms", "postings", removed.alias("removed"))
    return kept.mapInArrow(run, "term string, df bigint")


@dataclass(frozen=True)
class Asked:
    """The terms of some questions; ``start`` has where the uses of each begin in ``query`` and ``weight``."""

    terms: list[str]
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    n_queries: int
    mean: float

    def impact(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / self.mean))


class Bounds:
    """What a part has of the asked terms: their blocks' bounds, and the terms of every question by their places here."""

    def __init__(self, asked: Asked, batch: pa.RecordBatch, i: int) -> None:
        (names, df), blocks, self.block = _terms(batch, i), _batch(batch.column("blocks"), i), batch.column("block")[i].as_py()
        places = pc.fill_null(pc.index_in(names, value_set=pa.array(asked.terms, pa.string())), -1).to_numpy()
        found = np.full(len(asked.terms), -1)
        found[places[places >= 0]] = np.flatnonzero(places >= 0)
        of = np.flatnonzero(found >= 0)
        n_blocks = -(-df // self.block)
        self.df, self.start, here = df[found[of]], (np.cumsum(df) - df)[found[of]], n_blocks[found[of]]
        at = _ranges((np.cumsum(n_blocks) - n_blocks)[found[of]], here)
        self.block_at = np.r_[0, np.cumsum(here)]
        self.bound = asked.impact(_ints(blocks, "max_tf")[at], _ints(blocks, "min_dl")[at])
        self.best = np.maximum.reduceat(self.bound, self.block_at[:-1]) if len(of) else np.empty(0)
        uses = asked.start[of + 1] - asked.start[of]
        use, term = _ranges(asked.start[of], uses), np.repeat(np.arange(len(of)), uses)
        order = np.argsort(asked.query[use], kind="stable")
        self.query, self.term, self.weight = asked.query[use][order], term[order], asked.weight[use][order]

    def questions(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Every question with its terms, their weights and the most that each can add."""
        first = np.flatnonzero(np.r_[True, self.query[1:] != self.query[:-1]]) if len(self.query) else np.empty(0, dtype=np.int64)
        most = self.weight * self.best[self.term]
        for lo, hi in zip(first, np.r_[first[1:], len(self.query)]):
            yield int(self.query[lo]), self.term[lo:hi], self.weight[lo:hi], most[lo:hi]

    def reaches(self, term: int, weight: float, others: float, floor: float) -> np.ndarray:
        """Which of the term's blocks reach the floor with the best of the question's other terms."""
        return weight * self.bound[self.block_at[term]:self.block_at[term + 1]] + others >= floor


class Postings(Bounds):
    """The postings of the asked terms beside their bounds, by term and by chunk. Deleted chunks weigh nothing."""

    def __init__(self, asked: Asked, batch: pa.RecordBatch, i: int) -> None:
        super().__init__(asked, batch, i)
        chunks, postings, at = _batch(batch.column("chunks"), i), _batch(batch.column("postings"), i), _ranges(self.start, self.df)
        self.ids, dl = chunks.column("chunk_id"), _ints(chunks, "dl")
        self.row, self.end = _rows(postings)[at], np.r_[0, np.cumsum(self.df)]
        self.impact = asked.impact(_ints(postings, "tf")[at], dl[self.row])
        dead = _gone(batch.column("dead"), i, len(dl))
        if dead is not None:
            self.impact[dead[self.row]] = 0.0
        order = np.argsort(self.row.astype(np.uint16), kind="stable")
        self.row_at = np.r_[0, np.cumsum(np.bincount(self.row, minlength=len(dl)))]
        self.row_term, self.row_impact = np.repeat(np.arange(len(self.df)), self.df)[order], self.impact[order]
        self._sums, self._weights = np.zeros(len(dl)), np.zeros(len(self.df))

    def sums(self, terms: np.ndarray, weights: np.ndarray, chosen) -> np.ndarray:
        """Sums by chunk over the postings that ``chosen(place of a term)`` names; valid until the next call."""
        self._sums.fill(0.0)
        for x, (j, w) in enumerate(zip(terms, weights)):
            some = chosen(x)
            rows, impact = self.row[self.end[j]:self.end[j + 1]], self.impact[self.end[j]:self.end[j + 1]]
            if some is not None:
                rows, impact = rows[some], impact[some]
            self._sums[rows] += w * impact   # a term has a chunk once
        return self._sums

    def scores(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of some chunks by all terms of a question."""
        self._weights[terms] = weights
        lengths = self.row_at[rows + 1] - self.row_at[rows]
        at = _ranges(self.row_at[rows], lengths)
        found = np.bincount(np.repeat(np.arange(len(rows)), lengths), weights=self.row_impact[at] * self._weights[self.row_term[at]], minlength=len(rows))
        self._weights[terms] = 0.0
        return found

    def found(self, some: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        q, rows, scores = (np.concatenate(x) for x in zip(*some))
        return pa.record_batch([pa.array(q, pa.int32()), self.ids.take(pa.array(rows)), pa.array(scores, pa.float64())], names=["_q", "chunk_id", "score"])


def best_scores(batches: Iterator[pa.RecordBatch], asked: Asked, k: int, first: int) -> Iterator[pa.RecordBatch]:
    """``(_q, score)``: each question's ``k`` best scores of a task among the ``first`` best chunks of its terms' first blocks in each part."""
    best = {}
    for batch in batches:
        for i in range(batch.num_rows):
            part = Postings(asked, batch, i)
            for q, terms, weights, most in part.questions():
                held = best.get(q)
                if held is not None and len(held) == k and most.sum() < held[-1]:
                    continue
                sums = part.sums(terms, weights, lambda _: slice(0, part.block))
                rows = np.flatnonzero(sums > 0)
                if len(rows) > first:
                    rows = rows[np.argpartition(sums[rows], len(rows) - first)[-first:]]
                found = part.scores(rows, terms, weights)
                best[q] = np.sort(found if held is None else np.concatenate([held, found]))[::-1][:k]
    for q, held in best.items():
        yield pa.record_batch([pa.array(np.full(len(held), q), pa.int32()), pa.array(held, pa.float64())], names=["_q", "score"])


def top_scores(batches: Iterator[pa.RecordBatch], asked: Asked, floors: np.ndarray, k: int, step: float) -> Iterator[pa.RecordBatch]:
    """``(_q, chunk_id, score)``: all chunks that may be among a question's ``k`` best. ``step`` is more than rounding changes a score."""
    floors = floors.copy()
    for batch in batches:
        for i in range(batch.num_rows):
            part, out, waiting = Postings(asked, batch, i), [], 0
            for q, terms, weights, most in part.questions():
                floor, order = floors[q], np.argsort(most)
                reach = np.cumsum(most[order])
                if reach[-1] < floor - step:
                    continue
                # Terms that can't reach the floor together open no chunk.
                closed = int(np.searchsorted(reach, floor - step))
                rest, opening = reach[closed - 1] if closed else 0.0, order[closed:]
                left = [part.reaches(terms[x], weights[x], reach[-1] - most[x], floor - step) for x in opening]
                sums = part.sums(terms[opening], weights[opening], lambda x: None if left[x].all() else np.repeat(left[x], part.block)[:part.df[terms[opening[x]]]])
                rows = np.flatnonzero((sums > 0) & (sums + rest >= floor - step))
                found = part.scores(rows, terms, weights)
                if len(found) >= k:
                    floors[q] = max(floor, np.partition(found, len(found) - k)[len(found) - k] - step)
                kept = np.flatnonzero(found >= floors[q] - step)
                if len(kept):
                    out.append((np.full(len(kept), q), rows[kept], found[kept]))
                waiting += len(kept)
                if waiting > _HELD_ROWS:
                    yield part.found(out)
                    out, waiting = [], 0
            if out:
                yield part.found(out)


def skipped_blocks(batches: Iterator[pa.RecordBatch], asked: Asked, floors: np.ndarray, step: float) -> Iterator[pa.RecordBatch]:
    """``(_q, blocks, skipped)`` of a task: blocks of the question's terms, and those whose bounds stay below its floor."""
    found = np.zeros((2, asked.n_queries), dtype=np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            part = Bounds(asked, batch, i)
            for q, terms, weights, most in part.questions():
                total = most.sum()
                for j, w, own in zip(terms, weights, most):
                    reached = part.reaches(j, w, total - own, floors[q] - step)
                    found[:, q] += len(reached), len(reached) - reached.sum()
    q = np.flatnonzero(found[0])
    yield pa.record_batch([pa.array(q, pa.int32()), pa.array(found[0][q]), pa.array(found[1][q])], names=["_q", "blocks", "skipped"])
