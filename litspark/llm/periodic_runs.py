"""Periodic runs of words, found by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical), at least two periods and ``MIN_LENGTH`` words long, that no
neighbouring word extends. Every state of the automaton knows where its words
ended last; states with the same last end form paths of the suffix-link tree,
kept in splay trees. Appending word ``i`` accesses the state of the prefix: the
path segments up to the root are recoloured from their last end ``j`` to ``i``. Where
the distance ``i - j`` lies within the lengths of a segment, the words before ``i``
are a square of that period, whose root is no power; it is extended to its run.
All segments together are O(n log n).

Of a run's words, each lies in a string of six words that occurs again in the
same text. So only the stretches covered by such strings go through an
automaton; a stretch holds its runs whole. That test is of hashes and may let
through too much; the automaton compares the words themselves. Row-local: one
Arrow pass, no shuffle. Memory follows the longest repeating stretch of one
text, not the table.

Null and empty texts have no words, no runs and an empty collapsed text.
Repeated rows are judged alike. Ties between runs don't matter, all are returned,
by start and then period. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from litspark.llm import words as W

MIN_LENGTH = 12
#: A run of MIN_LENGTH words or more agrees with itself, one period on, in at least half as many.
_AGREE = MIN_LENGTH // 2


def automaton(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and length of every state (0 is the root), and the state of every prefix."""
    steps: list[dict[int, int]] = [{}]
    link, length, prefixes, last = [-1], [0], [], 0
    for word in text:
        state, p = len(length), last
        length.append(length[last] + 1)
        steps.append({})
        link.append(0)
        while p >= 0 and word not in steps[p]:
            steps[p][word] = state
            p = link[p]
        if p >= 0:
            q = steps[p][word]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                steps.append(steps[q].copy())
                link.append(link[q])
                while p >= 0 and steps[p].get(word) == q:
                    steps[p][word] = copy
                    p = link[p]
                link[q] = link[state] = copy
        prefixes.append(state)
        last = state
    return link, length, prefixes


class LastEnds:
    """Paths of states with one last end, as splay trees ordered by depth; the root of a tree holds the end."""

    def __init__(self, link: list[int], length: list[int]) -> None:
        n = len(link)
        self.up, self.length = [max(x, 0) for x in link], length
        self.above, self.below, self.end = [0] * n, [0] * n, [-1] * n

    def _splay(self, x: int) -> None:
        up, above, below = self.up, self.above, self.below
        while True:
            p = up[x]
            if not p or (above[p] != x and below[p] != x):
                return
            g = up[p]
            inner = g and (above[g] == p or below[g] == p)
            if inner and (above[g] == p) == (above[p] == x):
                self._rotate(p)
                self._rotate(x)
            elif inner:
                self._rotate(x)
                self._rotate(x)
            else:
                self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, above, below = self.up, self.above, self.below
        p = up[x]
        g = up[p]
        if above[p] == x:
            moved = above[p] = below[x]
            below[x] = p
        else:
            moved = below[p] = above[x]
            above[x] = p
        if moved:
            up[moved] = p
        up[p], up[x] = x, g
        if g and above[g] == p:
            above[g] = x
        elif g and below[g] == p:
            below[g] = x
        else:
            # ``p`` was the root of its tree.
            self.end[x] = self.end[p]

    def access(self, state: int, at: int) -> list[tuple[int, int, int]]:
        """Recolour the path from ``state`` to the root; its segments as (last end, least length less one, largest length)."""
        up, below, end, length = self.up, self.below, self.end, self.length
        found, deeper, x = [], 0, state
        while x:
            self._splay(x)
            if end[x] >= 0:
                found.append((end[x], length[up[x]], length[x]))
            if below[x]:
                # Deeper states of the old path keep its end.
                end[below[x]] = end[x]
            below[x] = deeper
            deeper, x = x, up[x]
        end[deeper] = at
        return found


def find_runs(text: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    link, length, prefixes = automaton(text)
    ends, reached, found, n = LastEnds(link, length), {}, [], len(text)
    for i, state in enumerate(prefixes):
        for j, low, high in ends.access(state, i):
            period = i - j
            if low < period <= high and reached.get(period, -1) < i:
                start, stop = i - 2 * period + 1, i + 1
                while stop < n and text[stop] == text[stop - period]:
                    stop += 1
                while start and text[start - 1] == text[start - 1 + period]:
                    start -= 1
                reached[period] = stop - 1
                if stop - start >= max(min_length, 2 * period):
                    found.append((start, stop - start, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _stretches(hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """First word and end of the stretches whose words lie in strings that occur again in their text."""
    keys, first = W.window_hashes(hashes, rows, _AGREE)
    again, _ = W.repeated(keys, rows[first])
    cover = np.zeros(len(hashes) + 1, dtype=np.int32)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + _AGREE, -1)
    inside = np.cumsum(cover)[:-1] > 0
    joined = inside[1:] & inside[:-1] & (rows[1:] == rows[:-1])
    start = np.flatnonzero(inside & ~np.append(False, joined)[:len(inside)])
    stop = np.flatnonzero(inside & ~np.append(joined, False)[:len(inside)]) + 1
    yield from zip(start.tolist(), stop.tolist())


def _row_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, n: int) -> list[bytes]:
    """The given words of each row, joined by one space."""
    size = end - start + 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) - np.repeat(ends - size - start, size)
    out = np.append(data, np.uint8(0x20))[at]
    out[ends - 1] = 0x20
    whole = out.tobytes()
    cuts = np.append(0, ends)[np.searchsorted(row, np.arange(n + 1))].tolist()
    return [whole[a:max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:])]


def _runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, int]]], list[bytes], np.ndarray]:
    n = len(offsets) - 1
    start, end, row = W.word_spans(data, offsets)
    base = np.searchsorted(row, np.arange(n))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    cover = np.zeros(len(start) + 1, dtype=np.int64)
    for a, b in _stretches(W.span_hashes(data, start, end), row):
        if b - a < MIN_LENGTH:
            continue
        left, numbers = int(start[a]), {}
        body, own = data[left:end[b - 1]].tobytes(), int(row[a])
        text = [numbers.setdefault(body[x - left:y - left], len(numbers)) for x, y in zip(start[a:b].tolist(), end[a:b].tolist())]
        for first, length, period in find_runs(text):
            runs[own].append((a - int(base[own]) + first, length, period))
            cover[a + first + period] += 1
            cover[a + first + length] -= 1
    keep = np.cumsum(cover)[:-1] == 0
    texts = _row_texts(data, start[keep], end[keep], row[keep], n)
    return runs, texts, W.count_by(row, n)


RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str | None = "collapsed") -> DataFrame:
    """``docs`` with ``n_words``, the array of runs by start and period and, unless null, the collapsed text.

    The collapsed text keeps a run's first period and drops its other words;
    where runs overlap, a word goes if any of them drops it. Words are joined by
    one space. Columns of ``docs`` that clash with a result column are replaced;
    without ``collapsed`` texts are not returned.
    """
    added = {"n_words": T.LongType(), runs: T.ArrayType(RUN, False), **({collapsed: T.StringType()} if collapsed else {})}
    carry = [f for f in docs.schema.fields if f.name not in added and (collapsed or f.name != text)]
    names = [f.name for f in carry]
    source = docs.select(docs[text].alias("_searched"), *[f"`{n}`" for n in names])
    schema = T.StructType([*carry, *(T.StructField(n, t) for n, t in added.items())])

    @W.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.slabs(batch.column(0)):
                found, texts, counts = _runs_of(data, offsets)
                flat = [x for own in found for x in own]
                columns = [pa.array([x[i] for x in flat], pa.int64()) for i in range(3)]
                cuts = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_ARROW_RUN)))
                part = batch.slice(at, len(offsets) - 1)
                out = [*part.columns[1:], pa.array(counts), lists]
                if collapsed:
                    out.append(pa.array(texts, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[*names, *added])

    return source.mapInArrow(run, schema)
