"""Words, lines and hashes of whole text columns, straight on their UTF-8 buffers.

A word is a run of bytes other than space and 0x09 to 0x0D, so it never splits
a multi-byte character. No Python string is made: everything is numpy over the
bytes that Arrow hands to the task, in slabs of bounded size.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32
_SAME = np.arange(256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task's function that gives its memory back when it ends: workers are used again and would keep it."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _ODD, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return (data[offsets[0]:offsets[-1]], offsets - offsets[0]) if len(offsets) else (data[:0], np.zeros(1, np.int64))


def slabs(column: pa.Array, size: int = SLAB_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows, each about ``size`` bytes or a single longer text."""
    data, offsets = raw(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each non-empty byte span; ``fold`` lower-cases A-Z first. Spans don't overlap and ascend."""
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    length = end - start
    ends = np.cumsum(length)
    at = np.arange(ends[-1], dtype=np.int64) - np.repeat(ends - length, length)
    where = at + np.repeat(start, length)
    values = (_LOWER if fold else _SAME)[data[where]] + np.uint64(1)
    sums = np.add.reduceat(values * _powers(int(length.max()))[at], ends - length)
    return mix(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first-word index of every run of ``n`` words of one row."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k, p in enumerate(_powers(n + 1)[1:]):
        total += hashes[k:len(hashes) - n + 1 + k] * p
    first = np.flatnonzero(rows[:len(total)] == rows[n - 1:])
    return mix(total[first]), first


def count_by(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n).astype(np.int64)


def repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per element: does its key occur in its row again, and did it occur before (input order)."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    same = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    again, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    earlier[order[1:]] = same
    return again, earlier
