"""Quality rules, line first: drop failing lines, then documents that lost too much.

Every line with a word is judged alone: it must end like a sentence, must not
be navigation (separators such as ``|`` or a run of very short items) and must
not be boilerplate. Document rules on words follow (too short, repetitive, shouting or
full of symbols). Row-local: one Arrow pass, no shuffle, memory bounded by a
slab of texts.

Nulls and empty texts have no words: they fail as too short, with an empty
cleaned text. Repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from litspark.llm import words as W

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Share of a document's word characters that may go with its failing lines.
MAX_LOST_PERCENT = 30
#: The same with notices among the lost lines.
MAX_GONE_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_UPPER_PERCENT = 60
#: Phrases of notices; a line of at most MAX_NOTICE_WORDS words that holds one is boilerplate.
NOTICES = ("licensed under", "is licensed under", "released under the", "all rights reserved", "terms of use",
           "privacy policy", "cookie policy", "javascript is disabled", "enable javascript", "lorem ipsum")
MAX_NOTICE_WORDS = 20

_END = np.zeros(256, dtype=bool)
_END[list(b".!?:;\"')]}")] = True
_CLOSE_WIDE = (b"\xe2\x80\x9d", b"\xe2\x80\x99", b"\xc2\xbb", b"\xe2\x80\xa6", b"\xe3\x80\x82", b"\xef\xbc\x81",
               b"\xef\xbc\x9f", b"\xd8\x9f", b"\xe0\xa5\xa4")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without the newline) and row of every line."""
    breaks = np.flatnonzero(data == 0x0A)
    rows = np.arange(len(offsets) - 1)
    start = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    row = np.concatenate([rows, np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    order = np.lexsort((end, np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, rows])))
    return start, end[order], row


def _judge(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], list[bytes]]:
    n = len(offsets) - 1
    start, end, row = W.word_spans(data, offsets)
    out = {"n_words": W.count_by(row, n)}
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out["word_chars"] = W.count_by(row, n, heads[end] - heads[start])
    marks = np.flatnonzero(W.SYMBOL[data])
    symbol_rows = np.searchsorted(offsets, marks, "right") - 1
    out["n_symbols"] = W.count_by(symbol_rows, n)

    windows, first = W.window_hashes(W.span_hashes(data, start, end), row, WINDOW)
    again, _ = W.repeated(windows, row[first])
    cover = np.zeros(len(start) + 1, dtype=np.int64)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + WINDOW, -1)
    out["n_repeat_words"] = W.count_by(row, n, np.cumsum(cover)[:-1] > 0)

    ls, le, lr = _lines(data, offsets)
    w0, w1 = np.searchsorted(start, ls), np.searchsorted(start, le)
    ls, le, lr, w0, w1 = (x[w1 > w0] for x in (ls, le, lr, w0, w1))
    _, earlier = W.repeated(W.span_hashes(data, ls, le), lr)
    out["n_dup_lines"] = W.count_by(lr, n, earlier)

    # Line rules.
    last = data[end[w1 - 1] - 1] if len(ls) else np.empty(0, np.uint8)
    closed = _END[last]
    for i in np.flatnonzero(~closed & (last >= 0x80)):
        closed[i] = data[max(ls[i], end[w1[i] - 1] - 3):end[w1[i] - 1]].tobytes().endswith(_CLOSE_WIDE)
    bars = np.concatenate([[0], np.cumsum(data == 0x7C)])
    signs = np.concatenate([[0], np.cumsum(W.SYMBOL[data])])
    upper = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
    lower = np.concatenate([[0], np.cumsum((data >= 0x61) & (data <= 0x7A))])
    n_line, ups, lows = w1 - w0, upper[le] - upper[ls], lower[le] - lower[ls]
    navigation = (bars[le] - bars[ls]) * 5 >= n_line
    noisy = (signs[le] - signs[ls]) * 2 >= n_line
    shouting = (ups * 100 > MAX_UPPER_PERCENT * (ups + lows)) & (n_line >= 3)
    notice = np.zeros(len(ls), dtype=bool)
    for i in np.flatnonzero(n_line <= MAX_NOTICE_WORDS):
        line = data[ls[i]:le[i]].tobytes().lower()
        notice[i] = any(p in line for p in _NOTICE_BYTES)
    bad = ~closed | navigation | noisy | shouting | notice
    sizes = heads[le] - heads[ls]
    lost, all_chars = W.count_by(lr, n, sizes * bad), W.count_by(lr, n, sizes)
    # A notice is taken out, but counts little against the text around it.
    harm, rest = W.count_by(lr, n, sizes * (bad & ~notice)), W.count_by(lr, n, sizes * ~notice)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (
        100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["lost_chars"] = lost
    out["kept"] = ~out["base_failed"] & (100 * lost <= MAX_GONE_PERCENT * all_chars) & (lost < all_chars) & (100 * harm <= MAX_LOST_PERCENT * rest) & (
        100 * out["n_symbols"] <= MAX_SYMBOL_PERCENT * out["word_chars"])
    # Lines without a word stay where they are; a failing line goes with its newline.
    drop = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(drop, ls[bad], 1)
    np.add.at(drop, np.minimum(le[bad] + 1, offsets[lr[bad] + 1]), -1)
    keep = np.cumsum(drop)[:-1] == 0
    kept_at = np.concatenate([[0], np.cumsum(keep)])
    cleaned, at = data[keep].tobytes(), kept_at[offsets]
    return out, [cleaned[a:b] for a, b in zip(at[:-1], at[1:])]


_NOTICE_BYTES = tuple(x.encode() for x in NOTICES)
_TYPES = {**dict.fromkeys(BASE, "long"), "base_failed": "boolean", "kept": "boolean", "lost_chars": "long"}


def judge_lines(docs: DataFrame, text: str = "text", cleaned: str | None = "cleaned") -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``lost_chars``, ``kept`` and, unless null, the cleaned text.

    ``kept`` is false when a base rule fails, when every line goes, when
    failing lines other than notices hold more than ``MAX_LOST_PERCENT`` of the
    characters of lines other than notices, when all failing lines hold more
    than ``MAX_GONE_PERCENT`` of all characters, or when symbols exceed
    ``MAX_SYMBOL_PERCENT`` of the word characters. Columns of ``docs`` that
    clash with a result column are replaced; without ``cleaned`` texts are
    neither rebuilt nor returned.
    """
    added = {**_TYPES, **({cleaned: "string"} if cleaned else {})}
    carry = [f for f in docs.schema.fields if f.name not in added and (cleaned or f.name != text)]
    schema = T.StructType([*carry, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in added.items())])
    source = docs.select(docs[text].alias("_judged"), *[f"`{f.name}`" for f in carry])
    names = [f.name for f in carry]

    @W.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.slabs(batch.column(0)):
                found, texts = _judge(data, offsets)
                if cleaned:
                    found[cleaned] = pa.array(texts, pa.binary()).cast(pa.string())
                part = batch.slice(at, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *(x if isinstance(x, pa.Array) else pa.array(x) for x in (found[n] for n in added))],
                    names=[*names, *added])

    return source.mapInArrow(run, schema)


def oracle() -> str:
    """The same in SQL, without the cleaned texts."""
    space, symbols = r"\x20\x09-\x0D", "#*$%&|<>"
    notices = " OR ".join(f"contains(low, '{n}')" for n in NOTICES)
    closes = "".join(chr(b) for b in range(128) if _END[b]).replace("'", "''") + "".join(c.decode() for c in _CLOSE_WIDE)

    def count(signs: str, text: str) -> str:
        return f"length(regexp_replace({text}, '[^{signs}]', '', 'g'))"

    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{space}]+') AS w FROM documents),
    every AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
    lines AS (SELECT *, len(regexp_extract_all(l, '[^{space}]+')) AS n, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) > 1 AS again,
        translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        right(regexp_replace(l, '[{space}]+$', ''), 1) AS last, {count('A-Z', 'l')} AS ups, {count('a-z', 'l')} AS lows
        FROM every WHERE regexp_matches(l, '[^{space}]')),
    judged AS (SELECT *, length(l) AS size, n <= {MAX_NOTICE_WORDS} AND ({notices}) AS notice, NOT contains('{closes}', last)
        OR {count('|', 'l')} * 5 >= n OR {count(symbols, 'l')} * 2 >= n OR (ups * 100 > {MAX_UPPER_PERCENT} * (ups + lows) AND n >= 3) AS bad FROM lines),
    sums AS (SELECT doc_id, count_if(again) AS dup, sum(size)::BIGINT AS all_chars, coalesce(sum(size) FILTER (bad OR notice), 0)::BIGINT AS lost,
        coalesce(sum(size) FILTER (bad AND NOT notice), 0)::BIGINT AS harm, coalesce(sum(size) FILTER (NOT notice), 0)::BIGINT AS rest FROM judged GROUP BY doc_id),
    windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(w[i + 1:i + {WINDOW}], ' '))) AS n
        FROM (SELECT doc_id, w, unnest(range(len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})),
    repeats AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM windows WHERE n > 1) GROUP BY doc_id),
    base AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[{space}]', '', 'g')) AS word_chars, {count(symbols, 't')} AS n_symbols,
        coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_chars, coalesce(all_chars, 0) AS all_chars,
        coalesce(harm, 0) AS harm, coalesce(rest, 0) AS rest, len(w) < {MIN_WORDS} OR 100 * coalesce(n, 0) > {MAX_REPEAT_PERCENT} * len(w) AS base_failed
        FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN repeats USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
        NOT base_failed AND 100 * lost_chars <= {MAX_GONE_PERCENT} * all_chars AND lost_chars < all_chars AND 100 * harm <= {MAX_LOST_PERCENT} * rest
        AND 100 * n_symbols <= {MAX_SYMBOL_PERCENT} * word_chars AS kept FROM base"""
