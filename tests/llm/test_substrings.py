import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from litspark.llm import substrings as S


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for at in range(len(t) - length + 1):
            if seen[t[at:at + length]] > 1:
                gone[at:at + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n=60):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdeéß ") for _ in range(k))
    passages = [word(r.choice([23, 24, 25, 40, 90, 300])) for _ in range(6)]
    out = []
    for _ in range(n):
        body = word(r.randrange(0, 200))
        for _ in range(r.randrange(0, 3)):
            body += r.choice(passages)[r.randrange(0, 9):] + word(r.randrange(0, 60))
        out.append(body)
    return out


CASES = [
    [(i, t) for i, t in enumerate(texts(1))],
    [(i, t) for i, t in enumerate(texts(2) + ["a" * 100, "ab" * 90, None, "", "x", "a" * 24, "a" * 25, "y" * 23, "y" * 24])],
    [(i % 3, t) for i, t in enumerate(texts(3, 12) * 3)] + [(None, "z" * 30), (None, "q" * 30), (None, "q" * 30)],
]


@pytest.mark.parametrize("rows", CASES)
def test_remove(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 as n_spans", "'x' as lang")
    got = S.remove_repeats(df, length=24)
    assert got.columns == ["doc_id", "text", "lang", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cleaned"]
    found = [tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(found, key=str) == brute(rows, 24)
    assert S.remove_repeats(df.limit(0), length=24).count() == 0
    assert "text" not in S.remove_repeats(df.limit(1), cleaned=None).columns


def rounds(rows, length, buckets=3, combined=50, bucket_records=20, segment=64):
    """Both rounds without Spark, in tiny parts; the spans per row number."""
    old = S.SEGMENT
    S.SEGMENT = segment
    try:
        parts = []
        for i, (_, t) in enumerate(rows):
            data = np.frombuffer((t or "").encode(), np.uint8)
            for piece, cuts, _, shift in S.segments(data, np.array([0, len(data)]), length):
                row, start, end, a, b = S.anchors(piece, cuts, length)
                parts.append(S._records(a, b, np.full(len(a), i), np.zeros(len(a)), start + shift[row], end - start, 0))
    finally:
        S.SEGMENT = old
    return np.concatenate(parts)


@pytest.mark.parametrize("seed", range(4))
def test_every_window_has_one_anchor(seed):
    rows = list(enumerate(texts(seed, 20)))
    for segment in (64, 1 << 20):
        found = rounds(rows, 24, segment=segment)
        for i, t in rows:
            own = found[found["id"] == i]
            covered = sorted(w for r in own for w in range(r["at"], r["at"] + r["more"] + 1))
            assert covered == list(range(max(0, len(t.encode()) - 23)))
            assert own["more"].max(initial=0) <= 12


def test_small_parts_give_the_same(spark, monkeypatch):
    for name, value in (("COMBINED", 40), ("BUCKET_RECORDS", 15), ("SEGMENT", 64), ("BUCKET_BYTES", 2000)):
        monkeypatch.setattr(S, name, value)
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[S.__name__])
    try:
        rows = CASES[1]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = [tuple(r) for r in S.remove_repeats(df, length=24).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
        assert sorted(found, key=str) == brute(rows, 24)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[S.__name__])


def test_only_texts_with_repeats_move(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abcdefgh") for _ in range(60))) for i in range(2000)]
    rows += [(2000 + i, rows[i][1][:40] + str(i)) for i in range(50)] + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed, spans = S.repeated_spans(df, "doc_id", "text", 24)
    told = {(k["doc_id"], k["text"]) for k in keyed.where("_among").collect()}
    assert {(i, t) for i, t in rows if i is not None and (i < 50 or i >= 2000)} <= told and len(told) < 200
    assert spans.count() == 100 and keyed.count() == len(rows)
    # A full bitmap may say yes to all, never no to a key.
    monkeypatch.setattr(S, "MAX_BITS", 8)
    monkeypatch.setattr(S, "_BITMAP_BITS", 8)
    assert S._among(keyed.drop("_among"), spans, 100).where("_among").join(spans, ["_id", "_h"]).count() == 100
    found = [tuple(r) for r in S.remove_repeats(df, length=24).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(found, key=str) == brute(rows, 24)
