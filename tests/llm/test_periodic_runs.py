"""Periodic runs against a search of every period, and the query's planted texts."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from litspark.llm import periodic_runs as P
from litspark.llm import queries as Q
from litspark.llm import words as W


def brute(text, min_length=P.MIN_LENGTH):
    """Every maximal stretch of every period; of one stretch, the smallest period."""
    n, found = len(text), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and text[j] == text[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted(((s, n_, q) for (s, n_), q in found.items()), key=lambda r: (r[0], r[2]))


def test_find_runs_of_random_texts():
    rng = random.Random(3)
    for case in range(400):
        text = [rng.randrange(rng.choice((1, 2, 3, 5))) for _ in range(rng.randrange(0, 60))]
        if case % 3 == 0:
            unit = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
            text += (unit * 12)[:rng.randrange(1, 80)] + text[:20]
        for least in (2, P.MIN_LENGTH):
            assert P.find_runs(text, least) == brute(text, least), text


def test_long_unary_and_fibonacci_texts():
    assert P.find_runs([7] * 20_000) == [(0, 20_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 2_000:
        a, b = b, b + a
    assert P.find_runs(b, 2) == brute(b, 2)


def judged(text):
    words = [w for w in "".join(" " if c in W_SPACE else c for c in text or "").split(" ") if w]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


W_SPACE = " \t\n\x0b\f\r"


def planted(doc_id, text):
    words = [w for w in "".join(" " if c in W_SPACE else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def texts():
    rng = random.Random(5)
    rows = [None, "", " \n\t ", "x", "a " * 500, "nb sp é " * 30, "lone words only here", "Ab aB " * 9]
    for _ in range(60):
        line = " ".join(rng.choice("uvwxyz") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 40)))
        rows.append(rng.choice(("\n", "  ", "\r\n")).join([line] * rng.randrange(1, 5)) + " " + " ".join(str(rng.randrange(9)) for _ in range(30)))
    return rows + [rows[-1]]


def test_operator_on_whole_texts(spark):
    rows = [(None if i == 4 else i % 50, t, i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = P.periodic_runs(docs).collect()
    want = sorted((x, *judged(t)) for x, t, _ in [(str(a), b, c) for a, b, c in rows])
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == want
    assert P.periodic_runs(docs.limit(0)).count() == 0
    assert "text" not in P.periodic_runs(docs, collapsed=None).columns


def test_text_beyond_a_slab(spark):
    text = "one two three " * 2_000 + " ".join(f"w{i}" for i in range(300_000)) + " x y" * 50
    r = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 6_000, 3), (306_000, 100, 2)]
    assert r["collapsed"].split(" ")[:4] == ["one", "two", "three", "w0"] and r["collapsed"].endswith(" x y")


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts() * 3)] + [(None, "a b " * 9), (0, "b a " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc_id, text in rows:
        n, runs, rest = judged(" ".join(planted(doc_id, text)))
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.append((str(doc_id), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest))))
    got = Q.op12_link_cut_runs(spark, str(tmp_path)).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert sorted(((r[0] or "None",) + tuple(r)[1:] for r in got.collect()), key=str) == sorted(want, key=str)
