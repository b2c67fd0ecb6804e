import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.llm import toxicity as X


def inputs(texts):
    blob = [t.encode() for t in texts]
    return X.Inputs(np.frombuffer(b"".join(blob), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blob])]))


def test_windows_cover_whole_texts():
    texts = ["", "one", " ".join(f"w{i}" for i in range(24)), " ".join(f"w{i}" for i in range(25)), "x " * 500, "\n", "é" * 9000]
    own = inputs(texts)
    for d, t in enumerate(texts):
        n, at = len(t.split()), np.flatnonzero(own.doc == d)
        starts = own.head[at] - sum(len(x.split()) for x in texts[:d])
        covered = {w for s, k in zip(starts, own.length[at]) for w in range(s, s + k)}
        assert covered == set(range(n)) and len(at) >= 1
        assert all(b - a <= X.STEP for a, b in zip(starts, starts[1:]))


def test_gradients():
    net = X.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    own, want = inputs(["a bad word here", "fine " * 30, "short"]), np.array([1.0, 0.0, 1.0])
    which = np.array([0, 1, len(own.doc) - 1])
    codes, length = own.window(which), own.length[which]
    x = net.embed(own.words, own.chars, own.begins, own.sizes)

    def loss(inner=None):
        z = net.forward(x if inner is None else inner, codes, length)
        return float(np.mean(np.log1p(np.exp(z)) - want * z))

    grads, dx = net.gradients(x, codes, length, want)
    rng, eps = np.random.default_rng(0), 1e-6
    for name, g in grads.items():
        for at in rng.integers(0, net.p[name].size, 4):
            flat = net.p[name].reshape(-1)
            old = flat[at]
            flat[at] = old + eps
            up = loss()
            flat[at] = old - eps
            down = loss()
            flat[at] = old
            assert g.reshape(-1)[at] == pytest.approx((up - down) / (2 * eps), abs=1e-7), name
    for r, c in ((0, 0), (1, 9), (2, 15)):
        a, b = x.copy(), x.copy()
        a[r, c] += eps
        b[r, c] -= eps
        assert dx[r, c] == pytest.approx((loss(a) - loss(b)) / (2 * eps), abs=1e-7)


def plain(net, x, codes, length):
    """One window's output, number by number."""
    p, h = net.p, X.HIDDEN
    dot = lambda a, m: [sum(float(a[i]) * float(m[i, j]) for i in range(len(a))) for j in range(m.shape[1])]
    states = [[0.0] * (2 * h) for _ in range(length)]
    for side, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
        now = [0.0] * h
        for t in order:
            g, u = dot(x[codes[t]], p[f"W{side}"]), dot(now, p[f"U{side}"])
            g = [a + float(c) for a, c in zip(g, p[f"c{side}"])]
            z, r = ([1 / (1 + math.exp(-(g[i + k] + u[i + k]))) for i in range(h)] for k in (0, h))
            new = [math.tanh(g[2 * h + i] + r[i] * u[2 * h + i]) for i in range(h)]
            now = [now[i] + (1 - z[i]) * (new[i] - now[i]) for i in range(h)]
            for i in range(h):
                states[t][i + (h if side == "b" else 0)] = now[i]
    weight = []
    for s in states:
        a = [math.tanh(v + float(b)) for v, b in zip(dot(s, p["Wa"]), p["ba"])]
        weight.append(math.exp(sum(v * float(c) for v, c in zip(a, p["v"]))))
    pooled = [sum(k * s[i] for k, s in zip(weight, states)) / sum(weight) if weight else 0.0 for i in range(2 * h)]
    return sum(v * float(c) for v, c in zip(pooled, p["w"])) + float(p["b"][0])


def test_network_matches_a_plain_loop():
    net = X.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    own = inputs(["", "one", "Some words of a text é, and more words of a text.", "over " * 30 + "the edge", "\n \n"])
    codes = own.window(np.arange(len(own.doc)))
    x = net.embed(own.words, own.chars, own.begins, own.sizes)
    got = net.forward(x, codes, own.length)
    assert len(got) >= 6
    for i in range(len(got)):
        assert got[i] == pytest.approx(plain(net, x, codes[i], own.length[i]), abs=1e-6)


CLEAN = "the river runs past old mills and quiet fields where people walk in the evening light of autumn".split()


def corpus(n=240):
    rng, docs = np.random.default_rng(5), []
    for i in range(n):
        words = rng.choice(CLEAN, rng.integers(20, 120)).tolist()
        if i % 2:
            words[rng.integers(len(words))] = rng.choice(["idiotic", "idiots", "idioten"])
        docs.append((i, " ".join(words), i % 2))
    return docs


def test_scores(spark):
    docs = corpus()
    odd = [(1000, None), (1001, ""), (1002, " \n"), (None, "the river"), (1003, "word " * 40000), (1003, "word " * 40000)]
    df = spark.createDataFrame([d[:2] for d in docs] + odd, "doc_id long, text string").selectExpr("*", "'x' as score")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in docs] + [(5000, 1, 0), (1001, None, 0)], "doc_id long, toxic int, quality int")
    out = X.score_toxicity(df, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r["doc_id"]: r for r in out.collect()}
    held = [i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"] and i is not None and i < 1000} == set(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert np.mean([got[i]["predicted"] == i % 2 for i in held]) > 0.95
    # Held-out labels never matter.
    flipped = labels.withColumn("toxic", F.when(X.fold(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in X.score_toxicity(df, flipped).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-3 for i in again)
    assert X.score_toxicity(df.limit(0), labels).count() == 0
    assert {r["score"] for r in X.score_toxicity(df.limit(3), labels.limit(0)).collect()} == {0.5}
