"""Passage removal against a search of all windows."""

import random

import numpy as np
import pytest

from litspark.llm import suffix_trees as S

SPACE = " \t\n\x0b\f\r"
LAST = (1 << 63) - 1


def split(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]


def brute(rows, length=S.LENGTH):
    least, out = {}, []
    for doc_id, text in rows:
        words = split(text)
        for i in range(len(words) - length + 1):
            key = tuple(words[i:i + length])
            least[key] = min(least.get(key, LAST), LAST if doc_id is None else doc_id)
    for doc_id, text in rows:
        words, gone = split(text), set()
        for i in range(len(words) - length + 1):
            if least[tuple(words[i:i + length])] < (LAST if doc_id is None else doc_id):
                gone.update(range(i, i + length))
        out.append((str(doc_id), len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out)


def corpus(seed, n=120, vocabulary=400):
    rng = random.Random(seed)
    say = lambda k: " ".join(f"w{min(int(rng.paretovariate(0.6)), vocabulary)}" for _ in range(k))
    passages, rows = [say(rng.choice((49, 50, 51, 60, 140))) for _ in range(6)], []
    for i in range(n):
        parts = [say(rng.randrange(0, 90))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            parts += [p, say(rng.randrange(0, 30))]
        rows.append((i, rng.choice((" ", "\n", "\t ")).join(parts)))
    rows += [(n + i, rows[i % 7][1]) for i in range(20)]
    rows += [(None, rows[3][1]), (None, rows[4][1] + " more"), (2, rows[2][1]), (5, rows[3][1]), (900, None), (901, ""), (902, " \n "),
             (903, say(49)), (904, "one " * 400), (905, "one " * 60), (904, "one " * 55), (906, "é " * 70 + "W1 " * 60), (907, "w1 " * 60)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **how):
    docs = spark.createDataFrame([(a, b, "x", 7) for a, b in rows], "doc_id long, text string, _spans string, n_words int")
    got = S.remove_passages(docs.repartition(5), **how)
    assert got.columns == ["doc_id", "text", "_spans", "n_words", "n_removed", "kept_text"]
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect())


@pytest.mark.parametrize("group_records", [S.GROUP_RECORDS, 30, 8, 0])
def test_prefixes_of_every_length(spark, group_records):
    rows = corpus(group_records)
    assert run(spark, rows, group_records=group_records, tree_words=2_000) == brute(rows)


def test_long_window_and_empty(spark):
    rows = corpus(9, 40)
    assert run(spark, rows, length=64) == brute(rows, 64)
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        S.remove_passages(spark.createDataFrame(rows, "doc_id long, text string"), length=20)


def test_very_long_text(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(50_000)}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, "a b " + " ".join(words[200_000:200_120]) + " c"), (0, " ".join(words[399_900:]))]
    assert run(spark, rows) == brute(rows)


def test_pivots_depend_on_the_window_alone(monkeypatch):
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 40).astype(np.uint64)[rng.integers(0, 40, 3_000)]
    rows = np.repeat([0, 1, 2], 1_000)

    def by_window(found):
        return {w: p for a, b, p in zip(*(x.tolist() for x in found)) for w in range(a, b + 1)}

    whole = by_window(S.pivots(hashes, rows))
    assert sorted(whole) == [r * 1_000 + i for r in range(3) for i in range(951)]
    monkeypatch.setattr(S, "SEGMENT", 137)
    assert by_window(S.pivots(hashes, rows)) == whole
    assert all(w <= p <= w + 25 for w, p in whole.items())
