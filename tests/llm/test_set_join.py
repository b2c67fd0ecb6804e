import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litspark.llm import set_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=150, noise=0.03):
    r = random.Random(seed)
    bank = [f"w{k}" for k in range(400)]
    passage = [r.choice(bank) for _ in range(30)]
    out, bases = [], [[r.choice(bank) for _ in range(r.choice([4, 6, 9, 30, 60, 120]))] for _ in range(12)]
    for _ in range(n):
        words = list(r.choice(bases))
        for k in range(len(words)):
            if r.random() < noise / 5:
                words[k] = r.choice(bank)
        if r.random() < 0.15:
            words = words[:len(words) * r.randrange(80, 101) // 100]
        if r.random() < 0.2:
            words += passage
        out.append(r.choice([" ", "  ", "\n"]).join(w.upper() if r.random() < 0.05 else w for w in words))
    return out


FAMILY = [" ".join(f"t{k}" if k not in (i % 83, (i * 7) % 83) else f"x{i}" for k in range(83)) for i in range(160)]
CASES = [
    list(enumerate(corpus(1))),
    list(enumerate(corpus(2, noise=0.12))) + [(999, None), (998, ""), (997, " \n"), (996, "one"), (995, "One"), (994, "a b c d"), (993, "a b c d e")],
    [(i % 7 if i % 5 else None, t) for i, t in enumerate(corpus(3, 80))],
    list(enumerate(FAMILY)) + [(900 + i, t) for i, t in enumerate(FAMILY[:20] * 3)],
]


@pytest.mark.parametrize("rows", CASES)
def test_links(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "1 as n", "2 as sid", "'x' as component_id")
    out = J.link_sets(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert J.link_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(1, 60), st.integers(0, 59), st.booleans()), min_size=1, max_size=300))
def test_blocks_skip_only_what_cannot_link(drawn):
    e = np.zeros(len(drawn), J.ENTRY)
    for k, (token, centre, n, at, many) in enumerate(drawn):
        e[k] = (token, centre, centre % 20 + 40 if n else 0, min(at, centre % 20 + 39), centre % 5 == 0)
    e = J._entries([e])
    x, y, c = J.list_pairs(e)
    got = dict(zip(zip(x.tolist(), y.tolist()), c.tolist()))
    want = {}
    for i in range(len(e)):
        for j in range(i):
            a, b = e[i], e[j]
            if a["token"] != b["token"] or a["centre"] == b["centre"]:
                continue
            n, m = int(a["n"]), int(b["n"])
            if not (a["many"] or b["many"]):
                most = min(int(a["at"]), int(b["at"])) + min(n - int(a["at"]), m - int(b["at"]))
                if 10 * min(n, m) < 8 * max(n, m) or 180 * most < 80 * (n + m):
                    continue
                want[tuple(sorted((int(a["centre"]), int(b["centre"]))))] = want.get(tuple(sorted((int(a["centre"]), int(b["centre"])))), 0) + 1
    assert {k: v for k, v in got.items() if k[0] % 5 and k[1] % 5} == want


def long_lists(n, lists):
    """Entries of ``lists`` shingles that the same ``n`` sets of a size hold at nearly the same position."""
    e = np.zeros(n * lists, J.ENTRY)
    e["token"], e["centre"], e["n"], e["at"] = np.repeat(np.arange(lists), n), np.tile(np.arange(n) * 7 - n, lists), 100, np.repeat(np.arange(lists), n)
    return J._entries([e])


def test_a_task_holds_a_bounded_number_of_pairs():
    e, pairs, total = long_lists(2000, 6), 2000 * 1999 // 2, 0
    tracemalloc.start()
    try:
        for x, y, c in J.pair_runs(e):
            assert (x < y).all() and len(x) <= J.PAIRS + J.OFFERED
            total += int(c.sum())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 6 * pairs
    # 12 million pairs are offered, 2 million of them distinct.
    assert peak < 200e6


def test_runs_add_up_to_all_pairs():
    e = long_lists(150, 3)
    x, y, c = J.list_pairs(e)
    want, runs = dict(zip(zip(x.tolist(), y.tolist()), c.tolist())), list(J.pair_runs(e, 40, 200))
    assert len(want) == 150 * 149 // 2 and set(want.values()) == {3} and len(runs) > 3
    got = {}
    for run in runs:
        for a, b, k in zip(*(v.tolist() for v in run)):
            got[a, b] = got.get((a, b), 0) + k
    assert got == want


def test_small_runs_give_the_same(spark, monkeypatch):
    rows = list(enumerate(corpus(5)))
    for name, value in (("OFFERED", 5), ("PAIRS", 20), ("BUCKET_ENTRIES", 300), ("PAIR_HOMES", 3)):
        monkeypatch.setattr(J, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, J.link_sets(df).collect()), key=str) == brute(rows)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r["node"]: r["component"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
