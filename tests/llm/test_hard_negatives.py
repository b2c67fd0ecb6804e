"""Hard negatives against a sort of all pairs."""

import math
import random

from pyspark.sql import functions as F

from litspark.llm import hard_negatives as H
from litspark.llm import queries as Q
from tests.oracle import connect, difference


def brute(rows, anchor, k=5, low=80):
    rows = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks, out = {}, []
    for i, y, v in rows:
        if anchor(i):
            asks[i] = min(asks.get(i, (v, y)), (v, y))
    for i, (v, y) in asks.items():
        pairs = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in rows if j != i and len(w) == len(v))
        for p, j, _ in [x for x in pairs if x[2] == y][:k]:
            near = [(n, m) for n, m, z in pairs if z != y and low * -p <= 100 * -n <= 100 * -p][:k]
            out += [(i, j, r + 1, m, -p, -n) for r, (n, m) in enumerate(near)]
    return sorted(out)


def data(seed, n=300, dim=6):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.randrange(3), [rng.choice((rng.uniform(-1, 1), 0.5)) for _ in range(dim)]) for _ in range(n)]
    rows += [(i, 1, [0.5] * dim) for i in range(400, 520)] + [(i, 2, [0.5] * dim) for i in range(520, 600)]
    rows += [(600, 0, [0.25] * 3), (601, 1, [0.2] * 3), (602, 0, [0.3] * 3), (603, 0, []), (604, 1, [0.0] * dim), (610, 1, [0.5] * dim)] * 2
    return rows + [(1, None, [1.0] * dim), (2, 1, None), (3, 1, [None] * dim), (4, 1, [float("nan")] * dim), (None, 1, [1.0] * dim),
                   (5, 1, [float("inf")] * dim)]


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label int, embedding array<double>, score int").repartition(4)
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % 10 == 0, **how).collect()))


def test_against_all_pairs(spark):
    for seed in range(2):
        rows = data(seed)
        assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_many_blocks_and_other_limits(spark):
    rows = data(7, 120)
    got = run(spark, rows, k_positives=3, k_negatives=3, low=95, block_components=60)
    assert got == brute(rows, lambda i: i % 10 == 0, 3, 95)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, data(0)[:0] + [(7, 1, [1.0])]) == []


def test_exact_beyond_floating_point(spark):
    rows = [(0, 0, [2.0**20 + 1 / 256, 3.0]), (1, 0, [2.0**20 + 2 / 256, 3.0]), (2, 1, [2.0**20 + 1 / 256, 3.0]), (3, 1, [2.0**20, 2.0])]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    name = "op13_secondary_sort_negatives"
    assert difference(Q.QUERIES[name](spark, sf_dir), connect(sf_dir), Q.ORACLE[name]) is None
