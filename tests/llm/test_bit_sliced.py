import math

import numpy as np
import pytest

from litspark.llm import bit_sliced as B


def test_bitmap_sums():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 200):
        bits = rng.random((11, n)) < 0.4
        where = rng.integers(0, 5, 11)
        groups = {}
        for p, b in zip(where, bits):
            groups.setdefault(int(p), []).append(B._pack(b[None]))
        slices = B.add_slices(groups)
        got = sum(B._unpack(s, n).astype(int) << p for p, s in enumerate(slices) if s is not None)
        want = (bits * (1 << where)[:, None]).sum(axis=0)
        assert (got == want).all()
        for k in (1, 3, n):
            mask, floor = B.top_rows(slices, n, k)
            assert floor == sorted(want)[-min(k, n)]
            assert (B._unpack(mask, n) == (want >= floor)).all()
        for least in (0, 1, 7, int(want.max()), int(want.max()) + 9):
            assert (B._unpack(B.rows_from(slices, n, least), n) == (want >= least)).all()


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], {}
    for i, v in ok:
        if i % 100 == 0:
            asked[i] = min(v, asked.get(i, v))
    for q, a in asked.items():
        found = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ok if i != q and len(v) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


RNG = np.random.default_rng(3)
UNIT = [(i, [float(np.float32(x)) for x in RNG.normal(0, 0.12, 16)]) for i in range(900)]
ODD = [(0, [1.0, -2.5]), (100, None), (200, [None, 1.0]), (300, [float("nan"), 0.0]), (400, [float("inf"), 0.0]), (500, []), (7, []),
       (600, [0.0, 0.0]), (600, [0.0, 0.0]), (1, [1.0, -2.5]), (2, [1.0, -2.5]), (3, [1e6, -1e6]), (None, [1.0, 1.0]), (700, [-3.0, -0.001]), (8, [1.0])]


@pytest.mark.parametrize("rows", [UNIT, ODD, ODD + [(5, [0.5, 0.5])] * 30, [(0, [1.0])]])
def test_search(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as dim")
    got = B.search(df, df.where("vec_id % 100 = 0"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    if len(rows) == 1:
        assert B.search(df.limit(0), df.limit(0)).count() == 0


def test_copies_are_not_broadcast(spark):
    """Every query meets every block: the copies outgrow a driver, whatever their estimated size."""
    df = spark.createDataFrame(UNIT, "vec_id long, embedding array<double>")
    got = B.search(df, df.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(UNIT)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
