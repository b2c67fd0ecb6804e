import zlib

import pytest

from litspark.llm import sharding as S

WIDE = [(i, "ab" * (i * 7919 % 300)) for i in range(900)]
HOT = WIDE[:300] + [(1000 + i, "the same long text " * 20) for i in range(400)]


@pytest.mark.parametrize("docs", [
    WIDE, HOT, WIDE[:3], [(1, None), (2, ""), (None, "é")], [(5, "same")] * 50, [(1, "x" * 100000)] + WIDE[:200]])
def test_shards(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = S.shard(df).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i or -1, size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    load, slots = dict.fromkeys(range(16), 0), {}
    for r in rows:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean, most = sum(load.values()) / 16, max(size(t) for _, t in docs)
    assert all(abs(v - mean) <= most for v in load.values())
    # Equal texts lie next to each other: a group spans no more shards than its bytes need, and one.
    for t in {t for _, t in docs}:
        at = {r["shard"] for r in rows if r["text_crc32"] == zlib.crc32((t or "").encode())}
        group = sum(size(x) for _, x in docs if x == t)
        assert len(at) <= group // max(mean - most, 1) + 2 or mean <= most
    again = S.shard(df.repartition(3)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_ranges_are_cut_where_a_group_is_hot(spark):
    df = spark.createDataFrame(HOT, "doc_id long, text string").selectExpr("*", "1 as size", "'x' as shard")
    out = S.shard(df)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    hot = [r["shard"] for r in out.collect() if r["text_crc32"] == zlib.crc32(HOT[-1][1].encode())]
    assert len(set(hot)) > 4
    assert S.shard(df.limit(0)).count() == 0
