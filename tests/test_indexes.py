"""Stored indexes against exhaustive search, fresh indexes and plain matching."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.operators import corpus, keyword_segments, names, safety, vector_index
from litspark.operators.dense import dense_topk
from litspark.operators.keyword import build_keyword_index, keyword_topk
from litspark.sources import runs


def _vectors(spark, n, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(12, dims))
    x = heads[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, dims))
    x[: n // 3] = x[0]   # a third of all rows is one vector
    rows = [(f"c{i}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * dims), ("none", None), ("nan", [float("nan")] * dims)]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<double>"), [(f"q{i}", (heads[i] + 0.1).tolist()) for i in range(12)]


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in df.collect())


def test_vector_index_recall_and_exact_search(spark, tmp_path):
    vectors, asked = _vectors(spark, 3000)
    queries = spark.createDataFrame(asked + [("blank", None)], "query_id string, embedding array<double>")
    want = dense_topk(queries, vectors.where("chunk_id not in ('nan')"))
    index = vector_index.build(vectors, str(tmp_path / "v"))
    assert index.rows.count() == 3000
    found = vector_index.search(index, queries, probes=12)
    exact = {(q, c) for q, _, c, _ in _rows(want)}
    got = {(q, c) for q, _, c, _ in _rows(found)}
    assert len(exact & got) >= 0.9 * len(exact)
    assert _rows(vector_index.search(index, queries, exact=True)) == _rows(want)
    # Only probed lists are read, and codes are scored without the vectors.
    names_, x = vector_index._asked(queries)
    plan = vector_index.candidates(index, names_, x, 2, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "ReadSchema: struct<chunk_id:string,code:binary>" in plan


def test_vector_index_without_rows(spark, tmp_path):
    vectors, asked = _vectors(spark, 30)
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    empty = vector_index.build(vectors.limit(0), str(tmp_path / "e"))
    assert vector_index.search(empty, queries).count() == 0
    only = vector_index.build(vectors.where("chunk_id = 'zero'"), str(tmp_path / "z"))
    assert vector_index.search(only, queries, exact=True).count() == 0
    one = vector_index.build(vectors.where("chunk_id = 'c1'"), str(tmp_path / "o"), n_lists=9)
    assert vector_index.search(one, queries, k=3).count() == 12


def _texts(rng, n):
    words = [f"w{i}" for i in range(300)]
    return [" ".join(words[min(int(rng.paretovariate(0.8)), 299)] for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_segments_equal_a_fresh_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_segments, "BLOCK", 4)
    monkeypatch.setattr(keyword_segments, "SALT_POSTINGS", 60)
    rng, path, live = random.Random(4), str(tmp_path / "k"), {}
    queries = spark.createDataFrame([(f"q{i}", " ".join(f"w{rng.randrange(4, 24)}" for _ in range(1 + i % 3))) for i in range(8)] + [("none", "zzz"), ("nil", None)],
                                    "query_id string, question string")

    def check():
        chunks = spark.createDataFrame(list(live.items()), "chunk_id string, text string")
        want = keyword_topk(build_keyword_index(chunks), queries, 5)
        found = keyword_segments.search(spark, path, queries, 5)
        assert _rows(found.top) == _rows(want)
        return found.blocks.agg(F.sum("blocks"), F.sum("skipped")).first()

    for step in range(2):
        new = {f"c{rng.randrange(500)}": t for t in _texts(rng, 250)}
        gone = rng.sample(sorted(live), min(len(live), 40))
        gone = [c for c in gone if c not in new]
        keyword_segments.change(spark, path, f"s{step}", spark.createDataFrame(list(new.items()), "chunk_id string, text string"),
                                spark.createDataFrame([(c,) for c in gone + ["unknown"]], "chunk_id string"))
        live = {k: v for k, v in live.items() if k not in gone} | new
        blocks, skipped = check()
        assert 0 < skipped < blocks
    # A step that breaks off before its commit leaves nothing behind that counts.
    commit = runs.commit

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(runs, "commit", broken)
    with pytest.raises(RuntimeError):
        keyword_segments.change(spark, path, "lost", spark.createDataFrame([("x", "w1 w2 w3")], "chunk_id string, text string"))
    monkeypatch.setattr(runs, "commit", commit)
    check()
    keyword_segments.compact(spark, path, "compact")
    assert keyword_segments._table(spark, path, "gone").count() == 0
    check()
    keyword_segments.change(spark, path, "last", remove=spark.createDataFrame([(c,) for c in sorted(live)[:100]], "chunk_id string"))
    live = dict(sorted(live.items())[100:])
    check()


def test_search_of_an_empty_index(spark, tmp_path):
    queries = spark.createDataFrame([("q", "a b")], "query_id string, question string")
    assert keyword_segments.search(spark, str(tmp_path / "none"), queries).top.count() == 0
    keyword_segments.change(spark, str(tmp_path / "k"), "s", spark.createDataFrame([("c", None), ("d", "")], "chunk_id string, text string"))
    assert keyword_segments.search(spark, str(tmp_path / "k"), queries).top.count() == 0


def _entries(spark, rng):
    letters = "abÉ "
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(0, 4)))
    some = lambda: rng.choice([None, [], [word() for _ in range(rng.randrange(1, 4))]])
    rows = [(i, word(), some(), some(), "FDA", rng.choice(["w", "", None]), rng.choice(["f", None])) for i in range(40)]
    return spark.createDataFrame(rows, "ord long, drug string, aliases array<string>, indication_keywords array<string>, jurisdiction string, "
                                       "warning string, warning_fr string")


def test_automaton_equals_matching_in_place(spark):
    rng = random.Random(8)
    texts = [(i, *(None if rng.random() < 0.1 else "".join(rng.choice("abéÉB ") for _ in range(rng.randrange(0, 12))) for _ in range(2))) for i in range(200)]
    df = spark.createDataFrame(texts, "id long, a string, b string")
    for case in range(3):
        entries = safety.withdrawal_entries(_entries(spark, rng))
        want = safety.match_entries(df, F.col("a"), F.col("b"), entries)
        got = names.match_names(df, F.col("a"), F.col("b"), entries)
        assert {r["id"]: [m["ord"] for m in r["matches"]] for r in want.collect()} == {r["id"]: r["entries"] for r in got.collect()}
    with pytest.raises(ValueError):
        names.match_names(df, F.col("a"), F.col("b"), entries, max_patterns=3)
    assert names.match_names(df.limit(0), F.col("a"), F.col("b"), entries).count() == 0


def test_watched_names_are_whole_words(spark):
    rec = spark.createDataFrame([(1, "Olaparib, niraparib.", "old"), (2, "xolaparib olaparib2", "old"), (3, None, "old"), (4, "été OLAPARIB", "old")],
                                "seq long, text string, drug string")
    watch = spark.createDataFrame([("olaparib",), (" Niraparib ",), ("",), (None,), ("olaparib",)], "drug string")
    got = sorted((r["seq"], r["drug"]) for r in names.attribute(rec, watch, F.col("text")).collect())
    assert got == [(1, "niraparib"), (1, "olaparib"), (4, "olaparib")]
    assert names.attribute(rec, watch.limit(0), F.col("text")).count() == 0


def test_harvest_windows_stay_below_the_limit(spark):
    rng = random.Random(1)
    days = [(date(2019, 12, 30) + timedelta(days=rng.randrange(900)), rng.randrange(0, 9)) for _ in range(900)]
    days += [(date(2021, 3, 5), 70), (date(2021, 3, 6), 500), (None, 9)]
    df = spark.createDataFrame(days, "day date, hits long")
    total = sum(h for d, h in days if d)
    for limit in (50, 120, 2_000, 100_000):
        got = corpus.harvest_windows(df, limit).orderBy("start").collect()
        assert sum(r["hits"] for r in got) == total
        assert all(r["hits"] <= limit or (r["over"] and r["start"] == r["end"]) for r in got)
        assert all(a["end"] < b["start"] for a, b in zip(got, got[1:]))
        for r in got:
            assert r["hits"] == sum(h for d, h in days if d and r["start"] <= d <= r["end"])
    assert len(got) == 1
    assert corpus.harvest_windows(df.limit(0)).count() == 0


def test_salted_copies_are_not_broadcast(spark):
    """Spark estimates a table and its copies alike; with copies for every salt it is far beyond what a driver broadcasts."""
    from litspark.sizing import join_small
    big = spark.range(2000).withColumn("key", F.col("id") % 50)
    small = spark.range(40).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    for how, n in (("inner", 1600), ("left", 2000), ("left_semi", 1600)):
        got = join_small(big, small, ["key"], how, spread=F.col("id"), max_rows=0)
        assert got.count() == len(got.collect()) == n
        assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_segment_scores_hold_no_pairs(spark, tmp_path):
    """Blocks are scored by postings, not by pairs of questions and postings."""
    chunks = spark.createDataFrame([(f"c{i:03}", f"w{i % 7} w{i % 5} v{i % 3} x{i}") for i in range(90)], "chunk_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", f"w1 w4 v{i % 3} x{i}") for i in range(20)], "query_id string, question string")
    keyword_segments.change(spark, str(tmp_path / "s"), "one", chunks)
    found = keyword_segments.search(spark, str(tmp_path / "s"), asked, 5).top
    want = keyword_topk(build_keyword_index(chunks), asked, 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") >= 2
