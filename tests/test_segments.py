"""Keyword segments in parts: their words, their postings, and searches that shuffle none of them."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from litspark.functions.text import tokens
from litspark.operators import keyword_parts, keyword_segments
from litspark.operators.keyword import build_keyword_index, keyword_topk


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in df.collect())


def _chunks(spark, live):
    return spark.createDataFrame(sorted(live.items()), "chunk_id string, text string")


def _questions(spark):
    return spark.createDataFrame([(f"q{i}", f"w{i % 5} w{i % 7} v{i} été{i % 3} στος") for i in range(12)], "query_id string, question string")


def _text(rng, i):
    return " ".join(rng.choice([f"w{rng.randrange(12)}", f"V{rng.randrange(30)}", f"ÉTÉ{rng.randrange(4)}", "ΣΤΟΣ" if i % 9 == 0 else "x"]) for _ in range(rng.randrange(1, 25)))


def test_words_are_those_of_the_expression(spark):
    """All characters that are looked up in bytes, alone and between letters, and texts with others beside them."""
    plain = [chr(c) for c in [*range(0x2C0), *range(0x2000, 0x2070)] if c not in (0x130, 0x23A, 0x23E)]
    texts = [f"A{c}b{c}{c}9" for c in plain] + [c for c in plain] + ["", " ", "Straße, ÉTÉ_2 déjà×vu ÷ x", "…", "“a”–b", None]
    odd = ["İx", "ȺȾ", "ΣΟΦΟΣ x", "Привет, мир", "漢字 kana", "a\U0001d400b", "x́y", "�", "½ⅷ"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts + odd)], "chunk_id string, text string")
    got = {r["chunk_id"]: r for r in keyword_parts.counted_input(df).collect()}
    want = {r["chunk_id"]: r["t"] for r in df.select("chunk_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    for i, t in enumerate(texts):
        assert got[str(i)]["tokens"] is None, t
    for i in range(len(texts), len(texts) + len(odd)):
        assert got[str(i)]["tokens"] == want[str(i)]
    rows = [got[str(i)]["text"] for i in range(len(texts))]
    found, n = keyword_parts.words(pa.array(["skipped", *rows]).slice(1))
    assert list(n) == [len(want[str(i)]) for i in range(len(texts))]
    assert found.to_pylist() == [w for i in range(len(texts)) for w in want[str(i)]]


def test_steps_equal_a_fresh_index(spark, tmp_path, monkeypatch):
    """Added, replaced, removed, compacted and asked in turns, with other scripts, ids that come twice and texts without words."""
    monkeypatch.setattr(keyword_segments, "BLOCK", 3)
    monkeypatch.setattr(keyword_segments, "SALT_POSTINGS", 40)
    rng, path, asked = random.Random(3), str(tmp_path / "s"), _questions(spark)
    live = {f"c{i}": _text(rng, i) for i in range(120)} | {"blank": "", "null": None}
    twice = _chunks(spark, live)
    keyword_segments.change(spark, path, "one", twice.unionByName(twice))
    new = {f"c{i}": _text(rng, i) for i in range(60, 150)}
    keyword_segments.change(spark, path, "two", _chunks(spark, new), spark.createDataFrame([("c3",), ("c4",), ("none",)], "chunk_id string"))
    live = {k: v for k, v in (live | new).items() if k not in ("c3", "c4")}

    def check():
        want = keyword_topk(build_keyword_index(_chunks(spark, live)), asked, 4)
        found = keyword_segments.search(spark, path, asked, 4)
        assert _rows(found.top) == _rows(want)
        return found

    check()
    before = keyword_segments._table(spark, path, "parts").count()
    keyword_segments.compact(spark, path, "compact")
    after = keyword_segments._table(spark, path, "parts")
    assert after.agg(F.sum("n")).first()[0] == len(live) and after.count() <= before
    monkeypatch.setattr(keyword_segments, "MAX_QUERY_TERMS", 20)
    check()


def test_search_moves_no_postings(spark, tmp_path):
    """Postings are scored in the task that reads them: none are exploded or dealt out by chunk, and a part is one row."""
    rng, path, asked = random.Random(5), str(tmp_path / "s"), _questions(spark)
    live = {f"c{i}": _text(rng, i) for i in range(200)}
    keyword_segments.change(spark, path, "one", _chunks(spark, live).coalesce(1))
    assert keyword_segments._table(spark, path, "parts").count() == 1
    plan = keyword_segments.search(spark, path, asked, 4).top._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "REPARTITION" not in plan
    for name, rows in (("parts", 1), ("gone", 0), ("totals", 1)):
        assert keyword_segments._table(spark, path, name).count() == rows


def test_questions_whose_chunks_are_gone(spark, tmp_path):
    """Terms that only deleted chunks hold, or that no chunk near a floor holds, leave parts without a row."""
    path = str(tmp_path / "s")
    live = {f"c{i}": f"a{i % 7} b{i % 3} common" for i in range(40)}
    keyword_segments.change(spark, path, "one", _chunks(spark, live | {"gone": "rare a1"}))
    keyword_segments.change(spark, path, "two", remove=spark.createDataFrame([("gone",)], "chunk_id string"))
    asked = spark.createDataFrame([("q1", "rare"), ("q2", "a1 rare b2"), ("q3", "common")], "query_id string, question string")
    want = keyword_topk(build_keyword_index(_chunks(spark, live)), asked, 3)
    assert _rows(keyword_segments.search(spark, path, asked, 3).top) == _rows(want)
