import re

import pytest
from pyspark.sql import functions as F

from litspark.llm import mixing as M
from litspark.llm.common import first_words, n_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, share=1.5, cycle=(3, 1, 2)):
    """Reshare the excess by weight until no source is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: cycle[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **{s: level * weight[s] for s in free}}
        fixed.update({s: 2 * sizes[s] for s in over})


def check(rows, docs):
    size = {i: len(WORD.findall(t or "")) for i, (_, t, _) in enumerate(docs)}
    sizes = {}
    for i, (_, _, s) in enumerate(docs):
        sizes[s] = sizes.get(s, 0) + size[i]
    want, taken = targets(sizes), {}
    assert len(rows) == len(docs)
    by_id = {d[0]: (len(WORD.findall(d[1] or "")), d[2]) for d in docs}
    for r in rows:
        n, s = by_id[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s])
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * n
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, n in taken.items():
        assert n == int(want[s] + 0.5)


DOCS = [(i, " ".join(["w"] * (i % 17)), ["a", "b", "é", "Z", None][i % 5] if i % 3 else "a") for i in range(400)]


@pytest.mark.parametrize("docs", [
    DOCS, DOCS[:1], DOCS[:7], [(i, "x y", "s") for i in range(50)] + [(99, "z " * 3000, "t")],
    [(1, None, None), (2, "", "a"), (3, " \t", "b")]])
def test_mix(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = M.mix_sources(df).collect()
    check(rows, docs)
    assert sorted(rows) == sorted(M.mix_sources(df.repartition(5)).collect())


def test_words_and_prefix(spark):
    texts = [None, "", " ", "a", " a  b\n", "é\x0bü\fz\x1dq", "x" * 9000 + " y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(n_words(F.col("text"))).collect()] == [len(WORD.findall(t or "")) for t in texts]
    assert df.select(first_words(F.lit(" a  b\nc "), F.lit(2))).first()[0] == " a  b"


def test_documents_follow_the_mix(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumn("_key_x", F.lit(1)).withColumn(
        "n_chars", F.length("text").cast("long"))
    taken = {r["doc_id"]: r["taken"] for r in M.mix_sources(df).collect()}
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    got = {r[0]: r[1] for r in out.groupBy("doc_id").agg(F.sum(n_words(F.col("text")))).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}
    assert out.where("n_chars != length(text)").count() == 0


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d e", "s")] * 60 + [(None, "q r", "s")] * 3, "doc_id long, text string, source string")
    rows = M.mix_sources(df).collect()
    assert len(rows) == 63 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 306 * 1.5) <= 63
    assert M.mix_sources(df.limit(0)).count() == 0 and M.mixed_documents(df.limit(0)).count() == 0
