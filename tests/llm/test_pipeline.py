import re

import pytest

import corpus_pipeline as P
from litspark.llm import quality_rules
from tests.llm.test_mixing import targets
from tests.llm.test_set_join import shingles
from tests.llm.test_substrings import brute as brute_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Every stage's rows, each written and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in P.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append((name, docs))
    return {name: df for name, df in out}


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(tables):
    for name, df in tables.items():
        if name != "pack":
            assert df.columns == list(P.COLUMNS)
            assert df.where("n_chars != length(text)").count() == 0 or name == "documents"


def test_quality(tables):
    judged = {r["doc_id"]: r for r in quality_rules.judge_lines(tables["documents"]).collect()}
    got = rows(tables["quality_rules"])
    assert set(got) == {i for i, r in judged.items() if r["kept"]}
    for i, r in got.items():
        lines = judged[i]["text"].split("\n")
        assert all(line in lines for line in r["text"].split("\n") if line)


def test_near_duplicates(tables):
    before, after = rows(tables["quality_rules"]), rows(tables["near_duplicates"])
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    ids, parent = sorted(before), {i: i for i in before}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    lo, hi = sorted((find(a), find(b)))
                    parent[hi] = lo
    assert set(after) == {i for i in ids if find(i) == i}


def test_substrings(tables):
    before, after = rows(tables["near_duplicates"]), rows(tables["repeated_substrings"])
    want = {w[0]: w for w in brute_substrings([(i, r["text"]) for i, r in before.items()], 200)}
    for i, w in want.items():
        left = w[1] - w[2]
        if i in after:
            assert len(after[i]["text"].encode()) <= left
            assert w[2] or after[i]["text"] == before[i]["text"]
        else:
            assert left == 0 or w[2]


def test_mixture(tables):
    before = rows(tables["repeated_substrings"])
    size, sizes = {i: len(WORD.findall(r["text"])) for i, r in before.items()}, {}
    for i, r in before.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[i]
    want, taken = targets(sizes), {}
    for r in tables["mix_sources"].collect():
        assert before[r["doc_id"]]["text"].startswith(r["text"])
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert taken == {s: int(t + 0.5) for s, t in want.items() if int(t + 0.5)}


def test_packing(spark, tables):
    pieces = tables["pack"].collect()
    full = {}
    for r in pieces:
        full[r["sequence_id"]] = full.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 4096 for k, n in full.items() if k != max(full))
    assert sum(full.values()) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert P.run(spark, SF_DIR).count() == len(pieces)


def test_repeated_and_null_ids(spark):
    text = "The old mill by the river turns slowly while the miller counts his sacks of grain every evening."
    rows = [(5, text), (5, text), (3, text), (None, text + " And more."), (None, "Quite another story about boats and tides and harbours at dawn."), (8, None), (5, "Under the same number stands an unrelated note about bees that nobody else has written down so far.")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.near_duplicates(spark, docs, SF_DIR)
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 5, 8]
    assert {r["text"][:5] for r in kept.where("doc_id = 5 or doc_id is null").collect()} == {"Under", "Quite"}
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
