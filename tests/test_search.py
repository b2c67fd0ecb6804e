import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.operators import fusion
from litspark.operators.confidence import answer_confidence
from litspark.operators.dense import dense_topk
from litspark.operators.keyword import KeywordIndex, build_keyword_index, keyword_topk, prune_index
from litspark.operators import keyword, keyword_scan
from litspark.plans import retrieval
from litspark.plans.retrieval import keyword_search
from litspark import sizing


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    vocab = [f"t{i}" for i in range(60)] + ["the"] * 40
    texts = {f"c{i:03d}": " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for i in range(150)}
    texts.update({f"copy{i}": texts["c001"] for i in range(70)})
    return texts


def _bm25(texts, query, k1=1.5, b=0.75):
    toks = {c: re.sub(r"[^\w\s]", " ", t.lower()).split() for c, t in texts.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for ts in toks.values() for t in set(ts))
    out = {}
    for c, ts in toks.items():
        tf = Counter(ts)
        s = sum(max(math.log((n - df[w] + .5) / (df[w] + .5)), 0) * tf[w] / (tf[w] + k1 * (1 - b + b * len(ts) / avg))
                for w in query.lower().split() if w in tf)
        if s > 0:
            out[c] = s
    return out


def test_keyword_search_matches_brute_force(spark, corpus, tmp_path, monkeypatch):
    chunks = spark.createDataFrame(list(corpus.items()), "chunk_id string, text string")
    queries = {"q1": "t1 t2 the", "q2": "t5 t5 t7", "q3": "zzz", "q4": ""}
    q = spark.createDataFrame(list(queries.items()), "query_id string, question string")
    full = build_keyword_index(chunks)
    full.write(str(tmp_path / "index"))
    stored = KeywordIndex.read(spark, str(tmp_path / "index"))
    assert stored.is_current(chunks) and not stored.is_current(chunks.limit(3))
    changed = chunks.withColumn("text", F.when(F.col("chunk_id") == chunks.first()["chunk_id"], "other").otherwise(F.col("text")))
    assert not stored.is_current(changed)
    plan = stored.for_terms(q.select(F.explode(F.split("question", " ")).alias("term")).where("term in ('t1', 't5')"))
    assert "PartitionFilters: [isnotnull(bucket" in plan._jdf.queryExecution().toString() or "bucket#" in plan._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    want = {}
    for name, text in queries.items():
        best = sorted(_bm25(corpus, text).items(), key=lambda x: (-round(x[1], 9), x[0]))[:20]
        want.update({(name, c): (round(s, 9), i + 1) for i, (c, s) in enumerate(best)})
    for index in (full, stored, prune_index(chunks, q)):
        got = {(r["query_id"], r["chunk_id"]): (r["score"], r["rank"]) for r in keyword_topk(index, q).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], abs_tol=2e-9) for k in want)
    got = {(r["query_id"], r["chunk_id"]): (r["score"], r["rank"]) for r in keyword_search(q, chunks).collect()}
    assert got.keys() == want.keys()
    assert all(got[x][1] == want[x][1] and math.isclose(got[x][0], want[x][0], abs_tol=2e-9) for x in want)
    assert keyword_search(q.where("query_id > 'q2'"), chunks).count() == 0
    assert keyword_search(q, chunks.where("false")).count() == 0
    # Tiny work bounds: the same rows from many small blocks.
    monkeypatch.setattr(keyword_scan, "_HITS", 7)
    monkeypatch.setattr(keyword_scan, "_CELLS", 5)
    assert {(r["query_id"], r["chunk_id"]): r["rank"] for r in keyword_search(q, chunks).collect()} == {
        x: y[1] for x, y in want.items()}
    # Query side too large to broadcast: the salted join gives the same rows.
    monkeypatch.setattr(keyword, "join_small", lambda *a, **o: sizing.join_small(*a, **{**o, "max_rows": 0}))
    got = {(r["query_id"], r["chunk_id"]): r["rank"] for r in keyword_topk(prune_index(chunks, q), q).collect()}
    assert got == {k: v[1] for k, v in want.items()}


def test_dense_search_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    v[100:250] = v[100]            # half of the vectors are copies
    v[7] = 0                       # no direction
    q = np.vstack([rng.normal(size=(5, 8)), v[100:101]])
    vectors = spark.createDataFrame([(f"v{i:03d}", x.tolist(), i % 3) for i, x in enumerate(v)],
                                    "chunk_id string, embedding array<float>, kind int").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", x.tolist(), i % 3 if i % 3 < 2 else None) for i, x in enumerate(q)],
                                    "query_id string, embedding array<double>, filter_no int")
    v32 = v.astype(np.float32).astype(float)
    with np.errstate(invalid="ignore"):
        cos = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (v32 / np.linalg.norm(v32, axis=1)[:, None]).T, 9)

    def want(allowed):
        out = {}
        for i in range(len(q)):
            ids = [j for j in range(300) if j != 7 and allowed(i, j)]
            for rank, j in enumerate(sorted(ids, key=lambda j: (-cos[i, j], j))[:20], 1):
                out[(f"q{i}", rank)] = f"v{j:03d}"
        return out

    def run(**options):
        return {(r["query_id"], r["rank"]): r["chunk_id"] for r in dense_topk(queries, vectors, 20, **options).collect()}

    per_query = [F.col("kind") == 0, F.col("kind") > 0]
    tests = [(want(lambda i, j: True), {}), (want(lambda i, j: j % 3 == 1), {"condition": F.col("kind") == 1}),
             (want(lambda i, j: i % 3 == 2 or (j % 3 == 0) == (i % 3 == 0)), {"conditions": per_query})]
    for expected, options in tests:
        assert run(**options) == expected
        assert run(**options, max_query_floats=16) == expected


def test_filters_split_into_parts_give_the_same_rows(spark, corpus, monkeypatch):
    c = spark.createDataFrame([(k, t, [f"s{i % 4}"], 2000 + i % 20 if i % 5 else None) for i, (k, t) in enumerate(corpus.items())],
                              "chunk_id string, text string, cancer_type array<string>, year int").withColumns(
        {n: F.lit("x") for n in ("section", "study_design", "chunk_type")}).withColumn("evidence_level", F.lit(1))
    q = spark.createDataFrame([(f"q{i}", f"t{i} t{i + 1} t7", [f"s{i % 4}"] if i % 3 else None, 2005 + i % 3 if i % 2 else None) for i in range(12)],
                              "query_id string, question string, f_cancer_type array<string>, f_year_min int")
    pick = ["query_id", "chunk_id", "score", "rank"]
    whole = sorted(keyword_search(q, c).select(pick).collect())
    monkeypatch.setattr(retrieval, "MAX_FILTERS", 2)
    assert sorted(keyword_search(q, c).select(pick).collect()) == whole
    want = set()
    years = {r["chunk_id"]: (r["cancer_type"], r["year"]) for r in c.collect()}
    for r in q.collect():
        ok = [(x, s) for x, s in _bm25(corpus, r["question"]).items()
              if (not r["f_cancer_type"] or years[x][0] == r["f_cancer_type"])
              and (r["f_year_min"] is None or years[x][1] is None or years[x][1] >= r["f_year_min"])]
        want |= {(r["query_id"], x) for x, _ in sorted(ok, key=lambda p: (-round(p[1], 9), p[0]))[:20]}
    assert {(r[0], r[1]) for r in whole} == want


def _ranked(spark, rows, schema="query_id string, chunk_id string, rank int, score double"):
    return spark.createDataFrame(rows, schema)


def test_rrf(spark):
    dense = _ranked(spark, [("q", "a", 1, .9), ("q", "b", 2, .8), ("r", "x", 1, .5)])
    kw = _ranked(spark, [("q", "b", 1, 9.), ("q", "c", 2, 8.), ("q", "d", 3, 7.)])
    got = {(r["query_id"], r["chunk_id"]): (r["score"], r["rank"]) for r in fusion.fuse(dense, kw).collect()}
    assert got[("q", "b")] == (pytest.approx(1 / 62 + 1 / 61), 1)
    assert got[("q", "a")] == (pytest.approx(1 / 61 + 1 / 64), 2)
    assert got[("q", "c")][0] == pytest.approx(1 / 64 + 1 / 62)
    assert got[("r", "x")][0] == pytest.approx(1 / 61 + 1 / 62)


def test_diversity_cap_keeps_rank_order_without_refill(spark):
    rng = random.Random(1)
    rows = [(f"q{g}", f"c{i}", i, rng.choice(["review", "rct", None])) for g in range(20) for i in range(1, rng.randint(2, 15))]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, study_design string")
    want, seen = set(), Counter()
    for q, c, r, d in rows:
        seen[q] += d == "review"
        if d != "review" or seen[q] <= 3:
            want.add((q, c))
    assert {(r["query_id"], r["chunk_id"]) for r in fusion.cap_designs(df).collect()} == want


def test_rerank_order_and_passthrough(spark):
    rows = [("q", "a", 1, .03, .5, "review", 2000), ("q", "b", 2, .02, .9, "rct", 2025), ("q", "c", 3, .01, None, "rct", 0),
            ("p", "x", 1, .03, None, "rct", 2025), ("p", "y", 2, .02, None, "rct", 2025)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, score double, relevance_score double, study_design string, year int")
    got = {(r["query_id"], r["rank"]): r for r in fusion.rerank(df, 2026, 5).collect()}
    assert [got[("q", i)]["chunk_id"] for i in (1, 2)] == ["b", "a"] and ("q", 3) not in got
    assert got[("q", 1)]["final_score"] == pytest.approx(.9 ** .7 * .9 ** .15 * 1.1 ** .15)
    assert [got[("p", i)]["chunk_id"] for i in (1, 2)] == ["x", "y"] and got[("p", 1)]["relevance_score"] == .03


def test_grading_and_fallback(spark):
    queries = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    ranked = spark.createDataFrame([("q", "a", 1, .45), ("q", "b", 2, .44), ("r", "c", 1, .1)],
                                   "query_id string, chunk_id string, rank int, relevance_score double")
    ext = spark.createDataFrame([("r", "e1", 1, .45), ("r", "e2", 9, .45), ("q", "e3", 1, .45)], ranked.schema)
    graded = fusion.graded_and_renumbered(ranked)
    full = fusion.with_fallback(queries, graded, ext)
    assert {(r["query_id"], r["chunk_id"], r["used_fallback"]) for r in full.collect()} == {("q", "a", False), ("r", "e1", True)}
    s = {r["query_id"]: r for r in fusion.retrieval_summary(queries, ranked, full).collect()}
    assert (s["q"]["retrieval_confidence"], s["r"]["used_fallback"], s["s"]["retrieval_confidence"]) == (.45, True, 0.0)


def test_confidence_cases(spark):
    def run(chunks, topics=None):
        q = spark.createDataFrame([("q", topics)], "query_id string, query_topics array<string>")
        rows = [("q", i, s, lv, pm, ct) for i, (s, lv, pm, ct) in enumerate(chunks, 1)]
        df = spark.createDataFrame(rows, "query_id string, rank int, relevance_score double, evidence_level int, pmcid string, cancer_type array<string>")
        return answer_confidence(q, df).first()

    r = run([(.9, 2, "a", ["x"]), (.8, 3, "b", ["x"])])
    assert (r["score"], r["reason"], r["gate"]) == (pytest.approx(.95), "evidence_boost", "high")
    r = run([(.5, None, "a", None), (.5, 5, "a", None)])
    assert (r["score"], r["reason"], r["gate"]) == (pytest.approx(.3), "evidence_penalty; single_paper_penalty", "caveated")
    r = run([(1.0, 3, "a", ["x"]), (.1, 3, None, ["y"])], ["z"])
    assert r["reason"] == "single_paper_penalty; spread_penalty; topic_mismatch_penalty"
    r = run([])
    assert (r["score"], r["reason"], r["evidence_quality"], r["sufficient"]) == (0.0, "no_chunks", "insufficient", False)


def test_keyword_plans_agree_on_missing_texts(spark):
    """A missing text is an empty one in both plans."""
    from litspark.operators.keyword import build_keyword_index, keyword_topk
    from litspark.operators.keyword_scan import scan_topk

    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(
        ["kidney stone", None, "kidney", "", None, "bladder kidney", "liver", None, "liver", "stone stone"])], "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "kidney stone"), ("q2", "liver liver"), ("q3", None), ("q4", "")], "query_id string, question string")
    scan = sorted(map(tuple, scan_topk(asked, chunks, 5).select("query_id", "chunk_id", "score").collect()))
    stored = sorted(map(tuple, keyword_topk(build_keyword_index(chunks), asked, 5).select("query_id", "chunk_id", "score").collect()))
    assert scan == stored and len(scan) > 4


def test_quantiles_have_no_cartesian_product(spark):
    from litspark.operators.quantiles import positional_quantiles

    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id as double) as v")
    for by in (None, ["g"]):
        out = positional_quantiles(df, "v", {"p50": 0.5, "p95": 0.95}, by)
        assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == (3 if by else 1)


def test_fallback_draws_on_every_document(spark):
    """More documents than questions: the fallback takes several a question, not only the one with its id."""
    from litspark.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    got = [r["n"] for r in QUERIES["fallback_union_all"](spark, sf_dir).where("used_fallback").collect()]
    assert spark.read.parquet(f"{sf_dir}/documents.parquet").count() > spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    assert max(got) > 1 and max(got) <= 5


def test_keyword_index_holds_no_pairs(spark, tmp_path):
    """Counting takes no aggregation over the texts and scoring none over pairs of questions and chunks; copies of an id are one chunk."""
    rows = [(f"c{i:02}" if i % 11 else None, f"w{i % 7} w{i % 5} w{i % 3} x{i}") for i in range(60)]
    rows += [("c05", "w1 w1 w2 y"), ("c05", "w1 long"), ("c06", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    asked = spark.createDataFrame([("a", "w1 w4 w1 y"), ("b", "x3 x5 long"), ("c", "nothing")], "query_id string, question string")
    index = build_keyword_index(chunks)
    want = {}
    for i, t in rows:
        words = (t or "").split()
        for w in words:
            want[i, len(words), w] = want.get((i, len(words), w), 0) + 1
    assert {(r["chunk_id"], r["dl"], r["term"]): r["tf"] for r in index.postings.collect()} == want
    assert index.postings.count() == len(want)
    old = keyword.streamed_scores
    streamed = sorted(map(tuple, keyword_topk(index, asked, 4).collect()), key=str)
    try:
        keyword.streamed_scores = lambda postings, wanted, avgdl, carry: keyword.join_small(postings, wanted, ["term"]).groupBy(
            "query_id", "chunk_id").agg(F.sum(F.col("qtf") * F.col("idf") * keyword.term_weight(F.col("tf"), F.col("dl"), avgdl)).alias("score"))
        assert sorted(map(tuple, keyword_topk(index, asked, 4).collect()), key=str) == streamed
    finally:
        keyword.streamed_scores = old
    once = spark.createDataFrame([r for r in rows[:20] if r[0]], "chunk_id string, text string").repartition(3)
    plan = build_keyword_index(once).postings._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan.replace("Exchange RoundRobinPartitioning", "")
    plan = keyword.keyword_scores(build_keyword_index(once).write(str(tmp_path / "i")), asked)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
