import random

import pytest
from pyspark.sql import functions as F

from litspark import constants as K
from litspark import sizing
from litspark.operators import context, corpus, evaluate, merge, quality, safety
from litspark.operators.quantiles import positional_quantiles


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_positional_quantiles(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [("a", float(rng.randint(0, 9))) for _ in range(3000)] + [("b", 7.0)] * 1000 + [("b", rng.random()) for _ in range(500)]
    rows += [("c", 1.5), ("d", 1.0), ("d", 2.0), ("d", 3.0), ("d", 4.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"p50": .5, "p95": .95, "p99": .99}
    got = {r["g"]: r for r in positional_quantiles(df, "v", qs, ["g"], accuracy).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        vs.sort()
        for name, q in qs.items():
            assert got[g][name] == vs[min(int(len(vs) * q), len(vs) - 1)], (g, name)
    every = sorted(v for vs in groups.values() for v in vs)
    assert positional_quantiles(df, "v", {"m": .5}, accuracy=accuracy).first()["m"] == every[len(every) // 2]
    empty = evaluate.latency_stats(df.where("g = 'none'"), "v").first()
    assert (empty["p50"], empty["mean"], empty["n"]) == (0.0, 0.0, 0)


def test_context_budget_matches_a_loop(spark):
    rng = random.Random(5)
    rows = [(f"q{g}", i, "x" * rng.choice([1, 50, 300, 900, 1200])) for g in range(60) for i in range(1, rng.randint(2, 9))]
    df = spark.createDataFrame(rows, "query_id string, rank int, block string")
    want = {}
    for q in {r[0] for r in rows}:
        parts, total = [], 0
        for _, _, b in sorted(r for r in rows if r[0] == q):
            if total + len(b) + 2 > 2000:
                room = 2000 - total - 2
                if room > 100:
                    parts.append(b[:room] + "…")
                break
            parts.append(b)
            total += len(b) + 2
        if parts:
            want[q] = "\n\n".join(parts)
    assert {r["query_id"]: r["context"] for r in context.fit_budget(df, 2000).collect()} == want


def test_protected_merge_matches_a_fold(spark):
    rng = random.Random(9)

    def entry(i):
        return (i, rng.choice(["A", "a", "b", " b "]), rng.choice(["fda", "FDA ", "ema"]), rng.choice(["w", "w", " "]),
                rng.choice(["manual", "feed", "feed", None]))

    schema = "seq int, drug string, jurisdiction string, warning string, source string"
    for _ in range(12):
        old, new = [entry(i) for i in range(rng.randint(0, 6))], [entry(i) for i in range(100, 100 + rng.randint(0, 12))]
        merged, counts = {}, [0, 0, 0]
        for e in old:
            merged[(e[1].lower(), e[2].upper())] = e
        for e in new:
            key = (e[1].strip().lower(), e[2].strip().upper())
            if not key[0] or not e[3].strip():
                continue
            if key in merged and merged[key][4] == "manual":
                counts[0] += 1
                continue
            counts[1 if key in merged else 2] += 1
            merged[key] = e
        o, n = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
        assert sorted(map(tuple, merge.merge_protected(o, n).select("seq").collect())) == sorted((e[0],) for e in merged.values())
        assert list(merge.merge_counts(o, n).select("protected", "updated", "added").first()) == counts


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([("k1", "x", 1, "a"), ("k2", "y", 5, "b")], "k string, v string, ver int, topic string")
    new = spark.createDataFrame([("k1", "z", 1, "a"), ("k2", "old", 4, "b"), ("k3", "n", 1, "a")], old.schema)
    got = {r["k"]: r["v"] for r in merge.upsert_latest(old, new, ["k"], "ver").collect()}
    assert got == {"k1": "z", "k2": "y", "k3": "n"}
    path = str(tmp_path / "t")
    old.write.partitionBy("topic").parquet(path)
    before = {f.name for f in (tmp_path / "t" / "topic=b").iterdir()}
    merge.merge_into_partitions(spark.read.parquet(path), new.where("topic = 'a'"), path, ["k"], "ver", "topic")
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()} == {"k1": "z", "k2": "y", "k3": "n"}
    assert {f.name for f in (tmp_path / "t" / "topic=b").iterdir()} == before
    kept = merge.update_columns(old, new.withColumn("ver", F.lit(9)), "k", ["v"])
    assert {r["k"]: (r["v"], r["ver"]) for r in kept.collect()} == {"k1": ("z", 1), "k2": ("old", 5), "k3": ("n", 9)}
    assert {r["k"]: r["v"] for r in merge.insert_absent(old, new, "k").collect()} == {"k1": "x", "k2": "y", "k3": "n"}


def test_topic_dedupe_and_caps(spark):
    df = spark.createDataFrame([("p1", "kidney", 1), ("p1", "prostate", 2), ("p2", "penile", 3), ("p2", "unknown", 4), ("p3", "kidney", 5)],
                               "paper_key string, topic string, position int")
    assert {tuple(r) for r in corpus.first_topic_wins(df).select("paper_key", "topic").collect()} == {
        ("p1", "prostate"), ("p2", "penile"), ("p3", "kidney")}
    assert corpus.cap_per_topic(df, 1).count() == 4
    pages = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 5), (2, 2, 7)], "window int, position int, id int")
    assert {r["pmc_id"] for r in corpus.harvest_ids(pages, 2).collect()} == {"PMC5", "PMC6"}


def test_quality_gate(spark):
    def paper(key, abstract, *sections):
        return (key, "kidney", abstract, [(n, n, " ".join(["w"] * k), "text") for n, k in sections])

    rows = [paper("full", " ".join(["a"] * 50), ("abstract", 50), ("methods", 200), ("results", 100)),
            paper("bare", "", ("other", 400)), paper("nofind", " ".join(["a"] * 60), ("methods", 300), ("introduction", 9)),
            paper("thin", "short", ("results", 10))]
    df = spark.createDataFrame(rows, "paper_key string, topic string, abstract string, sections array<struct<name:string,raw_name:string,content:string,section_type:string>>")
    got = {r["paper_key"]: r for r in quality.score_papers(df).collect()}
    assert (got["full"]["score"], got["full"]["passed"], got["full"]["reasons"]) == (1.0, True, [])
    assert (got["bare"]["score"], got["bare"]["passed"]) == (0.35, False)
    assert (got["nofind"]["score"], got["nofind"]["passed"]) == (0.7, False)
    assert got["thin"]["score"] == 0.45 and "Body content too short (10 words, min 300)" in got["thin"]["reasons"]


def _tables(spark):
    w = spark.createDataFrame(
        [(0, "Atezo", ["tecen"], ["bladder"], "EMA", "W0", ""), (1, "rx", [], [], "FDA", "", "F1"), (2, "zz", [""], [], "FDA", "", None)],
        "ord long, drug string, aliases array<string>, indication_keywords array<string>, jurisdiction string, warning string, warning_fr string")
    b = spark.createDataFrame([(0, "PARP", ["olap"], ["brca"], ["prostate"], "B0", None)],
                              "ord long, drug string, drug_patterns array<string>, biomarker_keywords array<string>, indication_keywords array<string>, warning string, warning_fr string")
    return w, b


def test_repeated_incoming_keys_apply_in_turn(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("a", 9, "p", 1), ("a", 5, "q", 2), ("c", 3, "r", 1), ("c", 2, "s", 2)], "k string, v int, w string, seq int")
    got = merge.update_columns(old, new, "k", ["v"], order="seq").collect()
    assert sorted(map(tuple, got)) == [("a", 5, "x"), ("b", 1, "y"), ("c", 2, "s")]


@pytest.mark.parametrize("literal_rows", [100, 0])
def test_safety_joins(spark, literal_rows):
    w, b = _tables(spark)
    a = spark.createDataFrame([("1", "TECEN for Bladder \n"), ("2", "atezo only"), ("3", "an RX, tecen, bladder"), ("4", "none"), ("5", "")],
                              "query_id string, answer string")
    got = {r["query_id"]: r["answer"] for r in safety.append_warnings(a, w, literal_rows=literal_rows).collect()}
    note = K.REGULATORY_NOTE
    assert got == {"1": f"TECEN for Bladder\n\n{note}W0", "2": "atezo only", "3": f"an RX, tecen, bladder\n\n{note}W0\n\n{note}F1",
                   "4": "none", "5": ""}
    cards = spark.createDataFrame(
        [("p1", "prostate", "history", [("Olaparib", "i", "A"), ("rx atezo", "i", "B")]), ("p2", "prostate", "BRCA1 found", [("olap", "i", "A")]),
         ("p3", "kidney", None, [])],
        "patient_id string, cancer_type string, clinical_history string, treatment array<struct<drug:string,intent:string,level:string>>")
    out = {r["patient_id"]: [(t["drug"], [(x["type"], x["drug"], x["message"]) for x in t["warnings"]]) for t in r["treatment"]]
           for r in safety.treatment_warnings(cards, w, b, "en", literal_rows=literal_rows).collect()}
    assert out == {"p1": [("Olaparib", [("biomarker", "PARP", "B0")]), ("rx atezo", [("regulatory", "rx", "F1")])],
                   "p2": [("olap", [])], "p3": []}


def test_safety_plans_agree_on_repeated_and_null_keys(spark):
    w, b = _tables(spark)
    a = spark.createDataFrame([("1", "TECEN for Bladder"), ("1", "none"), (None, "rx"), (None, "rx"), ("", None)], "query_id string, answer string")
    t = "patient_id string, cancer_type string, clinical_history string, treatment array<struct<drug:string,intent:string,level:string>>"
    cards = spark.createDataFrame([("p", "prostate", "h", [("olap", "i", "A")]), ("p", "prostate", "h", [("rx", "i", "A"), ("olap", "i", "B")]),
                                   (None, "prostate", None, [("olap", None, None)]), (None, None, None, None), ("", None, "x", [])], t)
    plans = [(sorted(map(str, safety.append_warnings(a, w, literal_rows=n).collect())),
              sorted(map(str, safety.treatment_warnings(cards, w, b, "en", literal_rows=n).collect()))) for n in (100, 0)]
    assert plans[0] == plans[1] and len(plans[0][0]) == len(plans[0][1]) == 5


def test_history_modes(spark):
    rows = [("c", i, f"m{i}", "user" if i % 2 else "assistant", f"t{i}") for i in range(1, 16)]
    df = spark.createDataFrame(rows, "conversation_id string, created_at int, id string, role string, content string")
    first = [r["content"] for r in context.history(df).orderBy("pos").collect()]
    last = [r["content"] for r in context.history(df, mode="last").orderBy("pos").collect()]
    assert first == [f"t{i}" for i in range(1, 11)] and last == [f"t{i}" for i in range(6, 16)]
    q = spark.createDataFrame([("q1", "c"), ("q2", None)], "query_id string, conversation_id string")
    got = {r["query_id"]: r["history"] for r in context.attach_history(q, df, limit=2).collect()}
    assert [m["content"] for m in got["q1"]] == ["t1", "t2"] and got["q2"] is None


def test_broadcasts_are_bounded_in_bytes(spark):
    """Few rows with long texts, lists, maps or structs are as large as they are; nulls take little."""
    cases = {"id": 8, "repeat('x', 1000)": 1016, "cast(null as string)": 16, "array_repeat(id, 100)": 816, "array_repeat('xyz', 100)": 16 + 1900,
             "array_repeat(struct(id, 'xy' as s), 10)": 16 + 10 * 42, "cast(null as array<struct<a:int>>)": 16, "map('ab', 1L)": 16 + 18 + 24,
             "struct(id, cast(null as array<int>) as a)": 16 + 8 + 16}
    for value, size in cases.items():
        df = spark.range(10).selectExpr(f"{value} as `a.b`")
        assert sizing.fits_bytes(df, 10, 10 * size) and not sizing.fits_bytes(df, 10, 10 * size - 1), value
        assert not sizing.fits_bytes(df, 9, 1 << 30)
    assert sizing.fits_bytes(spark.range(0), 0, 0)
    wide = spark.range(100).selectExpr("id", "repeat('x', 1000000) as t")
    plan = lambda small: sizing.join_small(spark.range(100), small, ["id"])._jdf.queryExecution().toString()
    assert "strategy=broadcast" not in plan(wide) and "strategy=broadcast" in plan(wide.limit(10))
