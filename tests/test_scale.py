"""Work that must not move or hold whole tables: same rows as the plain forms, and what the plans and tasks hold."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.operators import corpus, safety, scorers, topk
from litspark.sources import runs
from litspark.streaming import admission, jobs

SECTIONS = "array<struct<name:string,raw_name:string,content:string,section_type:string>>"
PAPER = f"paper_key string, pmid string, title string, abstract string, topic string, sections {SECTIONS}"


def _paper(key, topic, n=2):
    sections = [(name, name, "word " * 350, "text") for name in ("results", "methods", "discussion")[:n]]
    return (key, f"9{key}", f"T{key}", "a " * 60, topic, sections)


def test_new_papers_equal_the_plain_form(spark, monkeypatch):
    rng = random.Random(5)
    topics = [*K.TOPICS[:3], "zz", None]
    rows = [(rng.choice([*map(str, range(40)), None]), rng.choice(topics)) for _ in range(90)]
    papers = spark.createDataFrame(rows, "paper_key string, topic string")
    for known in ([], [("3",), ("7",), (None,)], [(str(i),) for i in range(40)]):
        state = spark.createDataFrame(known, "paper_key string")
        want = corpus.skip_known(corpus.first_topic_wins(papers), state)
        for fits in (True, False):
            monkeypatch.setattr(corpus, "fits_bytes", lambda df, fits=fits: fits)
            got = corpus.new_papers(papers, state)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_papers_known_to_have_no_metadata_are_not_joined(spark):
    papers = spark.createDataFrame([_paper("1", "kidney")], PAPER)
    out = corpus.attach_metadata(papers, corpus.no_metadata(spark))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first()["study_design"] == "unknown"


def test_embedding_is_an_arrow_pass(spark):
    rows = spark.range(0, 2500, 1, 2).selectExpr("id", "repeat('x', CAST(id % 7 AS INT)) AS embed_text", "array(id) AS other")
    out = scorers.embed(rows, lambda texts: [None if len(t) == 3 else [float(len(t)), len(texts)] for t in texts])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    got = out.collect()
    assert len(got) == 2500 and all((r["embedding"] is None) == (r["id"] % 7 == 3) and r["other"] == [r["id"]] for r in got)
    assert max(r["embedding"][1] for r in got if r["embedding"]) == 100


def test_complete_papers_are_told_across_parts(spark, monkeypatch):
    rng = random.Random(3)
    keys = [k for k in ("a", "b", None, "c", "d", "e") for _ in range(rng.randrange(1, 9))]
    rows = [(k, i, "bad" if k in ("b", None, "e") and i == len(keys) - 1 - keys[::-1].index(k) else "ok", (i,)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "paper_key string, i int, embed_text string, _paper struct<x:int>").coalesce(1)
    monkeypatch.setattr(scorers, "_ROWS", 3)
    got = scorers.embed_papers(df, lambda texts: [None if t == "bad" else [1.0] for t in texts], batch=3).orderBy("i").collect()
    assert [r["paper_key"] for r in got] == keys
    assert all(r["complete"] == (r["paper_key"] not in ("b", "e")) for r in got)
    assert all((r["_paper"] is None) == r["complete"] for r in got)


def test_failed_papers_stay_whole(spark, tmp_path):
    papers = spark.createDataFrame([_paper(str(i), K.TOPICS[0], 3) for i in range(6)], PAPER)
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    papers.write.parquet(land)
    src = spark.readStream.schema(papers.schema).parquet(land)

    def ailing(texts):
        return [None if t.startswith(("T1 | results", "T4 | results")) else [1.0] for t in texts]

    jobs.ingest_stream(src, out, str(tmp_path / "m"), ailing).trigger(availableNow=True).start().awaitTermination()
    failed = runs.read(spark, out, "failed").select("paper_key", "sections")
    assert {r["paper_key"] for r in failed.collect()} == {"1", "4"}
    assert failed.exceptAll(papers.select("paper_key", "sections")).isEmpty()
    kept = {r[0] for r in runs.read(spark, out, "state").select("paper_key").collect()}
    assert kept == {str(i) for i in range(6)} - {r[0] for r in failed.collect()}
    assert "embed_text" in runs.read(spark, out, "chunks").columns


def test_a_call_settles_all_papers_of_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(admission, "BUCKETS", 1)
    rows = [_paper(str(i % 12), K.TOPICS[i % 3], 3) for i in range(24)] + [_paper(None, K.TOPICS[1], 3)]
    papers = spark.createDataFrame(rows, PAPER)
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = {(r["paper_key"], r["topic"]) for r in corpus.first_topic_wins(papers).collect()}
    for _ in range(2):
        papers.write.mode("append").parquet(land)
        with admission.rocksdb_state(spark):
            src = spark.readStream.schema(papers.schema).parquet(land)
            admission.ingest_stateful(src, out, str(tmp_path / "m"), lambda t: [[1.0]] * len(t)).trigger(availableNow=True).start().awaitTermination()
        state = runs.read(spark, out, "state").collect()
        assert len(state) == 13 and {(r["paper_key"], r["topic"]) for r in state} == want


def test_gram_join_equals_matching_in_place(spark):
    rng = random.Random(9)
    signs = ["a", "b", "É", " ", "\n", "🙂", "$", "ab"]
    word = lambda n: "".join(rng.choice(signs) for _ in range(rng.randrange(0, n)))
    entries = spark.createDataFrame([(i, word(7), [word(5), word(3)], [word(2)] if i % 2 else [], "FDA", "w", None) for i in range(30)],
                                    "ord long, drug string, aliases array<string>, indication_keywords array<string>, jurisdiction string, "
                                    "warning string, warning_fr string")
    entries = safety.withdrawal_entries(entries)
    df = spark.createDataFrame([(i % 50, None if i % 17 == 0 else word(25), word(9)) for i in range(120)], "id long, a string, b string")
    want, got = (safety.match_entries(df, F.col("a"), F.col("b"), entries, literal_rows=n) for n in (2000, 0))
    assert "regexp_extract_all" in got._jdf.queryExecution().optimizedPlan().toString()
    shown = [sorted(repr((r["id"], r["a"], r["b"], sorted({m["ord"] for m in r["matches"]}))) for r in df_.collect()) for df_ in (want, got)]
    assert shown[0] == shown[1]


def test_long_batches_are_cut_into_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000))], names=["x"])
    parts = list(topk.in_parts(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= 2048 and sum(p.num_rows for p in parts) == 5000
