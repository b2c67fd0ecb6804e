import json

import pytest
from pyspark.sql import functions as F

from litspark.operators import evaluate, scorers
from litspark.operators.keyword import build_keyword_index
from litspark.plans import corpus as build_plan
from litspark.plans.cards import finish_cards
from litspark.plans.evaluation import evaluate as run_evaluation
from litspark.plans.migrate import migrate_eav, run_migration
from litspark.plans.regulatory import merge_withdrawals
from litspark.plans.report import corpus_report, write_corpus_report
from litspark.plans.retrieval import META, retrieve
from litspark.queries import views as V
from litspark.session import store
from litspark.sources import records, runs

SF = "/root/testdata/sf0.001"
STATE = "paper_key string, topic string, committed_at timestamp"


def _embed(texts):
    return [[float(len(t)), float(t.count("a") + 1), float(t.count(" "))] for t in texts]


def _papers(spark):
    return V.papers(spark, SF).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")


def test_corpus_build_commits_after_the_data(spark, tmp_path):
    papers = _papers(spark)
    twice = papers.unionByName(papers.withColumn("topic", F.lit("adrenal")))
    none = spark.createDataFrame([], STATE)
    build = build_plan.build_corpus(twice, none)
    path = str(tmp_path / "c")
    summary = {r["topic"]: r for r in build_plan.ingest(build, _embed, path).collect()}
    chunks, state = runs.read(spark, path, "chunks"), runs.read(spark, path, "state")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 0
    assert state.count() == summary[None]["papers_fetched"]
    assert summary[None]["papers_skipped"] == twice.count() - papers.count()
    assert summary[None]["chunks_embedded"] == chunks.count()
    assert state.join(papers, ["paper_key", "topic"], "left_anti").count() == 0
    again = build_plan.build_corpus(twice, state)
    left = again.new.count()
    assert left == runs.read(spark, path, "rejected").count() == papers.count() - state.count()
    assert again.chunks.count() == 0
    assert {r["would_fetch"] for r in again.would_fetch().collect()} and again.rejected.count() == left


def test_a_break_at_any_write_leaves_nothing_and_the_rerun_doubles_nothing(spark, tmp_path, monkeypatch):
    papers, real = store(_papers(spark).limit(12), "papers"), runs.put
    path = str(tmp_path / "c")
    tables = ["accepted", "staged", "chunks", "rejected", "state", "summary", "commits"]
    for at in tables:
        def broken(df, where, name, run_id, batch_id, at=at):
            if name == at:
                raise RuntimeError(at)
            return real(df, where, name, run_id, batch_id)

        monkeypatch.setattr(runs, "put", broken)
        with pytest.raises(RuntimeError, match=at):
            build_plan.ingest(build_plan.build_corpus(papers, runs.read(spark, path, "state", "paper_key string, topic string")), _embed, path)
        monkeypatch.setattr(runs, "put", real)
        assert runs.read(spark, path, "state", "paper_key string, topic string").count() == 0
    for _ in range(2):
        build_plan.ingest(build_plan.build_corpus(papers, runs.read(spark, path, "state", "paper_key string, topic string")), _embed, path)
        chunks = runs.read(spark, path, "chunks")
        assert chunks.count() == chunks.select("chunk_id").distinct().count() > 0
    rejected = runs.read(spark, path, "rejected")
    assert rejected.where("batch_id = 0").groupBy("run_id").count().count() <= 2


def test_failed_batches_stay_uncommitted(spark, tmp_path):
    def flaky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("model down")
        return _embed(texts)

    words = " ".join(["w"] * 320)
    rows = [(f"p{i}", f"9{i}", "T", "kidney", "a " * 60, [("results", "R", words, "text"), ("methods", "M", ("bad " if i == 1 else "") + words, "text")])
            for i in range(3)]
    papers = spark.createDataFrame(rows, "paper_key string, pmid string, title string, topic string, abstract string, "
                                         "sections array<struct<name:string,raw_name:string,content:string,section_type:string>>")
    build = build_plan.build_corpus(papers, spark.createDataFrame([], STATE))
    one_by_one = scorers.embed(build.chunks, flaky, batch=1)
    assert scorers.embed_summary(one_by_one).first()["failed"] == 1
    saved = build_plan.embed
    build_plan.embed = lambda rows, fn: saved(rows, fn, batch=1)
    try:
        build_plan.ingest(build, flaky, str(tmp_path / "c"))
    finally:
        build_plan.embed = saved
    assert {r["paper_key"] for r in runs.read(spark, str(tmp_path / "c"), "state").collect()} == {"p0", "p2"}
    assert {r["paper_key"] for r in runs.read(spark, str(tmp_path / "c"), "chunks").collect()} == {"p0", "p2"}


def test_retrieval_options(spark):
    q, c, v = V.questions(spark, SF).drop("f_cancer_type", "f_year_min", "f_evidence_level_max"), V.chunk_table(spark, SF), V.vectors(spark, SF)
    index = build_keyword_index(c, META)
    lazy = retrieve(q, c, v, index, 2026, materialise=False)
    stored = retrieve(q, c, v, index, 2026)
    pick = ["query_id", "rank", "chunk_id"]
    assert sorted(lazy.ranked.select(pick).collect()) == sorted(stored.ranked.select(pick).collect())
    # Fused scores never reach the grade, so passthrough grades everything out.
    assert retrieve(q, c, v, index, 2026, passthrough=True).ranked.count() == 0
    assert retrieve(q, c, v, index, 2026, passthrough=True, floor=0.0).ranked.count() > 0
    scored = retrieve(q, c, v, index, 2026, scorer=lambda pairs: [min(len(t) / 2000, 1.0) for _, t in pairs], floor=0.0)
    tops = scored.ranked.where("rank = 1").join(scored.fused, ["query_id"]).count()
    assert tops > 0
    unique = scorers.embed_queries(q.select("query_id", "question"), lambda ts: [[1.0]] * len(ts))
    assert unique.where("embedding is null").count() == 0 and unique.count() == q.count()


def test_evaluation_with_and_without_answers(spark):
    golden = V.answered(spark, SF).select(F.col("query_id").alias("id"), F.col("question").alias("query"), "cancer_type",
                                          "difficulty", "question_type", "ground_truth", "must_contain_terms")
    ev = V.evidence(spark, SF)
    base = evaluate.mean_metrics(run_evaluation(golden, ev).results)
    same = run_evaluation(golden, ev, baseline=base)
    assert same.regression.first()["passed"]
    better = base.withColumn("faithfulness", F.col("faithfulness") + 0.05)
    assert not run_evaluation(golden, ev, baseline=better).regression.first()["passed"]
    assert run_evaluation(golden, ev, baseline=base.where("false")).regression.first()["passed"]
    answers = V.answered(spark, SF).select("query_id", "answer", F.lit(5.0).alias("latency_ms"))
    full = run_evaluation(golden, ev, answers)
    assert full.latency.first()["p95"] == 5.0 and full.grouped.where("facet = 'all'").first()["n"] == golden.count()
    judged = scorers.judge_with(full.results.select("query_id", "question", "answer"), lambda rows: [(.1, .2, .3, .4, .5)] * len(rows))
    assert judged.first()["judge_context_recall"] == .4
    broken = scorers.judge_with(full.results.select("query_id", "question", "answer"), lambda rows: 1 / 0)
    assert broken.where("judge_faithfulness is not null").count() == 0


def test_report_and_evaluation_sinks(spark, tmp_path):
    papers = V.legacy_papers(spark, SF)
    parts = corpus_report(papers)
    assert parts["summary"].first()["total_papers"] == papers.count()
    write_corpus_report(papers, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/grades")).count() == 6
    res = V.answered(spark, SF).select("query_id", F.repeat("answer", 20).alias("answer"))
    for run in ("r1", "r2"):
        records.write_report(res, res.agg(F.count("*").alias("n")), str(tmp_path / "e"), run, 500)
    assert spark.read.json(str(tmp_path / "e/r1/detailed")).agg(F.max(F.length("answer"))).first()[0] == 500
    assert spark.read.json(str(tmp_path / "e/latest")).first()["run_id"] == "r2"


def test_migration(spark, tmp_path):
    emb = spark.createDataFrame([(1, "e1"), (2, "e2")], "id long, embedding_id string")
    meta = spark.createDataFrame([
        (1, "pmc_id", "P", None, None), (1, "year", "", 2020, None), (1, "chroma:document", "x" * 3000, None, None), (1, "title", "T", None, None),
        (1, "topic", "kidney", None, None), (2, "year", "n.d.", None, None), (2, "chunk_index", None, None, 3.0)],
        "id long, key string, string_value string, int_value long, float_value double")
    rows = {r["chunk_id"]: r for r in migrate_eav(emb, meta, 2000).collect()}
    assert (len(rows["e1"]["text"]), rows["e1"]["year"], rows["e1"]["cancer_type"]) == (2000, 2020, ["kidney"])
    assert len(rows["e1"]["embed_text"]) == len("T | \n") + 3000
    assert max(len(r["text"]) for r in migrate_eav(emb, meta).collect()) == 3000
    assert (rows["e2"]["year"], rows["e2"]["cancer_type"], rows["e2"]["evidence_level"]) == (None, [], 6)
    out = run_migration(emb, meta, _embed, str(tmp_path / "m")).first()
    assert (out["source_count"], out["migrated"], out["failed"]) == (2, 2, 0)


def test_regulatory_refresh(spark):
    old = spark.createDataFrame([(0, "atezo", "FDA", "keep", "manual")], "seq long, drug string, jurisdiction string, warning string, source string")
    enf = spark.createDataFrame([
        (1, "Atezo", "bladder cancer vial", "Defect.", "Voluntary: Firm", "Terminated", "20210305"),
        (2, "Nivo", "tumor vial", None, "voluntary", "Ongoing", "2022"), (3, "Saline", "bag", "Defect", "voluntary", "Ongoing", "2022")],
        "seq long, drug string, product_description string, reason_for_recall string, voluntary_mandated string, status string, recall_initiation_date string")
    merged, counts = merge_withdrawals(old, enf)
    got = {r["drug"]: r for r in merged.collect()}
    assert got["atezo"]["warning"] == "keep" and set(got) == {"atezo", "nivo"}
    assert got["nivo"]["warning"] == ("Nivo — FDA voluntary action (2022): No reason provided. "
                                      "Verify current regulatory status before recommending.")
    assert tuple(counts.first()) == (1, 0, 1)


def test_cards_without_chunks_disclose(spark):
    cards = spark.createDataFrame(
        [("p", "kidney", "h", "M1 [Doc 1]", None, None, None, None, [("Axi [Doc 1]", None, None)], [("axi", "Palliative")], ["s [Doc 1]"])],
        "patient_id string, cancer_type string, clinical_history string, stage string, guideline string, comorbidities_impact string, confidence string, "
        "treatment_confidence string, treatment array<struct<drug:string,intent:string,level:string>>, intent_map array<struct<key:string,intent:string>>, sources array<string>")
    none = spark.createDataFrame([], "patient_id string, rank int, chunk_id string, text string, title string, authors array<string>, journal string, "
                                     "year int, study_design string, sample_size int, section string, pmid string")
    w = spark.createDataFrame([], "ord long, drug string, aliases array<string>, indication_keywords array<string>, jurisdiction string, warning string, warning_fr string")
    b = spark.createDataFrame([], "ord long, drug string, drug_patterns array<string>, biomarker_keywords array<string>, indication_keywords array<string>, warning string, warning_fr string")
    c = finish_cards(cards, none, w, b, "en", keep_citations=True, disclose_fallback=True).first()
    t = c["treatment"][0]
    assert (t["drug"], t["intent"], t["level"], c["stage"], c["confidence"], c["grounded"]) == ("Axi", "Palliative", "B", "M1", "Moderate", False)
    assert c["sources"][0].startswith("⚠ No relevant literature") and c["sources_detail"][0]["study_design"] == "parametric_knowledge"
    row = records.card_audit_rows(finish_cards(cards, none, w, b, "en").withColumns({
        "query_id": F.lit("x"), "grounded": F.lit(None).cast("boolean"), "confidence_score": F.lit(.5)})).first()
    assert row["flagged"] and json.loads(row["answer"])["retrieval_metadata"]["chunks_used"] == 0


def test_extractor_seam(spark):
    papers = spark.createDataFrame([("1", "good"), ("2", ""), ("3", "fail")], "pmid string, abstract string")

    def model(texts):
        if "fail" in texts:
            raise ValueError
        return ['{"study_design": "cohort"}'] * len(texts)

    from litspark.operators.corpus import normalise_extractions

    got = {r["pmid"]: r for r in normalise_extractions(papers, scorers.extract_responses(papers, model, batch=1), "m").collect()}
    assert (got["1"]["study_design"], got["2"]["extraction_failed"], got["3"]["extraction_failed"]) == ("cohort", True, True)
