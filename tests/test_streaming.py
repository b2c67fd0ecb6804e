import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from litspark import constants as K
from litspark.operators import quality
from litspark.queries import tables as T
from litspark.queries import views as V
from litspark.sources import runs
from litspark.streaming import admission, jobs
from litspark.streaming.progress import ProgressTable

SF = "/root/testdata/sf0.001"


def _embed(texts):
    return [[float(len(t))] for t in texts]


def test_ingest_stream_is_idempotent(spark, tmp_path):
    p = V.papers(spark, SF).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    half = F.col("paper_key").cast("int") % 2
    p.where(half == 0).write.parquet(land)

    def run(mark):
        src = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 2).parquet(land)
        jobs.ingest_stream(src, out, str(tmp_path / mark), _embed).trigger(availableNow=True).start().awaitTermination()
        return runs.read(spark, out, "chunks"), runs.read(spark, out, "state")

    chunks, state = run("m")
    n, s = chunks.count(), state.count()
    assert n == chunks.select("chunk_id").distinct().count() > 0
    p.where(half == 1).write.mode("append").parquet(land)
    chunks, state = run("m")
    assert state.count() > s and chunks.count() > n
    total = chunks.count()
    assert chunks.select("chunk_id").distinct().count() == total
    assert chunks.join(state.select("paper_key"), "paper_key", "left_anti").count() == 0
    totals = {r["topic"]: r for r in jobs.progress_totals(runs.read(spark, out, "progress")).collect()}
    assert totals[None]["chunks_produced"] == total and totals[None]["papers_fetched"] == state.count()


def test_replayed_batch_replaces_itself(spark, tmp_path):
    """A crash after the data write and before the commit repeats the batch."""
    p = V.papers(spark, SF).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    p.coalesce(1).write.parquet(land)
    for mark in ("a", "b"):   # a fresh checkpoint replays batch 0
        src = spark.readStream.schema(p.schema).parquet(land)
        jobs.ingest_stream(src, out, str(tmp_path / mark), _embed).trigger(availableNow=True).start().awaitTermination()
    chunks = runs.read(spark, out, "chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 0


def test_a_second_source_keeps_the_first(spark, tmp_path):
    p = V.papers(spark, SF).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    out, seen = str(tmp_path / "out"), []
    for i in (0, 1, 0):
        land = str(tmp_path / f"in{i}")
        p.where(F.col("paper_key").cast("int") % 2 == i).write.mode("overwrite").parquet(land)
        src = spark.readStream.schema(p.schema).parquet(land)
        jobs.ingest_stream(src, out, str(tmp_path / f"m{len(seen)}"), _embed).trigger(availableNow=True).start().awaitTermination()
        seen.append({r[0] for r in runs.read(spark, out, "state").select("paper_key").collect()})
    assert seen[0] < seen[1] == seen[2]
    chunks = runs.read(spark, out, "chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 0


def test_state_in_the_stream(spark, tmp_path):
    """Two sources in one query, a restart, and a new checkpoint over the committed table: every paper once, as in the batch form."""
    p = V.papers(spark, SF).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    lands, out, plain = [str(tmp_path / n) for n in "ab"], str(tmp_path / "out"), str(tmp_path / "plain")
    key = F.pmod(F.col("paper_key").cast("bigint"), F.lit(4))
    topics = [p, p.withColumn("topic", F.lit("zz"))]
    for land, rows in zip(lands, topics):
        rows.where(key < 2).coalesce(1).write.parquet(land)

    def run(mark):
        a, b = (spark.readStream.schema(p.schema).parquet(x) for x in lands)
        with admission.rocksdb_state(spark):
            admission.ingest_stateful(a.unionByName(b), out, str(tmp_path / mark), _embed).trigger(availableNow=True).start().awaitTermination()
        state = runs.read(spark, out, "state")
        assert state.count() == state.select("paper_key").distinct().count()
        return {r[0] for r in state.select("paper_key").collect()}

    first = run("m")
    assert run("m") == first
    for land, rows in zip(lands, topics):
        rows.where(key < 3).write.mode("append").parquet(land)
    second = run("m")
    assert first < second
    p.write.mode("append").parquet(lands[1])
    third = run("other")
    assert second < third
    p.write.parquet(plain)
    src = spark.readStream.schema(p.schema).parquet(plain)
    jobs.ingest_stream(src, str(tmp_path / "want"), str(tmp_path / "w"), _embed).trigger(availableNow=True).start().awaitTermination()
    want, got = (runs.read(spark, path, "chunks") for path in (str(tmp_path / "want"), out))
    assert got.count() == got.select("chunk_id").distinct().count() == want.count()
    names = ["chunk_id", "paper_key", "text"]
    assert want.select(names).exceptAll(got.select(names)).isEmpty()


def test_admission_order_and_gate(spark, tmp_path):
    """Of one batch's copies the first topic's counts; a rejected paper leaves no state and may come again."""
    p = V.papers(spark, SF).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    scored = quality.passed(quality.score_papers(p)).orderBy("paper_key").limit(1).select(*p.columns)
    land, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        with admission.rocksdb_state(spark):
            src = spark.readStream.schema(p.schema).parquet(land)
            admission.ingest_stateful(src, out, str(tmp_path / "m"), _embed).trigger(availableNow=True).start().awaitTermination()
        return [r["topic"] for r in runs.read(spark, out, "state").collect()]

    bad = scored.withColumn("abstract", F.lit("")).withColumn("sections", F.array().cast(p.schema["sections"].dataType))
    bad.write.parquet(land)
    assert run() == [] and runs.read(spark, out, "rejected").count() == 1
    copies = [scored.withColumn("topic", F.lit(t)) for t in ("zz", K.TOPICS[1], K.TOPICS[0], "aa")]
    for df in copies[1:]:
        copies[0] = copies[0].unionByName(df)
    copies[0].write.mode("append").parquet(land)
    assert run() == [K.TOPICS[0]]
    scored.write.mode("append").parquet(land)
    assert run() == [K.TOPICS[0]]


def test_a_first_batch_may_be_rejected_whole(spark, tmp_path):
    p = V.papers(spark, SF).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    p.limit(3).withColumn("sections", F.array().cast(p.schema["sections"].dataType)).withColumn("abstract", F.lit("")).write.parquet(land)
    src = spark.readStream.schema(p.schema).parquet(land)
    jobs.ingest_stream(src, out, str(tmp_path / "m"), _embed).trigger(availableNow=True).start().awaitTermination()
    assert runs.read(spark, out, "state").count() == 0 and runs.read(spark, out, "rejected").count() == 3


def _limited(rows):
    state, out = {}, []
    for key, ts, limit in sorted(rows, key=lambda r: (r[0], r[1])):
        start, used = state.get(key, (None, 0))
        if start is None or (ts - start).total_seconds() >= 60:
            start, used = ts, 0
        out.append((key, ts, used < limit))
        state[key] = (start, used + (used < limit))
    return out


def test_fixed_windows_start_at_the_first_request(spark, tmp_path):
    rng = random.Random(2)
    t0 = datetime(2024, 1, 1)
    rows = [(f"k{rng.randint(0, 2)}", t0 + timedelta(milliseconds=rng.randint(0, 400_000)), 10) for _ in range(400)]
    rows += [("hot", t0 + timedelta(milliseconds=300 * i), 60) for i in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, ts timestamp, limit int")
    want = sorted((k, ok) for k, _, ok in _limited(rows))
    assert sorted((r["key"], r["allowed"]) for r in jobs.limit_requests(df).select("key", "allowed").collect()) == want
    # The same as a stream that sees the requests in time order over several batches.
    for i, part in enumerate(range(0, len(rows), 500)):
        ordered = sorted(rows, key=lambda r: r[1])[part:part + 500]
        spark.createDataFrame(ordered, df.schema).coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / f"in/{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.limit_requests(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == len(rows)
    assert {r["key"]: r["a"] for r in got.groupBy("key").agg(F.count_if("allowed").alias("a")).collect()} == {
        k: sum(ok for key, ok in want if key == k) for k in {k for k, _ in want}}


def test_failed_papers_are_not_committed_and_can_be_retried(spark, tmp_path):
    p = V.papers(spark, SF).drop("study_design", "sample_size", "evidence_level", "cancer_type", "doc_id")
    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    p.write.parquet(land)

    def run(mark, embedder):
        src = spark.readStream.schema(p.schema).parquet(land)
        jobs.ingest_stream(src, out, str(tmp_path / mark), embedder).trigger(availableNow=True).start().awaitTermination()
        return runs.read(spark, out, "chunks")

    def down(texts):
        raise ConnectionError("model down")

    assert run("a", down).count() == 0
    good = run("b", lambda texts: [None if len(t) % 3 == 0 else [1.0] for t in texts])
    assert good.where("embedding is null").count() == 0
    some = runs.read(spark, out, "state").count()
    left = jobs.retry_failed(spark, out, _embed, "r1")
    assert left > 0 and jobs.retry_failed(spark, out, _embed, "r2") == 0
    chunks, state = runs.read(spark, out, "chunks"), runs.read(spark, out, "state")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == chunks.where("embedding is not null").count()
    assert state.count() == state.select("paper_key").distinct().count() == some + left
    assert {r[0] for r in chunks.select("paper_key").distinct().collect()} <= {r[0] for r in state.select("paper_key").collect()}


def test_closing_request_counts_all_windows(spark):
    stream = {r["key"]: r["requests"] for r in T.minute_stream(spark, SF).collect()}
    batch = {r["key"]: r["n"] for r in T.rate_limit_minute(spark, SF).groupBy("key").agg(F.sum("requests").alias("n")).collect()}
    assert stream == batch


def test_health_paths_are_exempt(spark):
    df = spark.createDataFrame([("/health/x", "k", "1"), ("/q", "", "2"), ("/q", "k", "1"), ("/q", None, None)], "path string, api_key string, ip string")
    got = jobs.request_keys(df.withColumn("ts", F.current_timestamp()))
    assert {(r["key"], r["limit"]) for r in got.collect()} == {("ip:2", 10), ("key:k", 60), ("ip:unknown", 10)}


def test_progress_rows_of_named_queries(spark, tmp_path):
    land = str(tmp_path / "land")
    for i in range(3):
        spark.range(10 * i, 10 * i + 10, 1, 1).write.mode("append").parquet(land)
    listener = ProgressTable(spark, str(tmp_path / "log"), every=2, names=("watched",))
    assert listener.read().count() == 0
    spark.streams.addListener(listener)
    try:
        for name in ("watched", "other"):
            query = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(land).writeStream.queryName(name).format(
                "parquet").option("path", str(tmp_path / name)).option(
                "checkpointLocation", str(tmp_path / f"{name}-mark")).trigger(availableNow=True).start()
            query.awaitTermination()
            assert listener.wait(query.runId, 30 if name == "watched" else 0) == (name == "watched")
    finally:
        spark.streams.removeListener(listener)
    got = listener.read().where("input_rows > 0").orderBy("batch_id").collect()
    assert [(r["name"], r["input_rows"], r["state_rows"]) for r in got] == [("watched", 10, 0)] * 3
