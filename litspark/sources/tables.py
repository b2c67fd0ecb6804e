"""File sources and sinks for papers, chunks, reference tables and golden queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.functions.text import or_else
from litspark.sources import schemas as S


def read_legacy_papers(spark: SparkSession, glob: str) -> DataFrame:
    """One JSON array file per topic; the topic falls back to the file name."""
    raw = spark.read.schema(S.LEGACY_PAPERS).option("multiLine", True).json(glob)
    from_name = F.regexp_extract("_metadata.file_path", r"([^/]+)_fulltext\.json$", 1)
    return raw.withColumn("topic", or_else(F.col("topic"), from_name))


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks partitioned by topic; within a topic rows are spread by paper, so a
    topic that holds a third of the corpus still writes in parallel."""
    order = [c for c in ("topic", "year") if c in chunks.columns]
    chunks.repartition("topic", "paper_key").sortWithinPartitions(*order).write.mode(mode).option(
        "maxRecordsPerFile", 2_000_000).partitionBy("topic").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_points(points: DataFrame) -> DataFrame:
    """All points without their vectors; missing ids fall back to the point id, texts to empty."""
    rest = [c for c in points.columns if c not in ("id", "chunk_id", "text", "embedding")]
    return points.select(F.coalesce("chunk_id", F.col("id").cast("string")).alias("chunk_id"),
                         F.coalesce("text", F.lit("")).alias("text"), *rest)


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("chunk_id") == chunk_id)


def chunks_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Batch lookup; ids without a chunk come back with null columns."""
    return ids.join(chunks, "chunk_id", "left")


def chunk_papers_join(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunks with the columns of their paper."""
    extra = [c for c in papers.columns if c not in chunks.columns]
    return chunks.join(papers.select("paper_key", *extra), "paper_key")


def read_reference(spark: SparkSession, path: str, item: str = S.WITHDRAWAL) -> DataFrame:
    """Entries of a reference file, ``{"entries": […]}`` or a bare array, with their order.

    A missing or malformed file gives an empty table. ``ord`` is the position
    inside the file.
    """
    entry_schema = f"array<{item}>"
    try:
        text = spark.read.text(path, wholetext=True).select(F.col("value").alias("value"))
        text.schema  # resolves the path now
    except Exception as error:  # AnalysisException: the path does not exist
        if "PATH_NOT_FOUND" not in str(error):
            raise
        text = spark.createDataFrame([], "value string")
    wrapped = F.from_json("value", f"struct<entries: {entry_schema}>")["entries"]
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", entry_schema))
    none = F.array().cast(entry_schema)
    entries = text.select(F.coalesce(bare, wrapped, none).alias("e"))
    return entries.select(F.posexplode("e").alias("ord", "entry")).where("entry is not null").select("ord", "entry.*")


def write_reference(entries: DataFrame, path: str) -> None:
    entries.withColumn("last_updated", F.current_timestamp()).write.mode("overwrite").json(path)


def golden_queries(items: DataFrame) -> DataFrame:
    """Golden queries with both key generations merged and defaults filled.

    ``items`` holds the raw fields; an empty ``query`` or ``cancer_type`` falls
    through to ``question`` or ``topic``.
    """
    none = F.array().cast("array<string>")
    blank = F.lit("")
    return items.select(
        *[c for c in ("version",) if c in items.columns], F.coalesce("id", blank).alias("id"),
        or_else(F.col("query"), F.coalesce("question", blank)).alias("query"),
        or_else(F.col("cancer_type"), F.coalesce("topic", blank)).alias("cancer_type"),
        F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
        F.coalesce("question_type", F.lit("treatment")).alias("question_type"),
        F.coalesce("expected_study_designs", none).alias("expected_study_designs"),
        F.coalesce("must_contain_terms", none).alias("must_contain_terms"),
        F.coalesce("must_not_hallucinate", F.lit(True)).alias("must_not_hallucinate"),
        F.coalesce("ground_truth", blank).alias("ground_truth"),
        F.coalesce("expected_sources", none).alias("expected_sources"),
        F.coalesce("notes", blank).alias("notes"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden set file ``{"version", "queries": […]}`` with its version on every row."""
    schema = f"version string, queries array<{S.GOLDEN_ITEM}>"
    file = spark.read.schema(schema).option("multiLine", True).json(path)
    items = file.select(F.coalesce("version", F.lit("1.0")).alias("version"), F.explode("queries").alias("q"))
    return golden_queries(items.select("version", "q.*"))


def append_golden(golden: DataFrame, new: DataFrame, order: str = "seq", width: int = 3,
                  bucket: int = 100_000) -> DataFrame:
    """Union with ids assigned to new rows that have none: ``G`` and the next numbers.

    Numbers follow ``order`` (a position). Rows are numbered inside fixed ranges
    of the position and shifted by the sizes of the ranges before, so no single
    task numbers everything.
    """
    number = F.when(F.col("id").rlike(r"^G\p{Nd}+$"), F.substring("id", F.lit(2), F.length("id")).try_cast("bigint"))
    top = golden.agg(F.coalesce(F.max(number), F.lit(0)).alias("top"))
    named = new.where(F.coalesce(F.col("id"), F.lit("")) != "")
    bare = new.where(F.coalesce(F.col("id"), F.lit("")) == "").withColumn("_b", F.floor(F.col(order) / bucket))
    sizes = bare.groupBy("_b").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(
        F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    numbered = bare.withColumn("_local", local).join(before.select("_b", "_before"), "_b").withColumn(
        "id", F.concat(F.lit("G"), F.lpad(
            (top.scalar() + F.col("_before") + F.col("_local")).cast("string"),
            F.greatest(F.lit(width), F.length((top.scalar() + F.col("_before") + F.col("_local")).cast("string"))),
            F.lit("0"))))
    return golden.unionByName(named.select(*golden.columns)).unionByName(numbered.select(*golden.columns))


def quick_sample(golden: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """``n`` queries in the order of a seeded hash: random, and the same on every run."""
    return golden.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id"))), "id").limit(n)
