"""The corpus pipeline: quality rules, near duplicates, repeated substrings, mixing and packing, one table after the other.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents (others are dropped, so
names can't clash). Null and empty texts, of any id, have no words and go in the
first stage. Texts of any length stay whole. Ties go to the smaller id, and rows
that agree in id and text count as one document from the second stage on. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm import mixing, packing, quality_rules, set_join, substrings
from litspark.session import store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """Documents whose text is now the column ``text``."""
    return docs.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    return _with_text(quality_rules.judge_lines(docs.select(*COLUMNS)).where("kept"), "cleaned")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, the one with the smallest id; nulls count as the largest, and equal rows are one document."""
    return set_join.survivors(docs.select(*COLUMNS)).select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated strings; what has no word left goes."""
    found = substrings.remove_repeats(docs.select(*COLUMNS))
    return _with_text(found.where(F.rtrim(F.col("cleaned"), F.lit(" \t\n\x0b\f\r")) != ""), "cleaned")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents repeat as often as their source's target asks for."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in their sequences."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("repeated_substrings", repeated_substrings),
          ("mix_sources", mix), ("pack", pack)]

#: Hashes and token ids decide what SQL can't repeat; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
