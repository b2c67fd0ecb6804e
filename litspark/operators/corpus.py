"""Corpus building blocks: skip, dedupe, attach metadata, chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.chunks import chunk_id, legacy_section_chunks, paper_chunks
from litspark.functions.records import extraction
from litspark.functions.scores import evidence_level
from litspark.functions.text import embedding_text, is_blank
from litspark.session import store
from litspark.sizing import fits_bytes


def skip_known(papers: DataFrame, state: DataFrame, key: str = "paper_key") -> DataFrame:
    """Papers whose id is not in the ingestion state."""
    return papers.join(state.select(key), key, "left_anti")


def first_topic_wins(papers: DataFrame, order: list[str] | None = None, key: str = "paper_key") -> DataFrame:
    """A paper found under several topics stays with the topic that comes first.

    An aggregate with map-side combination, so copies of one paper collapse
    before the shuffle.
    """
    place = F.array_position(F.array(*map(F.lit, order or K.TOPICS)), F.col("topic"))
    rank = F.when(place == 0, F.lit((1 << 31) - 1)).otherwise(place)
    row = F.struct(*papers.columns)
    return papers.groupBy(key).agg(F.min_by(row, F.struct(rank, F.col("topic"))).alias("r")).select("r.*")


def only(rows: DataFrame, ids: DataFrame, which: Column, key: str = "paper_key") -> DataFrame:
    """``rows`` whose id satisfies ``which``, by the stored ``ids(<key>, …)`` of all rows: the shorter list travels, if it is short.

    Null is an id like others. With two long lists the rows are shuffled once.
    """
    sides = [(ids.where(test).select(F.col(key).alias("_id")), how) for test, how in ((which, "left_semi"), (~which, "left_anti"))]
    same = F.col(key).eqNullSafe(F.col("_id"))
    if sides[1][0].isEmpty():
        return rows
    for few, how in sides:
        if fits_bytes(few):
            return rows.join(F.broadcast(few), same, how)
    return rows.join(sides[0][0], same, "left_semi")


def new_papers(papers: DataFrame, state: DataFrame, key: str = "paper_key") -> DataFrame:
    """Papers not in the state, once each, under the first of their topics.

    Decided on ids alone: whole papers move only to meet their own copies. Give
    it a table or a micro-batch; ids and papers are read separately.
    """
    known = state.select(F.col(key)).distinct().withColumn("_known", F.lit(True))
    ids = store(papers.groupBy(key).agg(F.count("*").alias("_n")).join(known, key, "left").select(
        key, (F.col("_n") > 1).alias("again"), F.col("_known").isNull().alias("new")), "paper-ids")
    fresh = only(papers, ids, F.col("new"), key)
    ids = ids.where("new")
    again = ids.where("again")
    if again.isEmpty():
        return fresh
    return only(fresh, ids, ~F.col("again"), key).unionByName(first_topic_wins(only(fresh, ids, F.col("again"), key), key=key))


def cap_per_topic(papers: DataFrame, cap: int, order: str = "position") -> DataFrame:
    """The first ``cap`` papers of each topic."""
    w = Window.partitionBy("topic").orderBy(order, "paper_key")
    return papers.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def harvest_ids(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct ids of all result pages by first appearance, with the ``PMC`` prefix.

    ``pages(window, position, id)``; ``cap`` keeps the first so many.
    """
    first = pages.groupBy("id").agg(F.min(F.struct("window", "position")).alias("at"))
    ids = first.select(F.concat(F.lit("PMC"), F.col("id").cast("string")).alias("pmc_id"), "at.*")
    return ids if cap is None else ids.orderBy("window", "position").limit(cap)


def harvest_windows(hits: DataFrame, limit: int = K.HARVEST_LIMIT) -> DataFrame:
    """``start, end, hits, over``: date windows of at most ``limit`` hits, from ``hits(day, hits)``.

    One window if all hits fit; else one per year, a year above the limit by months
    and a month above it by days. A single day above the limit can't be split
    and is marked ``over``. Days may repeat; null days and days without hits are left out.
    """
    day = hits.where("day is not null").groupBy("day").agg(F.sum("hits").cast("bigint").alias("hits")).where("hits > 0")
    day = day.withColumns({"year": F.trunc("day", "year"), "month": F.trunc("day", "month")})
    month = day.groupBy("year", "month").agg(F.sum("hits").alias("month_hits"))
    year = month.groupBy("year").agg(F.sum("month_hits").alias("year_hits"))
    total = F.coalesce(year.agg(F.sum("year_hits").alias("t")).scalar(), F.lit(0))
    # Totals per year and month are few rows; only days move, and only their counts.
    marked = day.join(F.broadcast(year), "year").join(month.drop("year"), "month")
    level = F.when(total <= limit, 0).when(F.col("year_hits") <= limit, 1).when(F.col("month_hits") <= limit, 2).otherwise(3)
    window = F.when(level == 0, F.lit(None).cast("date")).when(level == 1, F.col("year")).when(level == 2, F.col("month")).otherwise(F.col("day"))
    last = F.when(level == 1, F.last_day(F.add_months("year", 11))).when(level == 2, F.last_day("month")).otherwise(F.col("day"))
    first = F.when(level == 0, F.col("day")).otherwise(window)
    return marked.select(window.alias("_w"), level.alias("_l"), first.alias("start"), last.alias("end"), "hits").groupBy("_w", "_l").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("hits").alias("hits")).select(
        "start", "end", "hits", (F.col("hits") > limit).alias("over"))


def normalise_extractions(papers: DataFrame, responses: DataFrame, model: str = "") -> DataFrame:
    """Normalised extraction record per paper from raw responses ``(pmid, response)``."""
    return papers.select("pmid", "abstract").join(responses, "pmid", "left").select(
        "pmid", extraction(F.col("response"), F.col("abstract")).alias("e")
    ).select("pmid", "e.*", F.lit(model).alias("extraction_model"))


def extraction_work(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """Papers that still need extraction; cached failures are not retried, blank ids never cached."""
    blank = is_blank(F.col("pmid"))
    todo = papers.where(~blank).join(cache.select("pmid"), "pmid", "left_anti")
    return todo.unionByName(papers.where(blank).select(*todo.columns))


def no_metadata(spark: SparkSession) -> DataFrame:
    """An empty table of extraction results that the optimizer knows to be empty: a join with it moves nothing."""
    fields = {"pmid": "string", "study_design": "string", "sample_size": "int", "primary_outcome": "string", "intervention": "string", "comparator": "string"}
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields.items()])


def attach_metadata(papers: DataFrame, meta: DataFrame) -> DataFrame:
    """Left-join extraction results; papers without one get the defaults."""
    fields = ["study_design", "sample_size", "primary_outcome", "intervention", "comparator"]
    joined = papers.drop(*fields).join(meta.select("pmid", *fields), "pmid", "left")
    return joined.withColumn("study_design", F.coalesce("study_design", F.lit("unknown"))).withColumn(
        "cancer_type", F.array("topic")).withColumn("evidence_level", evidence_level(F.col("study_design")))


PAPER_FIELDS = ["paper_key", "pmid", "title", "authors", "journal", "year", "cancer_type", "study_design",
                "sample_size", "primary_outcome", "intervention", "comparator", "evidence_level", "topic"]


def chunk_papers(papers: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, table_cap: int | None = None,
                 whole: bool = False) -> DataFrame:
    """Chunks of every paper with paper fields repeated; no shuffle.

    ``papers(paper_key, sections array<struct<name, content, section_type>>, …)``.
    ``whole`` adds the paper itself as ``_paper``, on its first chunk.
    """
    keep = [c for c in PAPER_FIELDS if c in papers.columns]
    carried = [F.struct(*papers.columns).alias("_paper")] if whole else []
    flat = papers.select(*keep, *carried, F.posexplode(paper_chunks(F.col("sections"), size, overlap, table_cap)).alias(
        "chunk_index", "c"))
    first = [F.when(F.col("chunk_index") == 0, F.col("_paper")).alias("_paper")] if whole else []
    return flat.select(
        chunk_id(F.col("paper_key"), F.col("c.section"), F.col("chunk_index")).alias("chunk_id"),
        F.col("c.text").alias("text"), *keep, F.col("paper_key").alias("pmcid"),
        F.col("c.section").alias("section"), F.col("c.chunk_type").alias("chunk_type"), "chunk_index", *first)


def legacy_chunks(papers: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of the older processing: cleaned sections, index and total per section."""
    keep = [c for c in papers.columns if c not in ("sections", "authors", "abstract")]
    rows = papers.select(*keep, F.posexplode(
        legacy_section_chunks(F.col("sections"), size, overlap)).alias("ordinal", "c"))
    return rows.select(*keep, "ordinal", "c.*")


def with_embedding_text(chunks: DataFrame) -> DataFrame:
    prefix = F.col("context_prefix") if "context_prefix" in chunks.columns else None
    return chunks.withColumn("embed_text", embedding_text(
        F.col("text"), F.col("title"), F.col("section"), prefix))


def complete_papers(vectors: DataFrame) -> DataFrame:
    """Keys of papers all of whose chunks got a vector: the only ones to commit."""
    return vectors.groupBy("paper_key").agg(F.bool_and(F.col("embedding").isNotNull()).alias("ok")).where("ok").select(
        "paper_key")
