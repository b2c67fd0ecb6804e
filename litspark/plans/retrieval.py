"""Batch hybrid retrieval: many questions against the whole corpus in one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.operators import fusion
from litspark.operators.dense import dense_topk
from litspark.operators.filters import ChunkFilter, query_filter_condition, with_filter_columns
from litspark.operators.keyword import KeywordIndex, keyword_topk, prune_index
from litspark.operators.keyword_scan import fits_scan, scan_topk
from litspark.operators.scorers import cosine_relevance, score_relevance
from litspark.session import store
from litspark.sizing import BROADCAST_ROWS, join_small

MAX_FILTERS = 500
META = ["cancer_type", "section", "study_design", "chunk_type", "year", "evidence_level"]


@dataclass(frozen=True)
class Retrieval:
    """``fused`` candidates, ``ranked`` graded chunks with metadata, ``summary`` per query."""

    fused: DataFrame
    ranked: DataFrame
    summary: DataFrame


def _by_filter(queries: DataFrame, columns: list[str], null_passes: bool, run) -> DataFrame:
    """``run(queries, conditions)`` under each query's own filter.

    Distinct filters become flags computed once per chunk. A batch with more
    filters than one flag array should hold is split by filter hash, one scan per part.
    """
    names = [c for c in queries.columns if c.startswith("f_")]
    if not names:
        return run(queries.select(*columns), None)
    keyed = queries.select(*columns, *names, F.to_json(F.struct(*names)).alias("_f"))
    n_filters = keyed.select("_f").distinct().count()
    parts = -(-n_filters // MAX_FILTERS) or 1
    found = []
    for p in range(parts):
        part = keyed if parts == 1 else keyed.where(F.pmod(F.xxhash64("_f"), F.lit(parts)) == p)
        specs = part.select("_f", *names).dropDuplicates(["_f"]).orderBy("_f").collect()
        conditions = [
            ChunkFilter(**{n.removeprefix("f_"): tuple(spec[n]) if isinstance(spec[n], list) else spec[n]
                           for n in names if spec[n] is not None}).condition(null_passes)
            for spec in specs]
        table = queries.sparkSession.createDataFrame(
            [(spec["_f"], n) for n, spec in enumerate(specs)], "_f string, filter_no int")
        found.append(run(part.join(F.broadcast(table), "_f").select(*columns, "filter_no"), conditions))
    return reduce(DataFrame.unionByName, found)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = K.TOP_K_RETRIEVAL) -> DataFrame:
    """Dense top-k; a missing year or evidence level fails a query's range."""
    return _by_filter(queries, ["query_id", "embedding"], False,
                      lambda q, conditions: dense_topk(q, vectors, k, conditions=conditions))


def keyword_search(queries: DataFrame, chunks: DataFrame, index: KeywordIndex | None = None,
                   k: int = K.TOP_K_RETRIEVAL) -> DataFrame:
    """Keyword top-k; a missing year or evidence level passes a query's range.

    With an ``index`` (built with ``carry=META`` for filters) only the posting
    lists of the query terms are read. Without one the chunk texts are scanned
    where they lie, or, for more query terms than a task can hold, indexed for
    the query vocabulary on the fly.
    """
    filters = [c for c in queries.columns if c.startswith("f_")]
    if index is None and fits_scan(queries):
        return _by_filter(queries, ["query_id", "question"], True,
                          lambda q, conditions: scan_topk(q, chunks, k, conditions))
    carry = META if filters else None
    asked = queries.select("query_id", "question", *filters)
    if filters:
        asked = with_filter_columns(asked)
    return keyword_topk(index or prune_index(chunks, asked, carry), asked, k,
                        condition=query_filter_condition(null_passes=True) if filters else None, carry=carry)


def _fetch(big: DataFrame, few: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows of a large table for a few keys: the keys travel, the table is only scanned.

    ``few`` has at most ``k`` rows per query, so the query count bounds it.
    """
    return join_small(big, few, ["chunk_id"], max_rows=BROADCAST_ROWS // max(k, 1),
                      bounded_by=queries.select("query_id"))


def retrieve(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, index: KeywordIndex | None, now_year: int,
    k: int = K.TOP_K_RETRIEVAL, top_n: int = K.TOP_K_RERANK, diversity_cap: int | None = K.DIVERSITY_CAP,
    scorer=None, passthrough: bool = False, external: DataFrame | None = None,
    order_by: str = "relevance", floor: float = K.CONFIDENCE_LOW, materialise: bool = True,
) -> Retrieval:
    """Dense and keyword top-k, fusion, cap, rerank, grading and fallback.

    ``queries(query_id, question, embedding[, f_cancer_type, f_year_min, …])``;
    ``vectors(chunk_id, embedding, <META>)``; ``index`` as in
    :func:`keyword_search`. Relevance is the cosine unless ``scorer`` is
    given; ``passthrough`` keeps the fused score, which never reaches ``floor``
    at its default.

    The searches run once: their candidates, at most ``k`` rows per query with
    text and metadata, are written to the shared folder, and ranking, grading,
    fallback and summary all read that small table. ``materialise=False`` keeps
    one lazy plan instead.
    """
    dense = dense_search(queries, vectors, k)
    keyword = keyword_search(queries, chunks, index, k)
    found = fusion.fuse(dense, keyword, top_k=k)
    found = _fetch(chunks.select(*[c for c in chunks.columns if c != "embedding"]), found, queries, k)
    if materialise:
        found = store(found, "candidates")
    fused = found.select("query_id", "chunk_id", "dense_rank", "keyword_rank", "score", "rank")
    candidates = found if diversity_cap is None else fusion.cap_designs(found, diversity_cap)
    if passthrough:
        judged = candidates.withColumn("relevance_score", F.lit(None).cast("double"))
    elif scorer is not None:
        judged = score_relevance(candidates.join(queries.select("query_id", "question"), "query_id"), scorer).drop("question")
    else:
        near = _fetch(vectors.select("chunk_id", "embedding"), candidates.select("chunk_id").distinct(), queries, k)
        judged = cosine_relevance(candidates, queries, near)
    if materialise and not passthrough:
        judged = store(judged, "judged")
    ranked = fusion.graded_and_renumbered(fusion.rerank(judged, now_year, top_n, order_by), floor)
    if external is not None:
        ranked = fusion.with_fallback(queries, ranked, external, top_n)
    return Retrieval(fused, ranked, fusion.retrieval_summary(queries, candidates, ranked))
