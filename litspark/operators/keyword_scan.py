"""BM25 search of a batch of questions straight over the chunks, without an index.

Two passes over the chunk texts and no shuffle of them. The first counts the
query vocabulary: tokens of a chunk are one array, so document frequencies need
no grouping by chunk, only a small aggregation by term. The second scores every
chunk where it lies: Arrow batches of token arrays are matched against the
query vocabulary and each task keeps its best ``k`` chunks per question.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.text import tokens
from litspark.operators.keyword import MAX_QUERY_TERMS, query_terms, top_ranked
from litspark.operators.topk import OUT, QUERY_BLOCK, Best, allowed_rows, as_batches, blocks, flag_matrix, in_parts, offer

_HITS = 2_000_000             # pairs scored at once
_CELLS = 2_000_000            # score matrix cells held at once
_ROWS = 2048                  # chunks whose tokens are looked up at once


def fits_scan(queries: DataFrame, text: str = "question") -> bool:
    """Whether the query terms are few enough to be held by every task."""
    return query_terms(queries, text).limit(MAX_QUERY_TERMS + 1).count() <= MAX_QUERY_TERMS


def vocabulary_counts(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(term, df, total)`` for the vocabulary, and a row for the empty term.

    The empty term, which no text contains, stands for the corpus: its ``df`` is
    the number of chunks and its ``total`` the number of tokens. Tokens are
    looked up where they lie; a task sends a row per term it has met.
    """
    # Bounded by the check on query terms.
    words = sorted(r["term"] for r in vocabulary.select("term").distinct().collect())
    shared = chunks.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(shared.value, pa.string())
        df, n, total = np.zeros(len(value_set), dtype=np.int64), 0, 0
        for batch in in_parts(batches, _ROWS):
            chunk, term, dl = _known_tokens(batch.column(0), value_set)
            n, total = n + len(dl), total + int(dl.sum())
            df += np.bincount(np.unique(chunk * len(value_set) + term) % max(len(value_set), 1), minlength=len(df))
        if n:
            met = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([value_set.take(pa.array(met)), pa.array([""])]), pa.array(np.append(df[met], n)), pa.array(np.append(0 * met, total))],
                names=["term", "df", "total"])

    toks = chunks.select(tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return toks.mapInArrow(count, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _known_tokens(column: pa.Array, value_set: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and vocabulary number of every token that is in the vocabulary, and all rows' lengths."""
    dl = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    term = pc.fill_null(pc.index_in(column.flatten(), value_set=value_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = term >= 0
    return np.repeat(np.arange(len(dl)), dl)[known], term[known], dl


def scan_topk(queries: DataFrame, chunks: DataFrame, k: int = K.TOP_K_RETRIEVAL,
              conditions: list[Column] | None = None, text: str = "question", digits: int = 9,
              k1: float = K.BM25_K1, b: float = K.BM25_B) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` of the best ``k`` chunks of every question.

    ``queries(query_id, <text>[, filter_no])``; ``conditions`` as in dense
    search, applied after scoring. Callers check :func:`fits_scan` first.
    """
    spark = chunks.sparkSession
    asked = query_terms(queries, text)
    counts = vocabulary_counts(chunks, asked.select("term").distinct())
    number = F.col("filter_no") if "filter_no" in queries.columns else F.lit(None).cast("int")
    terms = asked.join(queries.select("query_id", number.alias("filter_no")), "query_id").unionByName(
        spark.createDataFrame([(None, "", 0, None)], "query_id string, term string, qtf long, filter_no int"))
    # One row per (query, term), bounded by the check on query terms, plus the corpus row.
    rows = terms.join(counts, "term").orderBy("term", "query_id").collect()
    if len(rows) < 2:
        return top_ranked(spark.createDataFrame([], OUT), k)
    n_chunks, avgdl = rows[0]["df"], rows[0]["total"] / rows[0]["df"]
    shared = spark.sparkContext.broadcast(_pack(rows[1:], n_chunks))
    picked = [F.col("chunk_id").cast("string").alias("chunk_id"), tokens(F.coalesce("text", F.lit(""))).alias("tokens")]
    if conditions:
        picked.append(F.array(*[F.coalesce(c, F.lit(False)) for c in conditions]).alias("allowed"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_names, filters, vocabulary, term_start, term_query, term_weight = shared.value
        value_set = pa.array(vocabulary, pa.string())
        bests = blocks(len(q_names), k)
        for batch in in_parts(batches, _ROWS):
            if batch.num_rows and vocabulary:
                _score(bests, batch, value_set, term_start, term_query, term_weight, filters, avgdl, k1, b, digits)
        yield from as_batches(bests, q_names)

    return top_ranked(chunks.select(*picked).mapInArrow(scan, OUT), k)


def _pack(rows: list, n_chunks: int) -> tuple:
    """Query terms as arrays: for every weighted term the queries that use it and its weight there."""
    idf = {r["term"]: max(math.log((n_chunks - r["df"] + 0.5) / (r["df"] + 0.5)), 0.0) for r in rows}
    rows = [r for r in rows if idf[r["term"]] > 0]
    q_names = np.array(sorted({r["query_id"] for r in rows}), dtype=object)
    at = {name: i for i, name in enumerate(q_names)}
    filters = np.full(len(q_names), np.nan)
    for r in rows:
        if r["filter_no"] is not None:
            filters[at[r["query_id"]]] = r["filter_no"]
    terms, start = [], []
    for i, r in enumerate(rows):
        if not terms or terms[-1] != r["term"]:
            terms.append(r["term"])
            start.append(i)
    return (q_names, filters, terms, np.array([*start, len(rows)]),
            np.array([at[r["query_id"]] for r in rows], dtype=np.int64), np.array([r["qtf"] * idf[r["term"]] for r in rows]))


def _score(bests: list[Best], batch: pa.RecordBatch, value_set: pa.Array, term_start: np.ndarray,
           term_query: np.ndarray, term_weight: np.ndarray, filters: np.ndarray, avgdl: float,
           k1: float, b: float, digits: int) -> None:
    column = batch.column(batch.schema.get_field_index("tokens"))
    ids = np.array(batch.column(batch.schema.get_field_index("chunk_id")).to_pylist(), dtype=object)
    chunk, term, dl = _known_tokens(column, value_set)
    # One entry per (chunk, term) with its frequency, in chunk order.
    pair, tf = np.unique(chunk * len(value_set) + term, return_counts=True)
    chunk, term = pair // len(value_set), pair % len(value_set)
    part = tf / (tf + k1 * (1 - b + b * dl[chunk] / avgdl))
    uses = term_start[term + 1] - term_start[term]
    n_queries = len(filters)
    allowed = allowed_rows(filters, flag_matrix(batch))
    done = np.concatenate([[0], np.cumsum(uses)])
    first = np.searchsorted(chunk, np.arange(len(ids) + 1))
    at = 0
    while at < len(ids):
        # As many chunks as stay inside the work bounds, at least one.
        most = min(len(ids), at + max(1, _CELLS // n_queries))
        end = int(np.searchsorted(done[first[at:most + 1]], done[first[at]] + _HITS, side="right")) - 1 + at
        end = min(max(end, at + 1), most)
        lo, hi = first[at], first[end]
        n_hits = done[hi] - done[lo]
        if n_hits:
            entry = np.repeat(np.arange(lo, hi), uses[lo:hi])
            use = np.arange(n_hits) - (done[entry] - done[lo]) + term_start[term[entry]]
            cell = term_query[use] * (end - at) + (chunk[entry] - at)
            scores = np.bincount(cell, weights=part[entry] * term_weight[use], minlength=n_queries * (end - at))
            scores = np.round(scores.reshape(n_queries, end - at), digits)
            ok = scores > 0
            if allowed is not None:
                ok &= allowed[:, at:end]
            for block, best in enumerate(bests):
                rows = slice(block * QUERY_BLOCK, (block + 1) * QUERY_BLOCK)
                offer(best, scores[rows], ok[rows], ids[at:end])
        at = end
