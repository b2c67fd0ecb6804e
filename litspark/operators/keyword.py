"""Keyword index and BM25 search as relational operators.

The index is three tables: postings, terms and one row of corpus statistics.
Terms are counted per chunk where the chunk lies; only chunks whose id occurs
more than once meet, to be counted as one. A search gathers the postings of the
asked terms by chunk and scores them as they stream by, so that no task holds
the pairs of questions and chunks; the best of a task are held for every question.
More query terms than a task holds are joined and aggregated instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark import constants as K
from litspark.functions.scores import idf, term_weight
from litspark.functions.text import tokens
from litspark.session import store
from litspark.sizing import join_small

MAX_QUERY_TERMS = 500_000     # (query, term) pairs held by every task
_ROWS = 1024                  # chunks counted at once
_CELLS = 1_000_000            # (query, term, chunk) uses scored at once, and score matrix cells


@dataclass(frozen=True)
class KeywordIndex:
    """``postings(chunk_id, dl, <carried>, term, tf)``, ``terms(term, df, idf)``,
    ``stats(n_chunks, avgdl)``."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def write(self, path: str) -> "KeywordIndex":
        """Store the index, postings partitioned by a hash of their term, and read it back.

        Postings are computed once: terms are counted from the written ones.
        """
        spark = self.postings.sparkSession
        placed = self.postings.withColumn("bucket", term_bucket(F.col("term")))
        placed.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode(
            "overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        stats = spark.read.parquet(f"{path}/stats")
        _term_table(spark.read.parquet(f"{path}/postings"), stats).write.mode("overwrite").parquet(f"{path}/terms")
        return KeywordIndex.read(spark, path)

    @staticmethod
    def read(spark, path: str) -> "KeywordIndex":
        return KeywordIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats")))

    def for_terms(self, asked: DataFrame) -> DataFrame:
        """Postings of a stored index in the asked terms' buckets; those of any other index, all."""
        if "bucket" not in self.postings.columns:
            return self.postings
        wanted = [r[0] for r in asked.select(term_bucket(F.col("term"))).distinct().collect()]
        return self.postings.where(F.col("bucket").isin(wanted)) if wanted else self.postings.limit(0)

    def is_current(self, chunks: DataFrame) -> bool:
        """Whether the index covers the corpus as it is: as many chunks, with the same ids and texts."""
        return self.stats.select("n_chunks", "mark").first() == _corpus_stats(chunks).select("n_chunks", "mark").first()


TERM_BUCKETS = 64


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def count_terms(chunks: DataFrame, carry: list[str], vocabulary: list[str] | None = None) -> DataFrame:
    """``(chunk_id, <carry>, dl, terms map<term, tf>)`` of every chunk, counted where it lies; of the ``vocabulary`` only, if given."""
    toks = chunks.select("chunk_id", *carry, tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    kept = [*toks.schema.fields[:-1], T.StructField("dl", T.IntegerType()), T.StructField("terms", T.MapType(T.StringType(), T.LongType()))]
    shared = None if vocabulary is None else chunks.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = None if shared is None else pa.array(shared.value, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                words, dl = part.column(part.num_columns - 1).flatten(), pc.list_value_length(part.column(part.num_columns - 1)).to_numpy()
                row = np.repeat(np.arange(part.num_rows), dl)
                if value_set is None:
                    coded = words.dictionary_encode()
                    names, term = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                else:
                    names, term = value_set, pc.fill_null(pc.index_in(words, value_set=value_set), -1).to_numpy().astype(np.int64)
                    row, term = row[term >= 0], term[term >= 0]
                pair, tf = np.unique(row * max(len(names), 1) + term, return_counts=True)
                ends = np.searchsorted(pair // max(len(names), 1), np.arange(part.num_rows + 1)).astype(np.int32)
                terms = pa.MapArray.from_arrays(pa.array(ends), names.take(pa.array(pair % max(len(names), 1))), pa.array(tf.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(dl.astype(np.int32)), terms], names=[f.name for f in kept])

    return toks.mapInArrow(run, T.StructType(kept))


def _postings(chunks: DataFrame, carry: list[str], vocabulary: list[str] | None = None) -> DataFrame:
    """``(chunk_id, dl, <carry>, term, tf)``; rows that agree in id, length and carried columns are one chunk.

    Ids are compared by a hash, so null ids count as equal and a collision only takes the longer way.
    """
    def exploded(some: DataFrame) -> DataFrame:
        return count_terms(some, carry, vocabulary).select("chunk_id", "dl", *carry, F.explode("terms").alias("term", "tf"))

    again = store(chunks.groupBy(F.xxhash64("chunk_id").alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"), "repeated-ids")
    if again.isEmpty():
        return exploded(chunks)
    keyed = chunks.select("chunk_id", "text", *carry, F.xxhash64("chunk_id").alias("_key"))
    several = exploded(join_small(keyed, again, ["_key"], "left_semi"))
    return exploded(join_small(keyed, again, ["_key"], "left_anti")).unionByName(
        several.groupBy("chunk_id", "dl", *carry, "term").agg(F.sum("tf").alias("tf")))


def build_keyword_index(chunks: DataFrame, carry: list[str] | None = None) -> KeywordIndex:
    """Index ``chunks(chunk_id, text, …)``.

    ``carry`` names chunk columns kept beside each posting, so filters at search
    time need no join back to the chunk table.
    """
    postings = _postings(chunks, carry or [])
    stats = _corpus_stats(chunks)
    return KeywordIndex(postings, _term_table(postings, stats), stats)


def _corpus_stats(chunks: DataFrame) -> DataFrame:
    lengths = chunks.select(F.size(tokens(F.coalesce("text", F.lit("")))).alias("dl"), F.xxhash64("chunk_id", "text").alias("h"))
    return lengths.agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"), F.bit_xor("h").alias("mark"))


def _stat(stats: DataFrame, name: str) -> Column:
    # Always the whole row, so all uses are one subquery that runs once.
    return stats.select(F.struct("n_chunks", "avgdl")).scalar()[name]


def _term_table(postings: DataFrame, stats: DataFrame) -> DataFrame:
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", idf(_stat(stats, "n_chunks"), F.col("df")))


def query_terms(queries: DataFrame, text: str = "question") -> DataFrame:
    """``(query_id, term, qtf)``; a repeated query word counts again."""
    return (
        queries.select("query_id", F.explode(tokens(F.col(text))).alias("term"))
        .groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    )


def prune_index(chunks: DataFrame, queries: DataFrame, carry: list[str] | None = None,
                text: str = "question") -> KeywordIndex:
    """Index of only the query vocabulary, for a batch of queries without a stored index.

    Corpus size, lengths and frequencies still come from every chunk; other
    terms are dropped right after tokenising, before anything is aggregated.
    """
    carry = carry or []
    vocabulary = query_terms(queries, text).select("term").distinct()
    few = [r["term"] for r in vocabulary.limit(MAX_QUERY_TERMS + 1).collect()]
    if len(few) <= MAX_QUERY_TERMS:
        postings = _postings(chunks, carry, few)
    else:
        postings = join_small(_postings(chunks, carry), vocabulary, ["term"], "left_semi", spread=F.col("chunk_id"))
    stats = _corpus_stats(chunks)
    return KeywordIndex(postings, _term_table(postings, stats), stats)


def keyword_scores(index: KeywordIndex, queries: DataFrame, text: str = "question",
                   carry: list[str] | None = None, digits: int = 9) -> DataFrame:
    """BM25 score of every chunk that shares a weighted term with a query.

    Terms in half the corpus or more weigh zero and are dropped before the
    postings are touched, which removes the longest posting lists at no loss.
    Scores are rounded to ``digits`` so that equal texts tie exactly whatever
    order their terms were summed in.
    """
    carry = carry or []
    asked = query_terms(queries, text)
    wanted = asked.join(index.terms.where("idf > 0"), "term").select("term", "query_id", "qtf", "idf")
    if asked.limit(MAX_QUERY_TERMS + 1).count() <= MAX_QUERY_TERMS:
        scored = streamed_scores(index.for_terms(asked), wanted, index.stats.first()["avgdl"], carry)
    else:
        hits = join_small(index.for_terms(asked), wanted, ["term"], spread=F.col("chunk_id"), bounded_by=asked)
        weight = F.col("qtf") * F.col("idf") * term_weight(F.col("tf"), F.col("dl"), _stat(index.stats, "avgdl"))
        scored = hits.groupBy("query_id", "chunk_id", *carry).agg(F.sum(weight).alias("score"))
    return scored.withColumn("score", F.round("score", digits)).where("score > 0")


def streamed_scores(postings: DataFrame, wanted: DataFrame, avgdl: float | None, carry: list[str]) -> DataFrame:
    """``(query_id, chunk_id, <carry>, score)``: postings gathered by chunk, scored one batch of chunks after the other.

    ``wanted(term, query_id, qtf, idf)`` has at most ``MAX_QUERY_TERMS`` rows.
    """
    spark = wanted.sparkSession
    rows = sorted(wanted.collect(), key=lambda r: r["term"])
    avgdl = avgdl or 1.0
    names, terms, start = {}, [], []
    for i, r in enumerate(rows):
        names.setdefault(r["query_id"], len(names))
        if not terms or terms[-1] != r["term"]:
            terms.append(r["term"])
            start.append(i)
    shared = spark.sparkContext.broadcast((
        len(names), np.array([*start, len(rows)]), np.array([names[r["query_id"]] for r in rows], dtype=np.int64),
        np.array([r["qtf"] * r["idf"] for r in rows], dtype=float)))
    numbers = spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, _t int")
    asking = spark.createDataFrame([(n, q) for q, n in names.items()], T.StructType([T.StructField("_q", T.IntegerType()), wanted.schema["query_id"]]))
    # Nulls are hashed as flags too, so that values don't pass for their neighbours'.
    chunk = F.xxhash64("chunk_id", *[x for c in carry for x in (F.col(c), F.col(c).isNull())])
    hits = join_small(postings, numbers, ["term"], spread=F.col("chunk_id")).select(
        "chunk_id", *carry, chunk.alias("_c"), "_t", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))
    kept = [hits.schema["chunk_id"], *[hits.schema[c] for c in carry]]
    out = T.StructType([T.StructField("_q", T.IntegerType()), *kept, T.StructField("score", T.DoubleType())])

    def score(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n_queries, term_start, term_query, term_weights = shared.value
        key, term, tf, dl = (rows.column(c).to_numpy() for c in ("_c", "_t", "tf", "dl"))
        part = term_weights_of(tf, dl)
        first = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        uses = term_start[term + 1] - term_start[term]
        done = np.r_[0, np.cumsum(uses)]
        at, n = 0, len(first) - 1
        while at < n:
            # As many chunks as stay inside the work bounds, at least one.
            end = min(n, at + max(1, _CELLS // n_queries))
            end = max(at + 1, int(np.searchsorted(done[first[at:end + 1]], done[first[at]] + _CELLS, side="right")) - 1 + at)
            lo, hi = first[at], first[end]
            entry = np.repeat(np.arange(lo, hi), uses[lo:hi])
            use = np.arange(len(entry)) - (done[entry] - done[lo]) + term_start[term[entry]]
            cell = (np.searchsorted(first, entry, side="right") - 1 - at) * n_queries + term_query[use]
            sums = np.bincount(cell, weights=part[entry] * term_weights[use], minlength=n_queries * (end - at))
            found = np.flatnonzero(sums > 0)
            own = rows.select([f.name for f in kept]).take(pa.array(first[at + found // n_queries]))
            table = pa.table([pa.array((found % n_queries).astype(np.int32)), *own.columns, pa.array(sums[found])], names=out.names)
            yield from table.to_batches(max_chunksize=100_000)
            at = end

    def term_weights_of(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / avgdl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            # The last chunk may go on in the next batch.
            key = rows.column("_c").to_numpy()
            last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
            yield from score(rows.slice(0, last)) if last else ()
            held = rows.slice(last)
        if held is not None:
            yield from score(held)

    scored = hits.repartition("_c").sortWithinPartitions("_c").mapInArrow(run, out)
    return scored.join(F.broadcast(asking), "_q").select("query_id", "chunk_id", *carry, "score")


def best_in_task(scored: DataFrame, k: int) -> DataFrame:
    """Rows without those that are not among their task's best ``k`` of their query; ties go to the smaller id."""
    def trim(rows: pa.Table) -> tuple[pa.Table, dict]:
        order = pc.sort_indices(rows, sort_keys=[("query_id", "ascending"), ("score", "descending"), ("chunk_id", "ascending")], null_placement="at_start")
        rows = rows.take(order).combine_chunks()
        query = rows.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        code = query.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, dtype=np.int64)
        place = np.arange(len(code)) - np.repeat(starts, np.diff(np.r_[starts, len(code)]))
        score = rows.column("score").to_numpy()
        names = query.dictionary.to_pylist()
        floors = {names[code[i]]: score[i] for i in np.flatnonzero(place == k - 1)}
        return rows.filter(pa.array(place < k)), floors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, floors, most = None, {}, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            query = batch.column(batch.schema.get_field_index("query_id")).dictionary_encode(null_encoding="encode")
            floor = np.array([floors.get(q, -np.inf) for q in query.dictionary.to_pylist()])
            if len(floor):
                rows = rows.filter(pa.array(rows.column("score").to_numpy() >= floor[query.indices.to_numpy()]))
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows > most:
                held, floors = trim(held)
                most = 2 * held.num_rows + _CELLS // 10
        if held is not None and held.num_rows:
            yield from trim(held)[0].to_batches()

    return scored.mapInArrow(run, scored.schema)


def top_ranked(scored: DataFrame, k: int, score: Column | None = None,
               group: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """First ``k`` rows per group by score; ties go to the smaller key.

    The rank filter turns into a per-partition group limit, so at most ``k``
    rows per group and partition reach the shuffle even for one hot group.
    """
    order = Window.partitionBy(group).orderBy((score if score is not None else F.col("score")).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keyword_topk(index: KeywordIndex, queries: DataFrame, k: int = K.TOP_K_RETRIEVAL,
                 condition: Column | None = None, text: str = "question",
                 carry: list[str] | None = None) -> DataFrame:
    """Top ``k`` chunks per query; ``condition`` filters after scoring, before ranking.

    A condition may use the carried chunk columns and any extra column of
    ``queries`` (per-query filter values).
    """
    scored = keyword_scores(index, queries, text, carry)
    if condition is not None:
        extra = [c for c in queries.columns if c not in ("query_id", text)]
        if extra:
            scored = join_small(scored, queries.select("query_id", *extra), ["query_id"],
                                spread=F.col("chunk_id"))
        scored = scored.where(condition)
    # Sorting all pairs in a task would spill them.
    return top_ranked(best_in_task(scored.select("query_id", "chunk_id", "score"), k), k).select("query_id", "chunk_id", "score", "rank")
