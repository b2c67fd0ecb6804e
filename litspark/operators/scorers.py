"""Caller-supplied models as batched column producers.

A model is a Python function over a list of inputs. Rows reach it in Arrow
batches inside tasks; a failing batch yields nulls instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions.scores import cosine

BATCH = 100
#: Rows whose texts a task holds as Python values at once; whole batches of the model.
_ROWS = 1000
#: Of an Arrow batch of chunks where the job is run at once.
BATCH_BYTES = 16 << 20
_VECTOR = pa.list_(pa.float32())


def _batched(fn: Callable[[list], list], batch: int, *columns: pd.Series) -> list:
    rows = list(zip(*columns)) if len(columns) > 1 else list(columns[0])
    out: list = []
    for at in range(0, len(rows), batch):
        part = rows[at:at + batch]
        try:
            got = list(fn(part))
        except Exception:  # the caller's model failed; the rows stay unscored
            got = [None] * len(part)
        out += got if len(got) == len(part) else [None] * len(part)
    return out


def embed(rows: DataFrame, fn: Callable[[list], list], text: str = "embed_text", batch: int = BATCH) -> DataFrame:
    """Add ``embedding``; null where the batch of a row failed."""
    schema = rows.withColumn("embedding", F.lit(None).cast("array<float>")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _embedded(batches, fn, text, batch):
            yield part.select(names)

    return rows.mapInArrow(run, schema)


def _embedded(batches: Iterator[pa.RecordBatch], fn: Callable[[list], list], text: str, batch: int) -> Iterator[pa.RecordBatch]:
    """The rows in small parts with their vectors; only the texts become Python values, and only a part's."""
    step = batch * max(1, _ROWS // batch)
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            part = whole.slice(at, step)
            found = pd.Series(_batched(fn, batch, part.column(text).to_pylist()), dtype=object)
            try:
                vectors = pa.Array.from_pandas(found, type=_VECTOR)
            except pa.lib.ArrowException:
                vectors = pa.Array.from_pandas(found).cast(_VECTOR)
            columns = {**dict(zip(part.schema.names, part.columns)), "embedding": vectors}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def embed_papers(rows: DataFrame, fn: Callable[[list], list], text: str = "embed_text", key: str = "paper_key",
                 paper: str = "_paper", batch: int = BATCH) -> DataFrame:
    """Add ``embedding`` and ``complete``, whether all rows of a paper got a vector; drop ``text``.

    Rows of a paper follow one another, as ``chunk_papers`` leaves them. The struct
    ``paper``, which one row of a paper holds, stays only where the paper is not
    complete. A task holds back the rows of one paper. A null key can't be
    looked up later, so its rows count as complete.
    """
    schema = rows.drop(text).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("complete", F.lit(True)).schema
    names = schema.names

    def closed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = table.column(key).combine_chunks()
        numbers = _runs(keys)
        failed = pc.is_null(table.column("embedding")).to_numpy()
        bad = np.bincount(numbers, weights=failed, minlength=1) > 0
        done = pa.array(~bad[numbers]) if len(numbers) else pa.array([], pa.bool_())
        done = pc.or_(done, pc.is_null(keys))
        kept = pc.if_else(done, pa.scalar(None, table.schema.field(paper).type), table.column(paper))
        table = table.set_column(table.schema.get_field_index(paper), paper, kept).append_column("complete", done)
        yield from table.select(names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in _embedded(batches, fn, text, batch):
            keys = part.column(key)
            last = int(np.searchsorted(_runs(keys), _runs(keys)[-1]))
            same = held and held[-1].column(key)[-1].as_py() == keys[0].as_py()
            if last == 0 and same:
                held.append(part)
                continue
            if held or last:
                yield from closed(pa.Table.from_batches([*held, *([part.slice(0, last)] if last else [])]))
            held = [part.slice(last)]
        if held:
            yield from closed(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def _runs(keys: pa.Array) -> np.ndarray:
    """Number of each row's run of equal keys, from 0."""
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=np.int64)
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.cumsum(codes[1:] != codes[:-1])])


def embed_queries(queries: DataFrame, fn: Callable[[list], list], text: str = "question") -> DataFrame:
    """Embed each distinct question once, then join the vectors back."""
    unique = embed(queries.select(text).distinct(), fn, text)
    return queries.join(unique, text)


def embed_summary(vectors: DataFrame) -> DataFrame:
    """Counts of chunks, embedded and failed."""
    done = F.col("embedding").isNotNull()
    return vectors.agg(F.count("*").alias("total_chunks"), F.count_if(done).alias("embedded"),
                       F.count_if(~done).alias("failed"))


def score_relevance(pairs: DataFrame, fn: Callable[[list], list], batch: int = BATCH) -> DataFrame:
    """Add ``relevance_score`` from a model over (question, text); null where it failed.

    Call it on the capped candidate list, after ranking: the model then sees at
    most ``k`` texts per query.
    """
    schema = pairs.withColumn("relevance_score", F.lit(None).cast("double")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = _batched(fn, batch, frame["question"], frame["text"])
            yield frame.assign(relevance_score=pd.Series(scores, index=frame.index, dtype="float64"))

    return pairs.mapInPandas(run, schema)


def cosine_relevance(candidates: DataFrame, query_vectors: DataFrame, vectors: DataFrame) -> DataFrame:
    """Default relevance: cosine of query and chunk vector, for candidates only.

    ``vectors`` need only hold the candidates' vectors; a candidate without one gets null.
    """
    q = query_vectors.select("query_id", F.col("embedding").alias("_q"))
    v = vectors.select("chunk_id", F.col("embedding").alias("_v"))
    return candidates.join(q, "query_id", "left").join(v, "chunk_id", "left").withColumn(
        "relevance_score", F.round(cosine(F.col("_q"), F.col("_v")), 9)).drop("_q", "_v")


def extract_responses(papers: DataFrame, fn: Callable[[list], list], max_chars: int | None = None,
                      batch: int = BATCH) -> DataFrame:
    """``(pmid, response)``: the extractor's raw text per abstract, null where it failed; ``max_chars`` cuts what it is asked."""
    abstract = F.col("abstract") if max_chars is None else F.left("abstract", F.lit(max_chars))
    asked = papers.select("pmid", abstract.alias("_abstract"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"pmid": frame["pmid"], "response": _batched(fn, batch, frame["_abstract"])})

    return asked.mapInPandas(run, "pmid string, response string")


def judge_with(answers: DataFrame, fn: Callable[[list], list], batch: int = BATCH) -> DataFrame:
    """Add ``judge_<metric>`` columns from a caller's judge of five floats per answer.

    Where it fails the columns are null and the rules apply instead.
    """
    names = ["faithfulness", "answer_relevance", "context_precision", "context_recall", "clinical_safety"]
    shaped = answers
    for n in names:
        shaped = shaped.withColumn(f"judge_{n}", F.lit(None).cast("double"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = _batched(fn, batch, frame["question"], frame["answer"])
            columns = {f"judge_{n}": pd.Series([None if g is None else float(g[i]) for g in got],
                                               index=frame.index, dtype="float64") for i, n in enumerate(names)}
            yield frame.assign(**columns)

    return answers.mapInPandas(run, shaped.schema)
