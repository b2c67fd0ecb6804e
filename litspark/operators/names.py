"""One automaton for all names: entries of reference tables found in texts in one pass over each text.

Names, aliases and keywords of all entries become one Aho-Corasick automaton, built
once from a table of checked size and broadcast. A task runs it over the texts
of its Arrow batches; the time per text follows its length and hits, not the number
of entries, no text is joined or shuffled, and an entry's gate is a lookup.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.sizing import join_small

#: Patterns of an automaton, at most: some 100 bytes a letter in every worker.
MAX_PATTERNS = 500_000


class Names:
    """Patterns by role: of an entry's names, keywords that must occur, and keywords that must not."""

    def __init__(self, rows: list) -> None:
        roles: dict[str, list[tuple[int, int]]] = {}
        self.gated, self.always = set(), set()
        for r in rows:
            for role, words in enumerate((r["names"], r["indication_keywords"], r["biomarker_keywords"])):
                for word in words or []:
                    if word is None or (role == 0 and word == ""):
                        continue
                    if word == "":
                        self.always.add((r["ord"], role))
                    else:
                        roles.setdefault(word, []).append((r["ord"], role))
            if r["indication_keywords"]:
                self.gated.add(r["ord"])
        self.automaton = ahocorasick.Automaton()
        for word, marks in roles.items():
            self.automaton.add_word(word, marks)
        self.some = bool(roles)
        if self.some:
            self.automaton.make_automaton()

    def marks(self, text: str | None) -> set[tuple[int, int]]:
        if text is None:
            return set()
        found = set().union(*(m for _, m in self.automaton.iter(text))) if self.some else set()
        return found | self.always

    def entries(self, name_text: str | None, gate_text: str | None) -> list[int]:
        """Numbers of the entries named in one text whose gate the other passes, in order."""
        named = self.marks(name_text)
        gate = named if gate_text == name_text else self.marks(gate_text)
        return sorted({i for i, role in named if role == 0 and (i not in self.gated or (i, 1) in gate) and (i, 2) not in gate})


def match_names(rows: DataFrame, name_text: Column, gate_text: Column, entries: DataFrame, out: str = "entries",
                max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """Add ``out``: the numbers of the entries with a message that a row's texts match, in order.

    ``entries`` as :func:`litspark.operators.safety.withdrawal_entries` gives them;
    texts and patterns are compared in lower case. Null texts match nothing.
    """
    def lowered(name: str) -> Column:
        return F.transform(F.col(f"entry.{name}"), F.lower).alias(name)

    table = entries.where("entry.message <> ''").select(F.col("entry.ord").alias("ord"), *map(lowered, ("names", "indication_keywords", "biomarker_keywords")))
    size = F.coalesce(F.size("names"), F.lit(0)) + F.coalesce(F.size("indication_keywords"), F.lit(0)) + F.coalesce(F.size("biomarker_keywords"), F.lit(0))
    n = table.agg(F.sum(size)).first()[0] or 0
    if n > max_patterns:
        raise ValueError(f"{n} patterns; match_entries serves tables beyond {max_patterns}")
    # Checked size.
    names = rows.sparkSession.sparkContext.broadcast(Names(table.collect()))
    columns = [c for c in rows.columns if c != out]
    source = rows.select(F.lower(name_text).alias("_name_text"), F.lower(gate_text).alias("_gate_text"), *columns)
    schema = T.StructType([*(rows.schema[c] for c in columns), T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = names.value
        for batch in batches:
            found = [own.entries(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(found, pa.list_(pa.int64()))], names=[*columns, out])

    return source.mapInArrow(run, schema)


def attribute(records: DataFrame, watch: DataFrame, text: Column, drug: str = "drug", max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """A row per record and watched name that stands in its text as a whole word, with the name in ``drug``.

    Null and blank names are not watched; a name repeated in the list counts once.
    """
    listed = watch.select(F.lower(F.trim(drug)).alias("_w")).where("_w <> ''").distinct()
    n = listed.count()
    if n > max_patterns:
        raise ValueError(f"{n} names; at most {max_patterns}")
    words = sorted(r["_w"] for r in listed.collect())
    columns = [c for c in records.columns if c != drug]
    schema = T.StructType([*(records.schema[c] for c in columns), T.StructField(drug, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()

        def whole(said: str) -> list[str]:
            hits = set()
            for end, word in automaton.iter(said) if words else ():
                start = end - len(word) + 1
                if not (start and said[start - 1].isalnum()) and not said[end + 1:end + 2].isalnum():
                    hits.add(word)
            return sorted(hits)

        for batch in batches:
            found = [whole(said or "") for said in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.string()))], names=[*columns, drug])

    found = records.select(F.lower(text).alias("_watched"), *columns).mapInArrow(run, schema)
    return found.select(*columns, F.explode(drug).alias(drug))


def entry_counts(matched: DataFrame, entries: DataFrame, by: list[str], out: str = "entries") -> DataFrame:
    """How many rows match each entry, with the entry's fields ``by``."""
    found = matched.select(F.explode(out).alias("ord")).groupBy("ord").agg(F.count("*").alias("n"))
    return join_small(found, entries.select("entry.ord", *[F.col(f"entry.{c}").alias(c) for c in by]), ["ord"])
