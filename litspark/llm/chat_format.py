"""Chat formatting: records of any known layout become canonical turns, chosen by a fingerprint of their schema.

A record's fingerprint is the hash of its sorted nested field paths (array
items share one path). It selects a declarative mapping: where the turns lie and
which fields hold role and text. A record with further fields takes the mapping
with most paths among those whose paths it has all of, the first on a tie. Turns then stream, in order, through a template
that marks them and escapes its control signs inside texts, so that the output
can be read back. One shuffle by conversation; state is a few numbers, so a
conversation of any length streams through its task.

Null roles and texts are empty. Turns go by ``turn``, nulls first; rows that
agree in it by place in their record, role and text. A null conversation id is a
conversation of its own. Values that are no text are written as JSON. A record no
mapping fits, that is no JSON or whose list of turns holds other things than
objects raises an error that names its paths or, with ``unknown="skip"``, is left
to :func:`rejected_records`. Further columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of the leaves: ``messages[].role``."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(names: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """``fields``: (role, path) in order, for layouts with a field per turn; or ``items`` with ``role`` and ``text`` inside."""

    fields: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""

    def paths(self) -> set[str]:
        inner = f"{self.items}." if self.items else ""
        return {p for _, p in self.fields} or {inner + self.role, inner + self.text}


#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = tuple(Mapping(fields=f) for f in (
    (("user", "prompt"), ("assistant", "response")),
    (("user", "prompt"), ("assistant", "completion")),
    (("user", "question"), ("assistant", "answer")),
    (("system", "system"), ("user", "prompt"), ("assistant", "response")),
    (("user", "instruction"), ("assistant", "output")),
    (("user", "instruction"), ("user", "input"), ("assistant", "output")),
    (("system", "system"), ("user", "instruction"), ("assistant", "output")),
)) + (
    Mapping(items="messages[]", role="role", text="content"),
    Mapping(items="messages[]", role="author.role", text="content.text"),
    Mapping(items="conversations[]", role="from", text="value"),
    Mapping(items="turns[]", role="speaker", text="text"),
    Mapping(role="role", text="content"),
    Mapping(role="message.role", text="message.content"),
    Mapping(role="from", text="value"),
)


#: Layouts of other records a task remembers.
REMEMBERED = 10_000


def by_fingerprint(layouts=LAYOUTS) -> dict[str, Mapping]:
    table = {fingerprint(m.paths()): m for m in layouts}
    # A list of turns may be empty: no turns, whichever layout its items would have.
    return table | {fingerprint({m.items}): m for m in layouts if m.items}


class Layouts:
    """The mappings by fingerprint, and what fitted records with further fields."""

    def __init__(self, layouts=LAYOUTS) -> None:
        self.exact = by_fingerprint(layouts)
        self.parts = [(m.paths(), m) for m in layouts] + [({m.items}, m) for m in layouts if m.items]
        self.seen: dict[frozenset[str], Mapping | None] = {}

    def of(self, found: set[str]) -> Mapping | None:
        key = frozenset(found)
        if key not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[key] = self.exact.get(fingerprint(found)) or self._largest(found)
        return self.seen[key]

    def _largest(self, found: set[str]) -> Mapping | None:
        # A path that ends at the list itself is an empty list or an item that is no object.
        fits = [(len(p), m) for p, m in self.parts if p <= found and (p == {m.items} or m.items not in found)]
        best = max(fits, key=lambda f: f[0], default=None)
        if best is None or (best[1].items in found and any(p.startswith(f"{best[1].items}.") for p in found)):
            return None
        return best[1]


def _get(value, path: str):
    for name in path.removesuffix("[]").split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def turns_of(record, table: Layouts) -> list[tuple[str, str]] | None:
    """Canonical (role, text) turns of one record, None where no mapping fits."""
    mapping = table.of(paths(record))
    if mapping is None:
        return None
    if mapping.fields:
        return [(role, _text(_get(record, path))) for role, path in mapping.fields]
    items = (_get(record, mapping.items) or []) if mapping.items else [record]
    if not all(isinstance(x, dict) for x in items):
        return None
    return [(ROLES.get(r := _text(_get(x, mapping.role)), r), _text(_get(x, mapping.text))) for x in items]


def _parsed(text: str | None):
    """The record, or an empty list, which no mapping fits, where the text is no JSON."""
    try:
        return json.loads(text) if text is not None else []
    except ValueError:
        return []


TURNS = "conv_id long, turn long, place int, role string, text string"


def canonical_turns(records: DataFrame, layouts=LAYOUTS, unknown: str = "raise") -> DataFrame:
    """``records(conv_id, turn, record)``, the last a JSON text, as ``conv_id, turn, place, role, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Layouts(layouts)
        for batch in batches:
            out = []
            for conv, turn, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns = turns_of(record := _parsed(text), table)
                if turns is None and unknown == "raise":
                    raise ValueError(f"no mapping for a record with the paths {sorted(paths(record))}")
                out += [(conv, turn, k, role, said) for k, (role, said) in enumerate(turns or [])]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["conv_id", "turn", "place", "role", "text"])

    return records.select("conv_id", "turn", "record").mapInArrow(run, TURNS)


def rejected_records(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """The records that ``canonical_turns(…, unknown="skip")`` leaves out, with their ``fingerprint`` and sorted ``paths``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Layouts(layouts)
        for batch in batches:
            out = [(*row, fingerprint(found := paths(record)), sorted(found)) for row in zip(*(batch.column(i).to_pylist() for i in range(3)))
                   if turns_of(record := _parsed(row[2]), table) is None]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())))], names=["conv_id", "turn", "record", "fingerprint", "paths"])

    return records.select("conv_id", "turn", "record").mapInArrow(
        run, "conv_id long, turn long, record string, fingerprint string, paths array<string>")


HEAD, BREAK, END = "### ", ": ", " </turn>\n"
LEARNT = "assistant"
_CONTROL, _IN_ROLE, _ESCAPED = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]"), re.compile(r"\\(.)", re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and the span of its text in it."""
    head = HEAD + _IN_ROLE.sub(r"\\\g<0>", role) + BREAK
    body = _CONTROL.sub(r"\\\g<0>", text)
    return head + body + END, len(head), len(head) + len(body)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the marked turns, read back."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


FORMATTED = "conv_id long, formatted string, loss_start long, loss_end long"


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn, in order inside each conversation: its part of the output and the loss span within.

    The span is null where nothing is learnt. Partitioned by conversation.
    """
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = (batch.column(i).to_pylist() for i in (3, 4))
            made = [format_turn(r or "", t or "") for r, t in zip(roles, texts)]
            spans = [(a, b) if r == LEARNT else (None, None) for r, (_, a, b) in zip(roles, made)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()),
                 pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())],
                names=["conv_id", "formatted", "loss_start", "loss_end"])

    return ordered.mapInArrow(run, FORMATTED)


class _Digest:
    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Per conversation: digests of what is read back from the ordered output; rows must come as ``format_turns`` gives them."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for conv, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, digest))
                    now, digest = conv, _Digest()
                for role, said in read_turns(text):
                    digest.turns += 1
                    digest.said.update(f"{role}\n{said}\n".encode())
                digest.chars += len(text)
                if a is not None:
                    learnt = unescape(text[a:b])
                    digest.loss_chars += len(learnt)
                    digest.loss.update(learnt.encode())
            if done:
                yield _batch(done, names)
        if digest is not None:
            yield _batch([(now, digest)], names)

    return formatted.mapInArrow(run, schema)


def _batch(done: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*((c, d.turns, d.said.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars) for c, d in done))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def records_of_rows(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as JSON records, in three message layouts by role."""
    text, role = F.coalesce("text", F.lit("")).alias("content"), F.coalesce("role", F.lit(""))
    flat = F.to_json(F.struct(role.alias("role"), text))
    nested = F.to_json(F.struct(F.struct(role.alias("role"), text).alias("message")))
    named = F.to_json(F.struct(F.lit("gpt").alias("from"), F.coalesce("text", F.lit("")).alias("value")))
    return rows.select("conv_id", "turn", F.when(F.col("role") == "assistant", named).when(
        F.col("role") == "user", nested).otherwise(flat).alias("record"))
