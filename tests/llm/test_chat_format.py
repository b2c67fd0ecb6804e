import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litspark.llm import chat_format as C

TEXTS = ["", "plain", r"\### Assistant: </turn> ok", "### user: x </turn>\n### a: b </turn>\n", "\\", "#<\\:\n", "a <b> ## é 🙂 "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab:\\#< \n</turn>é", max_size=12), st.text(alphabet="ab:\\#< \n</turn>é", max_size=30)), max_size=5))
def test_round_trip(turns):
    made = [C.format_turn(*t) for t in turns]
    assert C.read_turns("".join(m[0] for m in made)) == turns
    assert [C.unescape(m[0][m[1]:m[2]]) for m in made] == [t for _, t in turns]


RECORDS = [
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"response": None, "prompt": "p"}, [("user", "p"), ("assistant", "")]),
    ({"instruction": "i", "input": "n", "output": "o"}, [("user", "i"), ("user", "n"), ("assistant", "o")]),
    ({"system": "s", "instruction": "i", "output": "o"}, [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"messages": [{"role": "user", "content": "u"}, {"content": "a", "role": "assistant"}]}, [("user", "u"), ("assistant", "a")]),
    ({"messages": [{"author": {"role": "user"}, "content": {"text": "u"}}]}, [("user", "u")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, [("user", "h"), ("assistant", "g")]),
    ({"turns": []}, []), ({"role": "system", "content": None}, [("system", "")]),
]


def test_layouts_by_fingerprint(spark):
    table = C.Layouts()
    # Two layouts share ``messages[]``: empty, it holds no turns under either.
    assert len(table.exact) == len(C.LAYOUTS) + len({m.items for m in C.LAYOUTS if m.items})
    assert C.turns_of({"messages": []}, table) == []
    for record, want in RECORDS:
        assert C.turns_of(record, table) == want
    assert C.turns_of({"unknown": {"a": 1}}, table) is None
    df = spark.createDataFrame([(i, 0, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)], "conv_id long, turn long, record string")
    got = {}
    for r in C.canonical_turns(df).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {i: t for i, (_, t) in enumerate(RECORDS) if t}


FURTHER = [
    ({"id": 7, "prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"system": "s", "prompt": "p", "response": "r", "tags": []}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"messages": [{"role": "user", "name": "n", "content": "u"}, {"role": "assistant", "content": "a"}]}, [("user", "u"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": "u"}, {"role": "tool"}], "tools": [{"x": 1}]}, [("user", "u"), ("tool", "")]),
    ({"messages": [{"role": "user", "content": "u"}, {"role": "user", "content": [{"type": "t"}]}]}, [("user", "u"), ("user", '[{"type": "t"}]')]),
    ({"conversations": [], "id": "x"}, []), ({"question": 5, "answer": None, "k": 1}, [("user", "5"), ("assistant", "")]),
]
UNKNOWN = [{"unknown": {"a": 1}}, {"messages": ["plain", {"role": "user", "content": "u"}]}, {"messages": [None], "id": 1}, {"messages": ["x"]},
           {"messages": [{"role": "user", "content": ["u"]}]}, [], "text", {}]


def test_further_fields_and_rejects(spark):
    """Fields beyond a layout's don't matter; what no layout fits fails the job or is set aside, whole."""
    table = C.Layouts()
    for record, want in FURTHER:
        assert C.turns_of(record, table) == want
    for record in UNKNOWN:
        assert C.turns_of(record, table) is None
    texts = [json.dumps(r) for r, _ in FURTHER] + [json.dumps(r) for r in UNKNOWN] + ["{no json", None]
    df = spark.createDataFrame([(i, 0, t, 1) for i, t in enumerate(texts)], "conv_id long, turn long, record string, place int")
    got = {}
    for r in C.canonical_turns(df, unknown="skip").orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {i: t for i, (_, t) in enumerate(FURTHER) if t}
    bad = {r["conv_id"]: r for r in C.rejected_records(df).collect()}
    assert set(bad) == set(range(len(FURTHER), len(texts))) and bad[len(FURTHER)]["paths"] == ["unknown.a"]
    assert all(bad[i]["record"] == texts[i] for i in bad)
    with pytest.raises(Exception, match="unknown.a"):
        C.canonical_turns(df.where(f"conv_id = {len(FURTHER)}")).collect()


def test_digests(spark):
    rows = [(c, t, ["user", "assistant", "system", None][(c + t) % 4], TEXTS[(c * 3 + t) % len(TEXTS)] or None)
            for c in range(6) for t in range(40 if c == 3 else c)] + [(None, 0, "assistant", "x"), (9, None, "assistant", "l" * 50000)]
    rows += [(9, None, "assistant", "l" * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.digest_formatted(C.format_turns(C.canonical_turns(C.records_of_rows(df)))).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        own = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        learnt = "".join(x for _, r, x in own if r == "assistant")
        assert (found["n_turns"], found["loss_chars"]) == (len(own), len(learnt))
        assert found["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert found["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        assert found["formatted_chars"] == sum(len(C.format_turn(r, x)[0]) for _, r, x in own)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digest_formatted(C.format_turns(C.canonical_turns(C.records_of_rows(df)))).count() == 0
