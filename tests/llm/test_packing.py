import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litspark.llm import packing as P
from litspark.llm.tokens import WordEncoder

TEXTS = ["Hello world, it's 3 o'clock.", None, "", " \t\n", "ÀÉ naïvé Σας ΟΔΟΣ İstanbul", "a<|endoftext|>b <|startoftext|> x",
         "日本語のテキスト 🙂🙂", "x" * 5000, "tab\tnew\nline\x0bv\x0cf\rr\x1du", "we're they'll 's 't", " nbsp em", "a" * 70 + " b", "''s don't ''t 5'd x'll  “quote”—dash… 12.5³ ½ ª º ß ÿ Ÿ é", "<|endoftext|>", "a.b,c;d (e) [f] #g @h http://x.y/z?q=1&r=2"]


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, P.END_ID]


def test_words_encode_like_whole_texts(encode):
    encoder = WordEncoder(P.TOKENIZER)
    for _ in range(2):
        ids, ends = encoder.encode(pa.array(TEXTS), P.END_ID)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [encode(t) for t in TEXTS]
    import duckdb
    real = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    ids, ends = encoder.encode(pa.array(real), P.END_ID)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [encode(t) for t in real]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 900), min_size=1, max_size=9), st.sampled_from([1, 3, 64]), st.sampled_from([8, 100]))
def test_schedule_is_one_order(totals, quantum, length):
    plan = P.Schedule(totals, length, quantum)
    order = sorted(((i // quantum + 0.5) * quantum / t, s, i) for s, t in enumerate(totals) for i in range(t))
    want = {(s, i): k for k, (_, s, i) in enumerate(order)}
    s, i = (np.array(x) for x in zip(*want))
    assert plan.rank(s, i).tolist() == list(want.values())
    windows = np.arange(len(order) // length + 2)
    given_, total = plan.given(windows), sum(totals)
    for w, row in zip(windows, given_):
        x = min(w * length, total)
        assert row.tolist() == [sum(1 for _, t, _ in order[:x] if t == s) for s in range(len(totals))]
        # Deficits stay below a quantum and a half.
        assert all(abs(g - x * t / total) <= 1.5 * quantum + 1 for g, t in zip(row, totals)) or quantum * len(totals) > total


def check(rows, docs, encode, length):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {d[0] for d in docs}
    for i, text, _ in docs:
        ids, at = encode(text), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], dtype="<u4").tobytes())
            assert r["ids"] == ids[at:at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    for k, own in by_seq.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or k == max(by_seq)


def test_pack(spark, encode):
    docs = [(i, TEXTS[i % len(TEXTS)] and TEXTS[i % len(TEXTS)] * (1 + i % 5), ["a", "a", "b", None][i % 4]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5).selectExpr("*", "1 as start", "2 as ids")
    rows = P.pack(df, length=512, with_ids=True).collect()
    check(rows, docs, encode, 512)
    share = {}
    of = {i: s for i, _, s in docs}
    for r in rows:
        if r["sequence_id"] < max(x["sequence_id"] for x in rows):
            share.setdefault(r["sequence_id"], {}).setdefault(of[r["doc_id"]], 0)
            share[r["sequence_id"]][of[r["doc_id"]]] += r["length"]
    total = {}
    for r in rows:
        total[of[r["doc_id"]]] = total.get(of[r["doc_id"]], 0) + r["length"]
    for window in share.values():
        for s, n in total.items():
            assert abs(window.get(s, 0) - 512 * n / sum(total.values())) <= 2 * P.QUANTUM


def test_any_number_of_sources(spark, encode, monkeypatch):
    monkeypatch.setattr(P, "RANGE_TOKENS", 3_000)
    monkeypatch.setattr(P, "CELLS", 200)
    docs = [(s * 10 + k, f"word {k} of " * (1 + k), f"src{s}" if s else None) for s in range(2_000) for k in range(3 if s % 3 else 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    rows = P.pack(df, length=1024, with_ids=True, max_queues=20).collect()
    check(rows, docs, encode, 1024)
    last = max(r["sequence_id"] for r in rows)
    of = {i: s for i, _, s in docs}
    # Every window holds its share of small sources, and they are spread: one half of them is half in each half of the windows.
    counts = {}
    for r in rows:
        counts.setdefault(r["sequence_id"], set()).add(of[r["doc_id"]])
    assert min(len(counts[w]) for w in range(last)) > 40
    early = sum(r["length"] for r in rows if r["sequence_id"] < last / 2 and (of[r["doc_id"]] or "src0") < "src5")
    late = sum(r["length"] for r in rows if r["sequence_id"] >= last / 2 and (of[r["doc_id"]] or "src0") < "src5")
    assert 0.8 < early / late < 1.25


def test_a_very_long_text(spark, encode):
    docs = [(1, "long text here " * 60_000, "a"), (2, "b c", "b"), (3, "x y z " * 900, None)]
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), length=256, with_ids=True).collect()
    check(rows, docs, encode, 256)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s")] * 9 + [(None, None, None)], "doc_id long, text string, source string")
    assert sum(r["length"] for r in P.pack(df).collect()) == 9 * 3 + 1
    assert P.pack(df.limit(0)).count() == 0


def test_texts_reach_the_encoder_in_batches_of_few_bytes(spark, monkeypatch):
    """A batch of many long texts is never whole in a task; the setting is as before afterwards."""
    seen, real = spark.sparkContext.accumulator(0), P.slabs

    def watched(column, size):
        seen.add(int(column.nbytes > 2 * size))
        return real(column, size)

    monkeypatch.setattr(P, "SLAB_BYTES", 100_000)
    monkeypatch.setattr(P, "slabs", watched)
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text", "'s' AS source")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    got = P.pack(docs).agg({"length": "sum"}).first()[0]
    assert got == 300 * 1001 and seen.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
