import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litspark.llm import quality_rules as Q
from tests.oracle import difference

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCE = "The quick brown fox jumps over the lazy dog near the old river bank today."


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed)


@pytest.fixture(scope="module")
def run(spark):
    def go(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [tuple(r) for r in Q.judge_lines(df).orderBy("doc_id").select(
            *Q.BASE, "base_failed", "kept", "cleaned").collect()]
    return go


CASES = [None, "", " \n\t ", "one", "é ü x y", "a b c d e a b c d e a b", "x\n\nx\nx \n x", "\n", "tail\n",
         " ".join(["w"] * 500), SENTENCE, f"{SENTENCE}\n{SENTENCE}", "word " * 30000, "日本 語。 " * 4, "#*$%&|<> " * 20,
         f"Home | About | Contact\n{SENTENCE} {SENTENCE.upper()}", "a\x0bb\x0cc\x1dd e\x85f"]


def test_base_matches_brute_force(run):
    got = run(CASES)
    assert [g[:6] for g in got] == [brute(t) for t in CASES]
    assert all(not (g[5] and g[6]) for g in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.|é#", max_size=60), min_size=1, max_size=8))
def test_slab_matches_brute_force(texts):
    import pyarrow as pa

    from litspark.llm import words as W
    for at, data, offsets in W.slabs(pa.array(texts), 40):
        out, cleaned = Q._judge(data, offsets)
        for i in range(len(offsets) - 1):
            got = tuple(out[n][i] for n in Q.BASE) + (out["base_failed"][i],)
            assert got == brute(texts[at + i])
            assert len(cleaned[i].decode()) <= len(texts[at + i])


def test_lines_go_before_documents(run):
    body = "\n".join(f"{SENTENCE[:-1]} number {i} of many." for i in "one two three four five six".split())
    body = body.replace("quick", "calm", 1)
    nav, notice = "Home | About | News | Contact", "All rights reserved."
    distinct = ("Rivers carve their valleys slowly over thousands of patient years.\n"
                "Farmers upstream watch each flood with worry and some hope.\nBoats return at dusk with lights along the mole.")
    got = run([f"{nav}\n{distinct}\n{notice}", f"{distinct}\nmenu " + "item | " * 40, distinct, f"{notice}\n" * 12])
    assert got[0][6:] == (True, distinct + "\n")
    assert got[1][6] is False
    assert got[2][6:] == (True, distinct)
    assert got[3][6] is False and got[3][7] == ""


def test_a_text_of_notices_goes(run):
    lines = [f"Copy number {i} of this page, all rights reserved." for i in range(200)]
    rest = ("Rivers carve their valleys slowly over thousands of patient years.\nFarmers upstream watch each flood with worry and some hope.\n"
            "Boats return at dusk with lights along the mole.")
    got = run(["\n".join([*lines, SENTENCE]), f"{rest}\n{lines[0]}"])
    assert got[0][6] is False
    assert got[1][6] is True and "reserved" not in got[1][7]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, SENTENCE, "mine", 7)], "doc_id long, text string, kept string, n_words int")
    out = Q.judge_lines(df)
    assert out.columns.count("kept") == 1 and dict(out.dtypes)["kept"] == "boolean"
    assert out.first()["kept"] is True
    assert Q.judge_lines(df.limit(0)).count() == 0
    assert "text" not in Q.judge_lines(df, cleaned=None).columns


def test_sql_gives_the_same(spark):
    good = "A plain sentence of quite some length that ends as it should, without a doubt."
    lines = [good, good, "Home | News | About", "NO ONE SHOUTS LIKE THAT HERE.", "All Rights Reserved.", "no end", "Ende» ", "句子。", "Quoted.”\t",
             "## $$ %% x.", "", " \t", "a | b c d e f.", "see our Privacy Policy " + "word " * 18 + ".", "it's", "(so)", "[x]", "{y}", "what؟", "\x0bx\x0c."]
    rows = [(i, "\n".join(lines[(i * k + k * k) % len(lines)] for k in range(i % 9)) + ("\n" if i % 4 == 0 else "")) for i in range(150)]
    rows += [(1000 + 4 * k + i, f"{good}\n" * i + x) for i in range(4) for k, x in enumerate(lines)] + [(2000, None), (2001, ""), (2002, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert difference(Q.judge_lines(df, cleaned=None), con, Q.oracle()) is None
