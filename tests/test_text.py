import re
import uuid

import pytest
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions import chunks as C
from litspark.functions import citations as cite
from litspark.functions import judges as J
from litspark.functions import records as R
from litspark.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("heading,label", [
    ("Materials and Methods", "methods"), ("Outcomes in patients", "methods"), ("Summary of findings", "abstract"),
    ("Methodological limits", "methods"), ("Clinical outcomes", "results"), ("Concluding remarks", "conclusion"),
    ("Funding", "_skip"), ("Something else", "other"), ("", "other"), (None, "other"), ("REFERENCES", "_skip"),
])
def test_section_labels(spark, heading, label):
    assert one(spark, X.section_label(F.lit(heading).cast("string"))) == label


def test_nested_labels(spark):
    def label(*path):
        return one(spark, X.inherit_label(F.array(*map(F.lit, path))))

    assert label("methods", "other") == "methods"
    assert label("methods", "_skip", "results") == "_skip"
    assert label("methods", "other", "results") == "results"
    assert label("other", "other") == "other"


@pytest.mark.parametrize("raw,clean", [
    ("a [1] b", "a b"), ("a[1,2]b [1-3] [1–3]", "ab"), ("a [1, 2]", "a [1, 2]"), ("  x \n y ", "x y"), ("[a]", "[a]"),
])
def test_clean_markup(spark, raw, clean):
    assert one(spark, X.clean_markup(F.lit(raw))) == clean


def test_words_follow_unicode_whitespace(spark):
    raw = " a b\x1cc　d  e\n"
    assert one(spark, X.words(F.lit(raw))) == raw.split()
    assert one(spark, X.words(F.lit("   "))) == []


def test_tokens(spark):
    raw = "The P53_x-gene, día №5 — CO₂!"
    assert one(spark, X.tokens(F.lit(raw))) == re.sub(r"[^\w\s]", " ", raw.lower()).split()


def test_topics(spark):
    got = [one(spark, X.normalise_topic(F.lit(t))) for t in (" RCC ", "Prostate", "lung", "")]
    assert got == ["kidney", "prostate", None, None]
    with pytest.raises(Exception, match="unsupported topic"):
        one(spark, X.require_topic(F.lit("lung")))


def test_embedding_text(spark):
    def text(title, section, prefix):
        return one(spark, X.embedding_text(F.lit("t"), F.lit(title).cast("string"), F.lit(section).cast("string"),
                                           F.lit(prefix).cast("string")))

    assert text("A", "methods", "ctx") == "ctx\nt"
    assert text("A", None, "") == "A | \nt"
    assert text(None, "", None) == "t"


def test_point_ids(spark):
    key = "PMC1_résults_0"
    assert one(spark, C.point_id_v5(F.lit(key))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, key))
    import hashlib

    assert one(spark, C.point_id(F.lit(key))) == str(uuid.UUID(bytes=hashlib.md5(key.encode()).digest()))


def _windows(words, size=200, overlap=30):
    out, at = [], 0
    while True:
        out.append(" ".join(words[at:at + size]))
        if at + size >= len(words):
            return out
        at += size - overlap


def _expected(kind, words):
    n = len(words)
    if n == 0:
        return []
    if kind == "table":
        return [" ".join(words[:500]) + " " + K.TABLE_NOTE if n > 500 else " ".join(words)]
    if kind == "figure_caption" or 30 <= n <= 80:
        return [" ".join(words)]
    return [] if n < 30 else _windows(words)


def test_chunk_boundaries(spark):
    sizes = [0, 1, 29, 30, 80, 81, 199, 200, 201, 369, 370, 371, 540, 541, 1200]
    rows = [(kind, n, " ".join(f"w{i}" for i in range(n)))
            for kind in ("text", "table", "figure_caption") for n in [*sizes, 500, 501]]
    df = spark.createDataFrame(rows, "kind string, n int, content string")
    section = F.array(F.struct(F.lit("results").alias("name"), F.col("content"), F.col("kind").alias("section_type")))
    both = df.select("kind", "n", "content", C.paper_chunks(section, table_cap=500).alias("c"), C.paper_chunks(section).alias("whole"))
    for r in both.collect():
        assert [c["text"] for c in r["c"]] == _expected(r["kind"], r["content"].split()), (r["kind"], r["n"])
        # Without a cap no word of a long table is lost.
        if r["kind"] == "table" and r["n"] > 500:
            assert [c["text"] for c in r["whole"]] == _windows(r["content"].split())


def test_legacy_windows_keep_the_trailing_overlap(spark):
    for n in (1, 200, 201, 340, 341, 371, 700):
        words = [f"w{i}" for i in range(n)]
        want = [" ".join(words)] if n <= 200 else [" ".join(words[i:i + 200]) for i in range(0, n, 170)]
        section = F.array(F.struct(F.lit("S").alias("section_name"), F.lit(" ".join(words)).alias("content")))
        got = one(spark, C.legacy_section_chunks(section))
        assert [c["text"] for c in got] == want
        assert {c["total_chunks"] for c in got} == {len(want)}


def test_citation_cleanup(spark):
    text = "A [Doc 1] b [doc 7][Doc 07] c [Doc  3] [Doc 99999999999999999999]."
    assert one(spark, cite.strip_invalid_tags(F.lit(text), F.lit(2))) == "A [Doc 1] b c [Doc  3]."
    assert one(spark, cite.hallucinated(F.lit("x [Doc 9] [Doc 3] [Doc 9] [Doc 1]"), F.lit(2))) == [3, 9]
    assert one(spark, cite.cited_loose(F.lit("[Doc3] [doc  1]"))) == [3, 1]
    assert one(spark, cite.removed_notice(F.lit("a"), F.array(F.lit(3), F.lit(9)))).startswith(
        "WARNING: The following answer contained hallucinated citations ([Doc 3, 9]) that were removed.\n\na")


def test_source_line(spark):
    def line(authors, year, journal, title, design, n):
        return one(spark, cite.source_line(
            F.lit(2), F.array(*map(F.lit, authors)).cast("array<string>"), F.lit(year).cast("int"), F.lit(journal).cast("string"),
            F.lit(title).cast("string"), F.lit(design).cast("string"), F.lit(n).cast("int")))

    assert line(["Doe Jane", "X"], 2020, "Eur Urol", "T", "rct", 120) == "[Doc 2] Doe et al. 2020 Eur Urol (rct, n=120)"
    assert line([], None, "", "Title", None, None) == "[Doc 2] Title"
    assert line([], None, None, "", "", 0) == "[Doc 2] Unknown source"


def test_judge_rounding_is_half_even_on_exact_ties(spark):
    question = " ".join("term" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(32))
    got = one(spark, J.answer_relevance(F.lit(question), F.lit(question.split()[0])))
    assert got == round(1 / 32, 4) == 0.0312


def test_judges_without_evidence(spark):
    none = F.array().cast("array<struct<text:string,evidence_level:int>>")
    m = J.all_metrics(F.lit("of the"), F.lit("You should take 5 mg. must take. prescribe 3 mg"), none, F.lit(None).cast("string"))
    got = spark.range(1).select(*[c.alias(n) for n, c in m.items()]).first().asDict()
    assert got == {"faithfulness": 0.85, "answer_relevance": 1.0, "context_precision": 0.0, "context_recall": 1.0,
                   "clinical_safety": 0.0, "citation_accuracy": 1.0, "evidence_appropriate": 1.0}


def test_records(spark):
    assert [one(spark, R.month_of(F.lit(d))) for d in ("20210305", "2021-03-05", "2021", "20211399")] == [
        "2021-03", "2021-03", "2021", "2021139"]
    assert one(spark, R.comorbidity_map(F.lit("a: 1\nb:\n: x\nno\na: 2"))) == {"a": "2", "b": "yes"}
    assert one(spark, R.fenced_json_map(F.lit('```json\n{"A": "x"}\n```'))) == {"A": "x"}
    assert one(spark, R.fenced_json_map(F.lit("nope"))) == {}
    assert one(spark, R.payload_json(F.struct(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b")))) == '{"a":1}'
    bad = one(spark, R.extraction(F.lit("{broken"), F.lit("abstract")))
    assert bad["extraction_failed"] and bad["study_design"] == "unknown"
    good = one(spark, R.extraction(F.lit('{"study_design":"rct","sample_size":12,"primary_outcome":" x "}'), F.lit("abstract")))
    assert (good["study_design"], good["sample_size"], good["primary_outcome"], good["extraction_failed"]) == ("rct", 12, "x", False)
