import json
import os
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from litspark.sources import formats, html, jats, records, tables

PAPER = """<article><front><journal-title>J Urol</journal-title><article-id pub-id-type="pmc">PMC42</article-id>
<article-id pub-id-type="pmid"> 7 </article-id><article-title>CO<sub>2</sub> in <i>mice</i> [1]</article-title>
<contrib contrib-type="author"><name><surname>Doe</surname><given-names>J A</given-names></name></contrib>
<contrib contrib-type="author"><name><given-names>Nameless</given-names></name></contrib>
<pub-date pub-type="epub"/><pub-date pub-type="ppub"><year>2019</year></pub-date>
<abstract><p>Short abstract.</p></abstract></front>
<body><p>stray</p><sec><title>Patients and Methods</title><p>First [2,3] para.</p><p> </p><p>Second.</p>
<list><list-item><p>age</p></list-item><list-item><p>sex</p></list-item></list>
<table-wrap><label>Table 1</label><caption><p>Base</p></caption><table><thead><tr><th>A</th><th>B</th></tr></thead>
<tbody><tr><td>1</td><td/></tr><tr><td/><td/></tr></tbody></table></table-wrap>
<fig><label>Fig 1</label><caption><p>Curve</p></caption></fig>
<sec><title>Cohort</title><p>Inner.</p></sec><sec><title>Results of it</title><p>Inner result.</p></sec></sec>
<sec><title>Funding</title><p>Money.</p><sec><title>Results</title><p>hidden</p></sec></sec></body></article>"""


def test_jats(spark):
    docs = spark.createDataFrame([("a", PAPER), ("b", "<broken"), ("c", "<article><body/></article>"),
                                  ("d", "<article><front><article-title> </article-title></front></article>"), ("e", None)],
                                 "doc_key string, xml string")
    [p] = jats.parse_papers(docs).collect()
    assert (p["paper_key"], p["pmid"], p["title"], p["year"], p["authors"]) == ("42", "7", "CO 2 in mice", 2019, ["Doe J A"])
    got = [(s["name"], s["raw_name"], s["section_type"], s["content"]) for s in p["sections"]]
    pm = "Patients and Methods"
    assert got == [
        ("abstract", "Abstract", "text", "Short abstract."),
        ("methods", pm, "text", "First para. Second. age; sex"),
        ("methods", pm, "table", "[Table 1]\nBase\nA | B\n1 | "),
        ("methods", pm, "figure_caption", "Fig 1: Curve"),
        ("methods", "Cohort", "text", "Inner."),
        ("results", "Results of it", "text", "Inner result."),
    ]


def test_xml_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(PAPER)
    assert jats.parse_papers(jats.read_xml_files(spark, str(tmp_path))).count() == 1


def _visible(page):
    """Brute force: one depth over all skipped tags, any of their ends lowers it."""
    events = []

    class Log(HTMLParser):
        handle_starttag = lambda self, t, a: events.append(("s", t))
        handle_endtag = lambda self, t: events.append(("e", t))
        handle_data = lambda self, d: events.append(("d", d))

    Log().feed(page)
    depth, out = 0, []
    for kind, value in events:
        if kind == "d":
            if depth == 0 and value.strip():
                out.append(value.strip())
        elif value in ("script", "style", "nav", "footer", "head", "noscript"):
            depth = depth + 1 if kind == "s" else max(depth - 1, 0)
    return " ".join(out)


def test_html_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    extra = spark.createDataFrame([(-1, "u", "<nav>a</script>b</nav>c<p>d</p>"), (-2, "u", None),
        (-3, "u", "<p>a &lt;b&gt; &amp;lt; &#233;&#xe9; &quot;q&quot;</p><!-- <nav> -->x<NAV class='a>b'>y</NAV>z<nav/>w"),
        (-4, "u", "<header>h</header><script>if (a<b) '<nav>'</script>t<style>u</style >v<footer>f<nav>g</footer>h</nav>i  < j"),
        (-5, "u", "a<head>b"), (-6, "u", "a<script>b"), (-7, "u", "a<b title=\"x>y\">c</b>\u00a0<i>\u00a0 </i>d")], pages.schema)
    every = pages.unionByName(extra)
    raw = {r["page_id"]: r["html"] for r in every.collect()}
    got = {r["page_id"]: r["text"] for r in html.page_texts(every).collect()}
    assert got == {k: _visible(v or "") for k, v in raw.items()}
    assert max(len(t) for t in got.values()) > 0


def test_html_long_and_odd_pages(spark):
    """Long texts after a stray <, very long tags, and numbers that are no characters."""
    words = " ".join(f"word{i}" for i in range(60_000))
    odd = [0, 1, 9, 11, 13, 31, 127, 128, 129, 153, 159, 160, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFEFF, 0xFFFD, 0xFFFE, 0x1F600,
           0x1FFFF, 0x10FFFF, 0x110000, 9_999_999, 99_999_999, 10**30]
    refs = " ".join(f"a&#{n};b&#x{n:X};c&#00{n} &#X0{n:x}g" for n in odd)
    raw = {1: f"a<y {words}>b", 2: f"a<b title='{words}'>c</b>d", 3: f"<p>{refs}</p>", 4: f"a<y {words} <p>b</p>c", 5: "a \ue000 b",
           6: "&#38;lt; &amp;#60; &#; &#x; &;"}
    open_ = f"a <y {words}"
    df = spark.createDataFrame([(k, "u", v) for k, v in {**raw, 7: open_}.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.page_texts(df).collect()}
    assert got.pop(7) == open_
    assert got == {k: _visible(v + "<i>") for k, v in raw.items()}


def test_html_names(spark):
    """Every name of HTML5, with and without its semicolon and with letters after it."""
    bare = sorted({n.rstrip(";") for n in html5})
    raw = {i: f"<p>x&{n};y &{n} z&{n}q; &{n}2&{n}=</p>" for i, n in enumerate(bare)}
    raw |= {-1: "caf&eacute; &Uuml;ber fa&ccedilade 5&euro;&nbsp;&notit; &noname; &amp;eacute; &am<b>p;</b>", -2: "&" + "a" * 40 + ";"}
    df = spark.createDataFrame([(k, "u", v) for k, v in raw.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.page_texts(df).collect()}
    assert got == {k: _visible(v + "<i>") for k, v in raw.items()}


def test_reference_tables(spark, tmp_path):
    entries = [{"drug": "a", "aliases": ["b"], "warning": "w"}, {"drug": "c", "source": "manual"}]
    (tmp_path / "wrapped.json").write_text(json.dumps({"last_updated": "x", "entries": entries}))
    (tmp_path / "bare.json").write_text(json.dumps(entries, indent=1))
    (tmp_path / "bad.json").write_text("{nope")
    for name, want in (("wrapped", ["a", "c"]), ("bare", ["a", "c"]), ("bad", []), ("absent", [])):
        got = tables.read_reference(spark, str(tmp_path / f"{name}.json")).orderBy("ord").collect()
        assert [r["drug"] for r in got] == want, name
    tables.write_reference(tables.read_reference(spark, str(tmp_path / "bare.json")), str(tmp_path / "out"))
    assert "last_updated" in spark.read.json(str(tmp_path / "out")).columns


def test_golden_set(spark, tmp_path):
    items = [{"id": "G009", "query": "", "question": "q1", "topic": "kidney"}, {"id": "x", "query": "q2", "cancer_type": "bladder"}]
    (tmp_path / "g.json").write_text(json.dumps({"version": "2.0", "queries": items}))
    g = tables.read_golden(spark, str(tmp_path / "g.json"))
    assert {(r["query"], r["cancer_type"], r["difficulty"], r["version"]) for r in g.collect()} == {
        ("q1", "kidney", "medium", "2.0"), ("q2", "bladder", "medium", "2.0")}
    new = spark.createDataFrame([(None, "n1", 5), ("keep", "n2", 1), ("", "n3", 200_001)], "id string, query string, seq long")
    have = g.select("id", "query")
    assert {(r["id"], r["query"]) for r in tables.append_golden(have, new).collect()} == {
        ("G009", "q1"), ("x", "q2"), ("keep", "n2"), ("G010", "n1"), ("G011", "n3")}


def test_legacy_papers_take_the_topic_from_the_file(spark, tmp_path):
    paper = {"pmc_id": "1", "title": "t", "year": "2020", "sections": [{"section_name": "A", "content": "x"}]}
    (tmp_path / "kidney_fulltext.json").write_text(json.dumps([paper], indent=1))
    [p] = tables.read_legacy_papers(spark, str(tmp_path / "*.json")).collect()
    assert (p["topic"], p["year"], p["sections"][0]["content"]) == ("kidney", "2020", "x")


def test_chunk_sink_and_audit_append(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "p1", "kidney", 2020), ("c2", "p2", "bladder", None)],
                                 "chunk_id string, paper_key string, topic string, year int")
    tables.write_chunks(rows, str(tmp_path / "c"))
    assert tables.read_chunks(spark, str(tmp_path / "c")).where("topic = 'kidney'").count() == 1
    log = rows.withColumn("timestamp", F.current_timestamp())
    records.append_by_day(log, str(tmp_path / "a"))
    records.append_by_day(log, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4


def test_external_evidence(spark):
    rows = spark.createDataFrame([("q", 1, 5, "T", "A", "2020"), ("q", 2, 6, "T", "", "x"), ("r", 1, 7, None, "B", "n.d.")],
                                 "query_id string, rank int, pmid long, title string, abstract string, year string")
    got = {r["chunk_id"]: r for r in records.external_evidence(rows).collect()}
    assert set(got) == {"pubmed:5", "pubmed:7"}
    assert got["pubmed:5"]["text"] == "T\n\nA" and got["pubmed:7"]["year"] is None and got["pubmed:7"]["relevance_score"] == 0.45


def test_jats_format_packs_files_by_bytes(spark, tmp_path):
    formats.register(spark)
    docs = spark.createDataFrame([(f"p{i}", "é" * i + "\r\n" + PAPER) for i in range(40)] + [("none", None)], "doc_key string, xml string")
    formats.write_xml_files(docs, str(tmp_path))
    (tmp_path / ".half.xml").write_text("<")
    (tmp_path / "_old").mkdir()
    (tmp_path / "_old" / "x.xml").write_text("<")
    read = spark.read.format("jats").option("partitionBytes", 3 * len(PAPER)).load(str(tmp_path))
    got = {os.path.basename(r["doc_key"])[:-4]: r["xml"] for r in read.collect()}
    assert got == {r["doc_key"]: r["xml"] for r in docs.where("xml is not null").collect()}
    assert read.rdd.getNumPartitions() > 10
    assert [p.paths for p in formats.packed([("a", 5), ("b", 5), ("c", 99), ("d", 1)], 10)] == [("a", "b"), ("c",), ("d",)]


def test_jats_format_of_an_empty_folder_and_remote_paths(spark, tmp_path):
    formats.register(spark)
    assert spark.read.format("jats").load(str(tmp_path)).count() == 0
    assert formats.local_path("file:///a%20b/c") == "/a b/c"
    with pytest.raises(ValueError):
        formats.local_path("s3://bucket/papers")


def test_jats_stream_reads_each_file_once(spark, tmp_path):
    formats.register(spark)
    land, out, mark = (tmp_path / n for n in ("land", "out", "mark"))
    land.mkdir()

    def drain():
        spark.readStream.format("jats").option("ledger", str(tmp_path / "ledger")).load(str(land)).writeStream.format("parquet").option(
            "path", str(out)).option("checkpointLocation", str(mark)).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["xml"] for r in spark.read.schema("xml string").parquet(str(out)).collect())

    (land / "m.xml").write_text("one")
    assert drain() == ["one"]
    assert drain() == ["one"]
    (land / "a.xml").write_text("two")  # sorts before what was read, and is older
    os.utime(land / "a.xml", (1, 1))
    assert drain() == ["one", "two"]


def test_report_writer_leaves_nothing_of_a_failed_job(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(0, 50, 1, 5).select("id", F.named_struct(F.lit("a"), F.array("id")).alias("s"))
    formats.write_report(rows, path, "r1")
    first = sorted(os.listdir(tmp_path / "r1"))
    failing = rows.select(F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"), "s")
    for run in ("r1", "r2"):
        with pytest.raises(Exception, match="lost"):
            formats.write_report(failing, path, run)
    assert sorted(os.listdir(tmp_path)) == ["latest.json", "r1"] and sorted(os.listdir(tmp_path / "r1")) == first
    assert json.loads((tmp_path / "latest.json").read_text())["rows"] == 50
    assert spark.read.json(f"{path}/r1/part-*.json").agg(F.sum("id"), F.sum(F.col("s.a")[0])).first() == (1225, 1225)
    formats.write_report(rows.limit(3), path, "r1")
    assert spark.read.json(f"{path}/r1/part-*.json").count() == 3
    with pytest.raises(Exception, match="exists"):
        rows.write.format("report").option("run", "r1").mode("append").save(path)
    with pytest.raises(Exception, match="folder name"):
        rows.write.format("report").option("run", "../r").mode("append").save(path)


def test_documents_are_parsed_few_at_a_time():
    """A batch's parsed pieces never lie in memory together."""
    import pandas as pd
    xml = "<article><front><article-meta><title-group><article-title>T</article-title></title-group></article-meta></front><body><sec><title>A</title><p>x</p></sec></body></article>"
    batch = pd.DataFrame({"doc_key": [str(i) for i in range(1000)], "xml": [xml if i % 10 else "<broken" for i in range(1000)]})
    found = list(jats._parse(iter([batch])))
    assert max(map(len, found)) <= 64
    assert [k for f in found for k in f["doc_key"]] == [str(i) for i in range(1000) if i % 10]
