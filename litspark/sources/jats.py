"""JATS paper source.

The parser only walks one document's tree and reports raw pieces in document
order. Everything that is a rule about the pieces (cleaning, labelling,
skipping, inheriting, joining, years, authors) is a column expression.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.functions.records import publication_year
from litspark.functions.text import clean_markup, inherit_label, section_label, strip

_PART = "struct<kind: string, cells: array<string>>"
RAW = (
    "doc_key string, pmc string, pmcid string, pmid string, doi string, title string, abstract string, "
    "journal string, epub string, ppub string, anypub string, "
    "authors array<struct<surname: string, given: string>>, "
    f"nodes array<struct<headings: array<string>, kind: string, parts: array<{_PART}>>>"
)


def read_xml_files(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(doc_key, xml)`` per file, keyed by path."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_key"), F.col("value").alias("xml"))


def _text(node: ET.Element | None) -> str | None:
    """All text below ``node``, pieces joined by a space; markup never glues words."""
    return None if node is None else " ".join(node.itertext())


def _name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _part(kind: str, cells: list) -> dict:
    return {"kind": kind, "cells": [c or "" for c in cells]}


def _section_nodes(sec: ET.Element, headings: list[str]) -> Iterator[dict]:
    """Text, table and figure nodes of one section, then of its subsections."""
    text = [_part("p", [_text(p)]) for p in sec.findall("p")]
    text += [_part("list", [_text(i) for i in lst.iterfind(".//list-item")]) for lst in sec.findall("list")]
    yield {"headings": headings, "kind": "text", "parts": text}
    for wrap in sec.findall("table-wrap"):
        parts = [_part("label", [_text(x)]) for x in wrap.findall("label")[:1]]
        parts += [_part("caption", [_text(x)]) for x in list(wrap.iterfind(".//caption"))[:1]]
        for group in ("thead", "tbody"):
            parts += [_part("row", [_text(c) for c in tr if _name(c) in ("th", "td")])
                      for tr in wrap.iterfind(f".//{group}/tr")]
        yield {"headings": headings, "kind": "table", "parts": parts}
    for fig in sec.findall("fig"):
        parts = [_part("p", [_text(x)]) for tag in ("label", "caption") for x in fig.findall(tag)[:1]]
        yield {"headings": headings, "kind": "figure_caption", "parts": parts}
    yield from _below(sec, headings)


def _below(parent: ET.Element, headings: list[str]) -> Iterator[dict]:
    for child in parent:
        if _name(child) == "sec":
            title = child.find("title")
            yield from _section_nodes(child, [*headings, _text(title) or ""])


def _read(doc_key: str, xml: str | None) -> dict | None:
    """Raw pieces of one document, or None when it is malformed or has no front matter."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    article = root.find(".//article")
    article = root if article is None or len(article) == 0 else article
    front = article.find(".//front")
    if front is None:
        return None

    def year(path: str) -> str | None:
        # A date element without children does not count as present.
        date = front.find(path)
        return (_text(date.find("year")) or "") if date is not None and len(date) else None

    def ident(kind: str) -> str | None:
        return _text(front.find(f".//article-id[@pub-id-type='{kind}']"))

    first_date = front.find(".//pub-date")
    body = article.find(".//body")
    return {
        "doc_key": doc_key, "pmc": ident("pmc"), "pmcid": ident("pmcid"), "pmid": ident("pmid"),
        "doi": ident("doi"), "title": _text(front.find(".//article-title")),
        "abstract": _text(front.find(".//abstract")), "journal": _text(front.find(".//journal-title")),
        "epub": year(".//pub-date[@pub-type='epub']"), "ppub": year(".//pub-date[@pub-type='ppub']"),
        "anypub": None if first_date is None else _text(first_date.find("year")),
        "authors": [{"surname": _text(c.find(".//surname")), "given": _text(c.find(".//given-names"))}
                    for c in front.iterfind(".//contrib[@contrib-type='author']")],
        "nodes": [] if body is None else list(_below(body, [])),
    }


_DOCUMENTS = 64     # parsed and handed on at once


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ("doc_key pmc pmcid pmid doi title abstract journal epub ppub anypub authors nodes").split()
    for batch in batches:
        # The pieces of a document take many times its text: few documents at once, however many a batch has.
        for at in range(0, len(batch), _DOCUMENTS):
            part = batch.iloc[at:at + _DOCUMENTS]
            rows = [_read(k, x) for k, x in zip(part["doc_key"], part["xml"])]
            yield pd.DataFrame([r for r in rows if r is not None], columns=columns)


def _filled(texts: Column) -> Column:
    return F.filter(texts, lambda t: t != "")


def _part_text(part: Column) -> Column:
    cells = F.transform(part["cells"], clean_markup)
    joined = F.array_join(_filled(cells), "; ")
    return (
        F.when(part["kind"] == "label", F.concat(F.lit("["), F.array_join(cells, ""), F.lit("]")))
        .when(part["kind"] == "row", F.when(F.exists(cells, lambda c: c != ""), F.array_join(cells, " | ")).otherwise(""))
        .otherwise(joined)
    )


def _section(node: Column) -> Column:
    raw = F.transform(node["headings"], clean_markup)
    label = inherit_label(F.transform(raw, section_label))
    parts = _filled(F.transform(node["parts"], _part_text))
    content = (
        F.when(node["kind"] == "table", F.array_join(parts, "\n"))
        .when(node["kind"] == "figure_caption", F.array_join(parts, ": "))
        .otherwise(F.array_join(parts, " "))
    )
    return F.struct(
        label.alias("name"), F.coalesce(F.nullif(F.element_at(raw, -1), F.lit("")), label).alias("raw_name"),
        content.alias("content"), node["kind"].alias("section_type"))


def parse_papers(documents: DataFrame) -> DataFrame:
    """Papers from ``(doc_key, xml)``; malformed, frontless and untitled documents are dropped."""
    raw = documents.select("doc_key", "xml").mapInPandas(_parse, RAW)

    def text(name: str) -> Column:
        return clean_markup(F.coalesce(name, F.lit("")))

    def ident(name: str) -> Column:
        return strip(F.coalesce(name, F.lit("")))

    people = F.transform("authors", lambda a: F.struct(
        clean_markup(F.coalesce(a["surname"], F.lit(""))).alias("s"),
        clean_markup(F.coalesce(a["given"], F.lit(""))).alias("g")))
    names = F.transform(F.filter(people, lambda a: a["s"] != ""),
                        lambda a: strip(F.concat_ws(" ", a["s"], F.nullif(a["g"], F.lit("")))))
    lead = F.filter(
        F.array(F.struct(F.lit("abstract").alias("name"), F.lit("Abstract").alias("raw_name"),
                         text("abstract").alias("content"), F.lit("text").alias("section_type"))),
        lambda s: s["content"] != "")
    body = F.filter(F.transform("nodes", _section),
                    lambda s: (s["name"] != "_skip") & (s["content"] != ""))
    return raw.select(
        "doc_key",
        F.coalesce(F.nullif(ident("pmc"), F.lit("")), ident("pmcid")).alias("pmc_id"),
        ident("pmid").alias("pmid"), ident("doi").alias("doi"), text("title").alias("title"),
        text("abstract").alias("abstract"), text("journal").alias("journal"),
        publication_year(F.col("epub"), F.col("ppub"), F.col("anypub")).alias("year"),
        names.alias("authors"), F.concat(lead, body).alias("sections"),
    ).where("title <> ''").withColumn("paper_key", F.regexp_replace("pmc_id", "^PMC", ""))
