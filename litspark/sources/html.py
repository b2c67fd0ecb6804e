"""HTML pages to plain text, with column expressions only.

Skipped tags cut a page into stretches; how many are open is a running count
over those tags alone. What lies at count zero is cut at all other tags, and the
pieces are trimmed and joined.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.constants import HTML_SKIP_TAGS
from litspark.functions.binding import let

#: Comments, and elements whose content is no markup; an open one lasts to the end.
CODE = (r"(?is)<!--.*?(?:-->|\z)|<script(?:\s[^>]*)?>.*?(?:</script\s*>|\z)|<style(?:\s[^>]*)?>.*?(?:</style\s*>|\z)")
SKIP = r"(?i)</?(?:" + "|".join(HTML_SKIP_TAGS) + r")(?:[\s/][^>]*)?>"
#: A stray < begins a piece of its own.
#: Possessive, so that Java's engine loops over a long tag and does not recurse.
TAG = r"""(?s)<(?:/?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+|[!?][^>]*+)>|(?=<)"""
_EDGES = r"(?U)^\s+|\s+$"
_CUT = "<i>"
REF = "&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[a-zA-Z][a-zA-Z0-9]{1,31};?)"
#: HTML5's names by their first letter; one literal, which the optimizer turns into a map once.
_NAMES = json.dumps({k: {n: s for n, s in html5.items() if n[0] == k} for k in sorted({n[0] for n in html5})})
_OLD = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
#: What the numbers 128 to 159 stand for: windows-1252, where it has a sign.
_C1 = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160))


def _open(tags: Column) -> Column:
    """Open skipped tags before every stretch: all kinds count together, never below zero."""
    step = F.transform(tags, lambda t: F.when(F.endswith(t, F.lit("/>")), 0).when(F.startswith(t, F.lit("</")), -1).otherwise(1))
    return F.aggregate(step, F.array(F.lit(0)), lambda seen, s: F.concat(
        seen, F.array(F.greatest(F.element_at(seen, -1) + s, F.lit(0)))))


def _number(ref: Column) -> Column:
    """The sign of a numeric reference by HTML's rules; what is no character becomes U+FFFD."""
    digits = F.regexp_extract(ref, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    # More than seven digits lie beyond the last code point in either base.
    short = F.concat(F.lit("0"), F.left(digits, F.lit(7)))
    code = F.when(F.length(digits) > 7, 0x110000).otherwise(F.when(
        F.lower(F.substring(ref, 3, 1)) == "x", F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("int"))

    def sign(n: Column) -> Column:
        none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 65534)
        real = F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), 0xFFFD).otherwise(n)
        # The mark in front keeps the decoder from taking U+FEFF for one.
        char = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(real), 8, "0"))), "UTF-32")
        return F.when(n.between(128, 159), F.substring(F.lit(_C1), n - 127, F.lit(1))).when(
            none & (n <= 0x10FFFF), "").otherwise(char)

    return let(code, sign)


def _name(ref: Column) -> Column:
    """The sign of a named reference; without a semicolon, that of the longest old name it begins with."""
    names = F.from_json(F.lit(_NAMES), "map<string,map<string,string>>")

    def of(name: Column) -> Column:
        return F.element_at(F.element_at(names, F.left(name, F.lit(1))), name)

    def partly(name: Column) -> Column:
        old = F.regexp_extract(name, _OLD, 0)
        return F.coalesce(F.concat(of(old), F.substring(name, F.length(old) + 1, F.length(name))), ref)

    return let(F.substring(ref, F.lit(2), F.length(ref)), lambda name: F.coalesce(of(name), partly(name)))


def _unescape(text: Column) -> Column:
    """Character references decoded once, from left to right."""
    refs = F.regexp_extract_all(text, F.lit(REF), 0)
    return F.array_join(F.zip_with(F.split(text, REF, -1), refs, lambda gap, ref: F.concat(gap, F.when(
        ref.isNull(), "").when(F.startswith(ref, F.lit("&#")), _number(ref)).otherwise(_name(ref)))), "")


def visible_text(html: Column) -> Column:
    """Text outside skipped tags: pieces between tags, trimmed, joined by a space; null is empty."""
    def shown(body: Column) -> Column:
        stretches = F.zip_with(F.split(body, SKIP, -1), _open(F.regexp_extract_all(body, F.lit(SKIP), 0)),
                               lambda s, n: F.when(n == 0, s))
        pieces = F.split(F.array_join(stretches, _CUT), TAG, -1)
        trimmed = F.transform(pieces, lambda p: F.regexp_replace(F.when(F.contains(p, F.lit("&")), _unescape(p)).otherwise(p), _EDGES, ""))
        return F.array_join(F.filter(trimmed, lambda p: p != ""), " ")

    return let(F.regexp_replace(F.coalesce(html, F.lit("")), CODE, _CUT), shown)


def page_texts(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """``(page_id, url, text)`` of every page; whole texts unless ``max_chars`` is given."""
    out = pages.select("page_id", "url", visible_text(F.col("html")).alias("text"))
    return out if max_chars is None else out.withColumn("text", F.left("text", F.lit(max_chars)))
