"""Chunk arrays and chunk identifiers.

Chunking is a row-local expression: a paper row carries its sections, so the
running chunk index over a paper is a position in one array and no shuffle is
needed to number chunks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.text import clean_legacy, words


def _cut(word_list: Column, starts: Column, size: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(word_list, i + 1, size), " "))


def window_texts(word_list: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Overlapping windows; the last one is the first that reaches the end."""
    step = size - overlap
    n = F.size(word_list)
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    return _cut(word_list, F.sequence(F.lit(0), last * step, F.lit(step)), size)


def legacy_window_texts(
    word_list: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP
) -> Column:
    """Windows starting at every step inside the text, trailing overlap included."""
    step = size - overlap
    return _cut(word_list, F.sequence(F.lit(0), F.size(word_list) - 1, F.lit(step)), size)


def section_texts(
    content: Column, kind: Column, word_list: Column,
    size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, table_cap: int | None = None,
) -> Column:
    """Chunk texts of one section according to its kind and length.

    A table beyond ``TABLE_WORD_CAP`` words is windowed like prose; with ``table_cap``
    it is cut after so many words, with a note, and the rest is in no chunk.
    """
    n = F.size(word_list)
    whole = F.array(content)
    none = F.array().cast("array<string>")
    if table_cap is None:
        table = F.when(n > K.TABLE_WORD_CAP, window_texts(word_list, size, overlap)).otherwise(whole)
    else:
        cut = F.concat(F.array_join(F.slice(word_list, 1, table_cap), " "), F.lit(" " + K.TABLE_NOTE))
        table = F.when(n > table_cap, F.array(cut)).otherwise(whole)
    prose = (
        F.when(n < K.MIN_CHUNK_WORDS, none)
        .when(n <= K.SHORT_SECTION_WORDS, whole)
        .otherwise(window_texts(word_list, size, overlap))
    )
    return (
        F.when((n == 0) | n.isNull(), none)
        .when(kind == "table", table)
        .when(kind == "figure_caption", whole)
        .otherwise(prose)
    )


def paper_chunks(
    sections: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, table_cap: int | None = None,
) -> Column:
    """``array<struct<section, chunk_type, text>>`` over all sections in order."""
    split = F.transform(
        sections,
        lambda s: F.struct(
            s["name"].alias("name"), s["section_type"].alias("kind"),
            s["content"].alias("content"), words(s["content"]).alias("words"),
        ),
    )
    kind = lambda k: F.when(k.isin("table", "figure_caption"), k).otherwise("text")
    return F.flatten(
        F.transform(
            split,
            lambda s: F.transform(
                section_texts(s["content"], s["kind"], s["words"], size, overlap, table_cap),
                lambda t: F.struct(
                    s["name"].alias("section"), kind(s["kind"]).alias("chunk_type"), t.alias("text")
                ),
            ),
        )
    )


def legacy_section_chunks(
    sections: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP
) -> Column:
    """``array<struct<section_name, text, chunk_index, total_chunks>>`` of cleaned sections."""
    cleaned = F.transform(
        F.filter(sections, lambda s: F.coalesce(s["content"], F.lit("")) != ""),
        lambda s: F.struct(s["section_name"].alias("name"), clean_legacy(s["content"]).alias("content")),
    )
    split = F.transform(
        cleaned, lambda s: F.struct(s["name"].alias("name"), s["content"].alias("content"),
                                    words(s["content"]).alias("words")))
    texts = F.transform(
        split,
        lambda s: F.struct(
            F.coalesce(s["name"], F.lit("Unknown")).alias("name"),
            F.when(F.size(s["words"]) <= size, F.array(s["content"]))
            .otherwise(legacy_window_texts(s["words"], size, overlap)).alias("texts"),
        ),
    )
    return F.flatten(
        F.transform(
            texts,
            lambda s: F.transform(
                s["texts"],
                lambda t, i: F.struct(
                    s["name"].alias("section_name"), t.alias("text"),
                    i.alias("chunk_index"), F.size(s["texts"]).alias("total_chunks"),
                ),
            ),
        )
    )


def chunk_id(pmcid: Column, section: Column, index: Column) -> Column:
    return F.concat(F.coalesce(pmcid, F.lit("")), F.lit("_"), section, F.lit("_"), index.cast("string"))


def _dashed(hex32: Column) -> Column:
    return F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def point_id(key: Column) -> Column:
    """UUID text over the MD5 digest of ``key``."""
    return _dashed(F.md5(key))


def point_id_v5(key: Column, namespace_hex: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID (version 5) of ``key``; the default namespace is DNS."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(key, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return _dashed(F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3),
                            variant, F.substring(digest, 18, 15)))


def legacy_id(topic: Column, pmc_id: Column, pmid: Column, section: Column,
              chunk_index: Column, ordinal: Column) -> Column:
    """Composite key of the older collection: spaces become ``_``, section cut at 30."""
    named = F.left(F.replace(F.coalesce(section, F.lit("unknown")), F.lit(" "), F.lit("_")), F.lit(30))
    unknown = F.lit("unknown")
    return F.concat_ws("_", topic, F.coalesce(pmc_id, unknown), F.coalesce(pmid, unknown),
                       named, chunk_index.cast("string"), ordinal.cast("string"))
