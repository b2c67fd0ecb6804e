"""``[Doc n]`` citations: extraction, validation, removal, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.binding import let
from litspark.functions.text import or_else, strip


def cited_loose(answer: Column) -> Column:
    """Cited numbers in order with repeats, any spacing after ``Doc`` (judges)."""
    return _numbers(F.regexp_extract_all(answer, F.lit(K.CITATION_LOOSE), F.lit(1)))


def cited(answer: Column) -> Column:
    """Cited numbers in order with repeats, exactly one space after ``Doc``."""
    return _numbers(F.regexp_extract_all(answer, F.lit(K.CITATION_TAG), F.lit(1)))


def _numbers(digits: Column) -> Column:
    # A number too long for BIGINT can never name a document; -1 keeps it invalid.
    return F.transform(digits, lambda d: F.coalesce(d.try_cast("bigint"), F.lit(-1)))


def in_range(n: Column, num_docs: Column) -> Column:
    return (n >= 1) & (n <= num_docs)


def hallucinated(answer: Column, num_docs: Column) -> Column:
    """Sorted distinct cited numbers that point at no document."""
    return F.array_sort(F.array_distinct(F.filter(cited(answer), lambda n: ~in_range(n, num_docs))))


def strip_all_tags(text: Column) -> Column:
    return strip(F.regexp_replace(text, K.CITATION_TAG, ""))


def strip_invalid_tags(text: Column, num_docs: Column) -> Column:
    """Remove only the tags that point at no document, in one regular-expression pass."""
    digits = F.array_distinct(F.regexp_extract_all(text, F.lit(K.CITATION_TAG), F.lit(1)))
    bad = F.filter(digits, lambda d: ~in_range(F.coalesce(d.try_cast("bigint"), F.lit(-1)), num_docs))

    def cut(numbers: Column) -> Column:
        pattern = F.concat(F.lit(r"(?i)\s*\[Doc (?:"), F.array_join(numbers, "|"), F.lit(r")\]"))
        return F.when(F.size(numbers) > 0, F.regexp_replace(text, pattern, F.lit(""))).otherwise(text)

    return strip(let(bad, cut))


def removed_notice(answer: Column, removed: Column) -> Column:
    """Prefix a warning naming the removed citations, when there are any."""
    return F.when(
        F.size(removed) > 0,
        F.concat(
            F.lit("WARNING: The following answer contained hallucinated citations ([Doc "),
            F.array_join(F.transform(removed, lambda n: n.cast("string")), ", "),
            F.lit("]) that were removed.\n\n"), answer,
        ),
    ).otherwise(answer)


def valid_citations(answer: Column, removed: Column) -> Column:
    return F.array_sort(F.array_except(F.array_distinct(cited(answer)), removed))


def first_mentions(texts: Column, num_docs: Column) -> Column:
    """Distinct in-range numbers over an array of texts, in order of first appearance."""
    return F.filter(
        F.array_distinct(F.flatten(F.transform(texts, cited))), lambda n: in_range(n, num_docs))


def source_line(n: Column, authors: Column, year: Column, journal: Column, title: Column,
                design: Column, sample_size: Column) -> Column:
    """``[Doc n] Surname et al. year journal (design, n=N)`` from metadata alone."""
    first = F.try_element_at(authors, F.lit(1))
    surname = F.regexp_extract(F.coalesce(first, F.lit("")), r"(\S+)", 1)
    header = F.array_join(F.array_compact(F.array(
        F.when(surname != "", F.concat(surname, F.lit(" et al."))),
        F.when(year != 0, year.cast("string")),
        F.nullif(journal, F.lit("")),
    )), " ")
    suffix = F.array_join(F.array_compact(F.array(
        F.nullif(design, F.lit("")),
        F.when(sample_size != 0, F.concat(F.lit("n="), sample_size.cast("string"))),
    )), ", ")
    return F.concat(
        F.lit("[Doc "), n.cast("string"), F.lit("] "),
        or_else(header, or_else(title, F.lit("Unknown source"))),
        F.when(suffix != "", F.concat(F.lit(" ("), suffix, F.lit(")"))).otherwise(""),
    )


def author_heads(authors: Column, keep: int = 3) -> Column:
    """First ``keep`` authors joined, with ``et al.`` when there are more."""
    people = F.coalesce(authors, F.array().cast("array<string>"))
    joined = F.array_join(F.slice(people, 1, keep), ", ")
    return F.when(F.size(people) > keep, F.concat(joined, F.lit(" et al."))).otherwise(joined)


def source_detail(c: Column, finding_chars: int | None = None) -> Column:
    """Ten-field source record of a ranked chunk struct; ``finding_chars`` cuts the key finding."""
    finding = F.coalesce(c["text"], F.lit(""))
    blank = F.lit("")
    return F.struct(
        c["chunk_id"].alias("chunk_id"),
        or_else(c["title"], F.lit("Unknown")).alias("title"),
        author_heads(c["authors"]).alias("authors"),
        F.coalesce(c["journal"], blank).alias("journal"),
        c["year"].alias("year"),
        F.coalesce(c["study_design"], blank).alias("study_design"),
        c["sample_size"].alias("sample_size"),
        F.coalesce(c["section"], blank).alias("section"),
        (finding if finding_chars is None else F.left(finding, F.lit(finding_chars))).alias("key_finding"),
        F.coalesce(c["pmid"], blank).alias("pmid"),
    )


def disclosure_detail(text: Column) -> Column:
    """The source record that stands in when no chunk backs an answer."""
    blank = F.lit("")
    return F.struct(
        blank.alias("chunk_id"), text.alias("title"), blank.alias("authors"), blank.alias("journal"),
        F.lit(None).cast("int").alias("year"), F.lit("parametric_knowledge").alias("study_design"),
        F.lit(None).cast("int").alias("sample_size"), blank.alias("section"),
        blank.alias("key_finding"), blank.alias("pmid"),
    )


def prompt_header(n: Column, title: Column, year: Column, section: Column, design: Column) -> Column:
    """``[Doc n] | title | year | section | design`` leaving out empty parts."""
    return F.array_join(F.array_compact(F.array(
        F.concat(F.lit("[Doc "), n.cast("string"), F.lit("]")),
        F.coalesce(title, F.lit("Unknown title")),
        F.when(year != 0, year.cast("string")),
        F.nullif(section, F.lit("")),
        F.nullif(design, F.lit("")),
    )), " | ")


def card_header(n: Column, title: Column, year: Column, design: Column, sample_size: Column) -> Column:
    """``[Doc n] title (year) — design (n=N)`` leaving out empty parts."""
    return F.concat(
        F.lit("[Doc "), n.cast("string"), F.lit("] "), F.coalesce(title, F.lit("Unknown")),
        F.when(year != 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""),
        F.when(design != "", F.concat(F.lit(" — "), design)).otherwise(""),
        F.when(sample_size != 0, F.concat(F.lit(" (n="), sample_size.cast("string"), F.lit(")"))).otherwise(""),
    )
