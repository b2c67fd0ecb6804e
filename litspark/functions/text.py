"""Text expressions: words, tokens, cleaning, section labels, embedding input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.binding import let

# Java's \s is ASCII only; this is the full Unicode whitespace class.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    """Null, empty or whitespace only."""
    return text.isNull() | (strip(text) == "")


def or_else(text: Column, other: Column) -> Column:
    """``text`` unless it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


def words(text: Column) -> Column:
    """Whitespace-separated words; empty array for blank text."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def tokens(text: Column) -> Column:
    """Keyword-index tokens: lower case runs of letters, numbers and underscore."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def clean_markup(text: Column) -> Column:
    """Drop numeric citation markers, collapse whitespace, trim."""
    bare = F.regexp_replace(text, r"\[\p{Nd}+(?:(?:[,–\-]|" + SPACE + r")\p{Nd}+)*\]", "")
    return strip(F.regexp_replace(bare, SPACE + "+", " "))


def clean_legacy(text: Column) -> Column:
    """Collapse whitespace, keep letters, numbers and ``_.,;:-()[]'``, trim."""
    flat = F.regexp_replace(text, SPACE + "+", " ")
    return strip(F.regexp_replace(flat, r"[^\p{L}\p{N}_ .,;:\-()\[\]']", ""))


def section_label(heading: Column) -> Column:
    """Canonical section label of a heading; rules apply in list order."""
    def chain(low: Column) -> Column:
        cases = F.when(low.isNull(), "other")
        for keyword, label in K.SECTION_RULES:
            cases = cases.when(low.contains(keyword), label)
        return cases.otherwise("other")

    return let(F.lower(heading), chain)


def inherit_label(labels: Column) -> Column:
    """Label of a nested section from its own and its ancestors' labels.

    ``labels`` runs from the outermost to the innermost heading. A section
    below a skipped one is skipped; ``other`` takes the nearest known label.
    """
    def nearest(own: Column) -> Column:
        known = F.filter(own, lambda x: x != "other")
        return (
            F.when(F.array_contains(own, K.SKIP_SECTION), K.SKIP_SECTION)
            .when(F.size(known) > 0, F.element_at(known, -1))
            .otherwise("other")
        )

    return let(labels, nearest)


def normalise_topic(raw: Column) -> Column:
    """Topic after trimming, lowering and alias lookup; null when unsupported."""
    low = F.lower(strip(raw))
    aliases = F.create_map(*[F.lit(x) for pair in K.TOPIC_ALIASES.items() for x in pair])
    topic = F.coalesce(F.try_element_at(aliases, low), low)
    return F.when(topic.isin(K.TOPICS), topic)


def require_topic(raw: Column) -> Column:
    """Like :func:`normalise_topic` but fails the query on an unsupported topic."""
    topic = normalise_topic(raw)
    return F.when(
        topic.isNull(),
        F.raise_error(F.concat(F.lit("unsupported topic: "), F.coalesce(raw, F.lit("null")))),
    ).otherwise(topic)


def embedding_text(text: Column, title: Column, section: Column, prefix: Column | None = None) -> Column:
    """Text handed to the embedder: prefix line, else ``title | section`` line, else text."""
    blank = F.lit("")
    t, s = F.coalesce(title, blank), F.coalesce(section, blank)
    headed = F.when(
        (t != "") | (s != ""), F.concat(t, F.lit(" | "), s, F.lit("\n"), text)
    ).otherwise(text)
    if prefix is None:
        return headed
    return F.when(F.coalesce(prefix, blank) != "", F.concat(prefix, F.lit("\n"), text)).otherwise(headed)


def key_terms(text: Column) -> Column:
    """Distinct lowered ASCII words longer than three letters, minus stopwords."""
    found = F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z]{4,})"), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(K.STOPWORDS)))


def scrub_pii(text: Column, mark: str = "[REDACTED]") -> Column:
    for pattern in K.PII_PATTERNS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def strip_controls(text: Column) -> Column:
    """Remove ASCII control characters, as needed before parsing JSON."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")
