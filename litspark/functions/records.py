"""Record-level expressions: safe casts, dates, JSON and map handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.text import or_else, strip, strip_controls

EXTRACTION_FIELDS = "study_design string, sample_size string, primary_outcome string, intervention string, comparator string"


def safe_int(value: Column) -> Column:
    """Integer or null; the text must be a whole number."""
    text = strip(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def publication_year(epub: Column, ppub: Column, first: Column) -> Column:
    """Year text of the first usable date element, as integer or null."""
    return safe_int(F.coalesce(epub, ppub, first))


def month_of(date_text: Column) -> Column:
    """``YYYYMMDD`` as ``YYYY-MM``; anything else keeps its first seven characters."""
    day = F.when(date_text.rlike(r"^[0-9]{8}$"), F.try_to_date(date_text, "yyyyMMdd"))
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.left(date_text, F.lit(7)))


def _short(text: Column, cut: int) -> Column:
    bare = strip(text)
    return F.when(bare != "", F.left(bare, F.lit(cut)))


def extraction(raw_response: Column, abstract: Column) -> Column:
    """Normalised record of one raw extractor response.

    A blank abstract or a response that is not a JSON object gives the failed
    record; unknown designs become ``unknown`` and sizes must be positive.
    """
    text = strip_controls(or_else(raw_response, F.lit("{}")))
    parsed = F.from_json(text, EXTRACTION_FIELDS + ", _corrupt string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    failed = raw_response.isNull() | (strip(F.coalesce(abstract, F.lit(""))) == "") | parsed["_corrupt"].isNotNull() | parsed.isNull()
    size = safe_int(parsed["sample_size"])
    design = parsed["study_design"]
    return F.struct(
        F.when(~failed & design.isin(K.DESIGNS), design).otherwise("unknown").alias("study_design"),
        F.when(~failed & (size > 0), size).alias("sample_size"),
        F.when(~failed, _short(parsed["primary_outcome"], 300)).alias("primary_outcome"),
        F.when(~failed, _short(parsed["intervention"], 200)).alias("intervention"),
        F.when(~failed, _short(parsed["comparator"], 200)).alias("comparator"),
        failed.alias("extraction_failed"),
    )


def fenced_json_map(text: Column) -> Column:
    """``map<string,string>`` from JSON that may sit in a code fence; empty on failure."""
    bare = strip(F.regexp_replace(text, "```(?:json)?", ""))
    bare = F.regexp_replace(bare, "^`+|`+$", "")
    parsed = F.from_json(strip_controls(strip(bare)), "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def payload_json(row: Column) -> Column:
    """JSON of a struct; keys whose value is null are left out."""
    return F.to_json(row)


def as_array(scalar: Column) -> Column:
    """One-element array of a scalar, empty for null."""
    return F.when(scalar.isNull(), F.array().cast("array<string>")).otherwise(F.array(scalar))


def comorbidity_map(text: Column) -> Column:
    """Map from ``name: value`` lines; blank value is ``yes``, a repeated name keeps its last value."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), strip)
    pairs = F.transform(
        F.filter(lines, lambda x: x.contains(":")),
        lambda x: F.struct(
            strip(F.substring_index(x, ":", 1)).alias("k"),
            or_else(strip(F.substr(x, F.instr(x, ":") + 1)), F.lit("yes")).alias("v")),
    )
    named = F.filter(pairs, lambda p: p["k"] != "")
    # Keys stay where they first appear and take the value they had last.
    keys = F.array_distinct(F.transform(named, lambda p: p["k"]))
    return F.map_from_arrays(
        keys,
        F.transform(keys, lambda k: F.element_at(
            F.transform(F.filter(named, lambda p: p["k"] == k), lambda p: p["v"]), -1)),
    )


def format_comorbidities(values: Column, language: str = "fr") -> Column:
    none = F.lit(K.CARD_LABELS.get(language, K.CARD_LABELS["fr"])["no_comorbidities"])
    joined = F.array_join(
        F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    return F.when(values.isNull() | (F.size(values) == 0), none).otherwise(joined)


def localised_warning(entry: Column, language: str = "en") -> Column:
    """Warning text in ``language``, else in the other one."""
    mine, other = ("warning_fr", "warning") if language == "fr" else ("warning", "warning_fr")
    return F.coalesce(F.nullif(entry[mine], F.lit("")), F.nullif(entry[other], F.lit("")), F.lit(""))
