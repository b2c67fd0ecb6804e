"""Substring joins of texts with drug-safety reference tables.

A text matches an entry when it contains one of the entry's names and passes
the entry's keyword gate. A reference table of checked size becomes one array
value that every text is tested against in place: no join, no shuffle, and
matches stay in entry order. A larger table is joined on character grams: every
name of at least ``GRAM`` characters shares its first gram with any text that
contains it, so an equi-join on grams finds every candidate pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark import constants as K
from litspark.functions.binding import let
from litspark.functions.records import localised_warning
from litspark.functions.text import rstrip
from litspark.session import store
from litspark.sizing import LITERAL_ROWS, join_small

GRAM = 4
WITHDRAWAL_FIELDS = ["drug", "aliases", "indication_keywords", "jurisdiction", "warning", "warning_fr"]
BIOMARKER_FIELDS = ["drug", "drug_patterns", "biomarker_keywords", "indication_keywords", "warning", "warning_fr"]


def _mentions(text: Column, names: Column) -> Column:
    """Whether lowered ``text`` contains any name; null and empty names never match."""
    return F.exists(
        F.coalesce(names, F.array().cast("array<string>")),
        lambda n: (n != "") & text.contains(F.lower(n)))


def _gate(text: Column, keywords: Column) -> Column:
    words = F.coalesce(keywords, F.array().cast("array<string>"))
    return (F.size(words) == 0) | F.exists(words, lambda w: text.contains(F.lower(w)))


def _withdrawal_hit(entry: Column, name_text: Column, gate_text: Column) -> Column:
    return _mentions(name_text, entry["names"]) & _gate(gate_text, entry["indication_keywords"])


def _biomarker_hit(entry: Column, name_text: Column, gate_text: Column) -> Column:
    documented = F.exists(
        F.coalesce(entry["biomarker_keywords"], F.array().cast("array<string>")),
        lambda w: gate_text.contains(F.lower(w)))
    return _withdrawal_hit(entry, name_text, gate_text) & ~documented


def _entries(table: DataFrame, names: Column, language: str) -> DataFrame:
    """One struct per entry: order, lowered names, gates, display fields."""
    columns = table.columns

    def words(name: str) -> Column:
        return (F.col(name) if name in columns else F.array().cast("array<string>")).alias(name)

    def text(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast("string")

    message = localised_warning(F.struct(text("warning").alias("warning"),
                                         text("warning_fr").alias("warning_fr")), language)
    return table.select(F.struct(
        F.col("ord").cast("long").alias("ord"), text("drug").alias("drug"), names.alias("names"),
        words("indication_keywords"), words("biomarker_keywords"),
        text("jurisdiction").alias("jurisdiction"), message.alias("message"),
    ).alias("entry"))


def withdrawal_entries(table: DataFrame, language: str = "en") -> DataFrame:
    names = F.concat(F.array(F.coalesce("drug", F.lit(""))),
                     F.coalesce("aliases", F.array().cast("array<string>")))
    return _entries(table, names, language)


def biomarker_entries(table: DataFrame, language: str = "en") -> DataFrame:
    return _entries(table, F.col("drug_patterns"), language)


def literal_table(entries: DataFrame, max_rows: int = LITERAL_ROWS) -> Column | None:
    """Entries that have a message, in order, as one array value; None when there are too many."""
    few = entries.where("entry.message <> ''").orderBy("entry.ord").select(F.to_json("entry").alias("j")).limit(
        max_rows + 1).collect()
    if len(few) > max_rows:
        return None
    kind = f"array<{entries.schema['entry'].dataType.simpleString()}>"
    return F.from_json(F.lit("[" + ",".join(r["j"] for r in few) + "]"), kind)


def match_entries(
    rows: DataFrame, name_text: Column, gate_text: Column, entries: DataFrame,
    hit=_withdrawal_hit, out: str = "matches", literal_rows: int = LITERAL_ROWS,
) -> DataFrame:
    """Add ``out``: the matching entries of every row, in entry order, with a message.

    Every row is matched by itself, whatever ids it has; a large reference table
    is joined on numbers given to the stored rows.
    """
    table = literal_table(entries, literal_rows)
    if table is not None:
        texts = F.struct(F.lower(name_text).alias("n"), F.lower(gate_text).alias("g"))
        return rows.withColumn(out, let(texts, lambda t: F.filter(table, lambda e: hit(e, t["n"], t["g"]))))
    rows = store(rows.withColumn("_row", F.monotonically_increasing_id()), "safety-rows")
    texts = rows.select("_row", F.lower(name_text).alias("_n"))
    named = entries.where("entry.message <> ''").select("entry", F.explode(
        F.filter(F.coalesce("entry.names", F.array().cast("array<string>")), lambda n: n != "")).alias("_name"))
    named = named.select("entry", F.lower("_name").alias("_name")).withColumn(
        "_gram", F.left("_name", F.lit(GRAM)))
    # Names shorter than a full gram are looked up by grams of their own length.
    sizes = sorted(r["l"] for r in named.select(F.length("_gram").alias("l")).distinct().collect())
    # Every place of the text, in one pass: the lookahead takes no sign, so grams overlap.
    grams = F.array_distinct(F.concat(*[
        F.regexp_extract_all("_n", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)) for size in sizes] or [F.array().cast("array<string>")]))
    # Only numbers and grams are exploded; a text moves once, to meet the grams that it shares with the table.
    shared = join_small(texts.select("_row", F.explode(grams).alias("_gram")), named.select("_gram").distinct(), ["_gram"], spread=F.col("_row"))
    shared = shared.groupBy("_row").agg(F.collect_set("_gram").alias("_grams"))
    near = rows.join(shared, "_row").select("_row", F.lower(name_text).alias("_n"), F.lower(gate_text).alias("_g"), F.explode("_grams").alias("_gram"))
    pairs = join_small(near, named, ["_gram"], spread=F.col("_row"))
    found = (
        pairs.where(F.col("_n").contains(F.col("_name")) & hit(F.col("entry"), F.col("_n"), F.col("_g")))
        .select("_row", "entry").distinct()
        .groupBy("_row").agg(F.array_sort(F.collect_list("entry")).alias(out))
    )
    # A row matches at most every entry once, so a group is bounded by the table.
    kind = found.schema[out].dataType
    return rows.join(found, "_row", "left").withColumn(out, F.coalesce(out, F.array().cast(kind))).drop("_row")


def append_warnings(answers: DataFrame, withdrawals: DataFrame, language: str = "en",
                    literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """Append a note per withdrawn drug that an answer mentions in its withdrawn use."""
    matched = match_entries(answers, F.col("answer"), F.col("answer"),
                            withdrawal_entries(withdrawals, language), literal_rows=literal_rows)
    notes = F.transform("matches", lambda m: F.concat(F.lit(K.REGULATORY_NOTE), m["message"]))
    noted = F.concat(rstrip(F.col("answer")), F.lit("\n\n"), F.array_join(notes, "\n\n"))
    return matched.withColumn(
        "answer", F.when(F.size("matches") > 0, noted).otherwise(F.col("answer"))
    ).withColumn("n_warnings", F.size("matches")).drop("matches")


def treatment_warnings(
    cards: DataFrame, withdrawals: DataFrame, biomarkers: DataFrame, language: str = "fr",
    literal_rows: int = LITERAL_ROWS,
) -> DataFrame:
    """Attach regulatory, then biomarker warnings to every drug of every card.

    Names are looked for in the drug text, keywords in the patient context
    (topic and history). Reference tables of checked size are tested inside the
    treatment array, so a card never leaves its row. Larger ones are joined: one
    row per drug, regrouped in treatment order.
    """
    context = F.concat(F.coalesce("cancer_type", F.lit("")), F.lit(" "), F.coalesce("clinical_history", F.lit("")))
    regulatory, eligibility = withdrawal_entries(withdrawals, language), biomarker_entries(biomarkers, language)

    def warnings(matches: Column, kind: str, drug: Column) -> Column:
        return F.transform(matches, lambda m: F.struct(
            F.lit(kind).alias("type"), F.coalesce(m["drug"], drug).alias("drug"),
            (F.lit(kind) if kind == "biomarker" else F.coalesce(m["jurisdiction"], F.lit(""))).alias("jurisdiction"),
            m["message"].alias("message")))

    def treated(t: Column, found: Column) -> Column:
        return F.struct(t["drug"].alias("drug"), t["intent"].alias("intent"), t["level"].alias("level"),
                        found.alias("warnings"))

    w, b = literal_table(regulatory, literal_rows), literal_table(eligibility, literal_rows)
    if w is not None and b is not None:
        def one(t: Column, text: Column) -> Column:
            return let(F.lower(t["drug"]), lambda low: treated(t, F.concat(
                warnings(F.filter(w, lambda e: _withdrawal_hit(e, low, text)), "regulatory", t["drug"]),
                warnings(F.filter(b, lambda e: _biomarker_hit(e, low, text)), "biomarker", t["drug"]))))

        return cards.withColumn("treatment", let(
            F.lower(context), lambda text: F.transform("treatment", lambda t: one(t, text))))
    cards = store(cards.withColumn("_card", F.monotonically_increasing_id()), "safety-cards")
    drugs = cards.select("_card", context.alias("_context"), F.posexplode("treatment").alias("_pos", "_t"))
    for entries, hit, out in ((regulatory, _withdrawal_hit, "_w"), (eligibility, _biomarker_hit, "_b")):
        drugs = match_entries(drugs, F.col("_t.drug"), F.col("_context"), entries, hit, out, literal_rows)
    found = F.concat(warnings(F.col("_w"), "regulatory", F.col("_t.drug")),
                     warnings(F.col("_b"), "biomarker", F.col("_t.drug")))
    regrouped = drugs.groupBy("_card").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", treated(F.col("_t"), found).alias("t")))),
        lambda x: x["t"]).alias("_treated"))
    none = F.array().cast(regrouped.schema["_treated"].dataType)
    # A null treatment stays null, an empty one empty.
    return cards.join(regrouped, "_card", "left").withColumn("treatment", F.coalesce(
        "_treated", F.when(F.col("treatment").isNotNull(), none))).drop("_card", "_treated")
