"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.sizing import fits_bytes

#: The six bytes that part words.
SPACES = " \t\n\x0b\f\r"
_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: One row per source, host or shard: broadcast up to this many rows, joined by shuffle beyond.
SMALL_ROWS = 50_000


def n_words(text: Column) -> Column:
    """Words of a text without an array of them: every word and the space before it becomes one sign."""
    return F.coalesce(F.length(F.regexp_replace(F.rtrim(text, F.lit(SPACES)), f"{_SPACE}*{_WORD}+", "x")), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, its white space kept."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({_SPACE}*{_WORD}+)"), 1), F.lit(1), n.cast("int")), "")


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``max_rows`` rows and ``sizing.BROADCAST_BYTES``, its lists and texts counted."""
    return F.broadcast(df) if fits_bytes(df, max_rows) else df
