"""Refresh of the withdrawal reference table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from litspark.operators.merge import merge_counts, merge_protected
from litspark.sources.records import enforcement_entries, union_feeds


def merge_withdrawals(existing: DataFrame, enforcement: DataFrame, *feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged table and merge counters from enforcement records and further feeds.

    Every input carries ``seq``, its position in the order entries are merged in.
    """
    new = union_feeds(enforcement_entries(enforcement), *feeds)
    return merge_protected(existing, new), merge_counts(existing, new)
