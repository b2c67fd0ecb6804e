"""Bind a value once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once per row.

    Inside a lambda, and across the branches of a CASE, Spark repeats a
    subexpression at every mention; a one-element transform evaluates it once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
