"""Means, ratios and percentages over aggregates.

Money is summed as decimal, so sums do not depend on the order of rows, and is
divided as double.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double; null when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percentage(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def sum_or_zero(value: Column) -> Column:
    """Sum that is 0, not null, when no value is present."""
    return F.coalesce(F.sum(value), F.lit(0))


def exact_mean(value: Column) -> Column:
    """Mean of the non-null values from an exact sum; null without values."""
    return ratio(F.sum(value), F.count(value))


def rounded(number: Column, decimals: int = 2) -> Column:
    """Round half to even."""
    return F.bround(number, decimals)
