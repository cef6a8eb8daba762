"""Grouped and global aggregates.

Group keys that are null are dropped, distinct counts ignore nulls, and the sum
of a group without values is 0. Every aggregate below is combined before its
shuffle, so a hot key reaches the reduce side as one row per map task; distinct
counts shuffle on (key, value) first, so a hot key is spread over tasks as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData, functions as F

from basketry.functions.ratios import sum_or_zero
from basketry.operators.filters import drop_nulls


def group_nonnull(df: DataFrame, *keys: str) -> GroupedData:
    """Group by keys, leaving out rows with a null key."""
    return drop_nulls(df, *keys).groupBy(*keys)


def distinct_count(df: DataFrame, column: str, name: str, rsd: float | None = None) -> DataFrame:
    """One row with the number of distinct values.

    Exact by default. ``rsd`` asks for the approximate count with that relative
    standard deviation, which needs no shuffle of the values.
    """
    counted = (
        F.countDistinct(column) if rsd is None else F.approx_count_distinct(column, rsd)
    )
    return df.agg(counted.alias(name))


def distinct_by(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Distinct values of ``column`` per key."""
    return group_nonnull(df, key).agg(F.countDistinct(column).alias(name))


def sum_by(df: DataFrame, keys: list[str], column: str, name: str | None = None) -> DataFrame:
    """Sum of ``column`` per key combination."""
    return group_nonnull(df, *keys).agg(sum_or_zero(F.col(column)).alias(name or column))


def max_by_key(df: DataFrame, keys: list[str], column: str, name: str | None = None) -> DataFrame:
    return group_nonnull(df, *keys).agg(F.max(column).alias(name or column))


def min_by_key(df: DataFrame, keys: list[str], column: str, name: str | None = None) -> DataFrame:
    return group_nonnull(df, *keys).agg(F.min(column).alias(name or column))


def value_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows per value, nulls not counted."""
    return group_nonnull(df, column).agg(F.count(F.lit(1)).alias(name))
