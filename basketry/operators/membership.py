"""Membership in another table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str | None = None) -> DataFrame:
    """Rows whose value does not occur in the other table; null values are dropped.

    The other side is reduced to its distinct values first. That combines before
    the shuffle, so neither the number of repeats nor a hot value matters for
    the anti join, which could not split a skewed right side.
    """
    values = other.select(F.col(other_column or column).alias(column))
    present = values.where(F.col(column).isNotNull()).distinct()
    return df.where(F.col(column).isNotNull()).join(present, column, "left_anti")
