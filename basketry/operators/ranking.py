"""Top-n, bottom-n and presentation order.

``orderBy(...).limit(n)`` is planned as a top-n per task followed by a merge of
the n-row remainders, so no full sort takes place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def check_limit(n: int) -> int:
    """A user-chosen limit; at least 1."""
    if n < 1:
        raise ValueError(f"limit {n} is less than 1")
    return n


def top_n(df: DataFrame, metric: str, n: int, keys: list[str]) -> DataFrame:
    """The n rows with the largest metric; ties by key ascending, nulls last."""
    by_key = [F.asc_nulls_last(k) for k in keys]
    return df.orderBy(F.desc_nulls_last(metric), *by_key).limit(n)


def bottom_n(df: DataFrame, metric: str, n: int, keys: list[str]) -> DataFrame:
    """The n rows with the smallest metric; ties by key ascending, nulls last."""
    by_key = [F.asc_nulls_last(k) for k in keys]
    return df.orderBy(F.asc_nulls_last(metric), *by_key).limit(n)


def sort_by(df: DataFrame, column: str, keys: list[str], descending: bool = True) -> DataFrame:
    """Whole result in presentation order (range-partitioned sort)."""
    first = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(first, *[F.asc_nulls_last(k) for k in keys])
