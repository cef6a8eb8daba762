"""Row filters and replacements."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def drop_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in every named column."""
    for column in columns:
        df = df.where(F.col(column).isNotNull())
    return df


def one_of(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose column is one of a short literal list."""
    return df.where(F.col(column).isin(*values))


def replace_null(column: str, value) -> Column:
    return F.coalesce(F.col(column), F.lit(value)).alias(column)


def replace_value(column: str, old, new) -> Column:
    return F.when(F.col(column) == F.lit(old), F.lit(new)).otherwise(F.col(column)).alias(column)


def latest_date(df: DataFrame, column: str) -> Column:
    """Midnight of the latest date of a column, as a scalar subquery."""
    return df.select(F.to_date(F.max(column)).cast("timestamp_ntz").alias("end")).scalar()


def filter_by_date(
    df: DataFrame,
    column: str,
    start: dt.date | None = None,
    end: dt.date | Column | None = None,
    whole_end_day: bool = False,
) -> DataFrame:
    """Rows from ``start`` to ``end``, both meaning midnight of that date.

    A missing bound defaults to the earliest / latest date in the column. As the
    end is a midnight, later rows of the end date are left out unless
    ``whole_end_day`` is set. Rows without a time are dropped.

    The earliest date's midnight excludes nothing, so only a missing ``end``
    costs a pass over the column (a scalar subquery). ``end`` may also be a midnight
    as a column, such as a scalar subquery over a cheaper frame (see :func:`latest_date`).
    """
    when = F.col(column)
    kept = df.where(when.isNotNull())
    if start is not None:
        kept = kept.where(when >= F.lit(start).cast("timestamp_ntz"))
    if end is None and whole_end_day:
        return kept
    if end is None:
        end = latest_date(df, column)
    if isinstance(end, Column):
        after = end + F.make_dt_interval(days=F.lit(1))
        return kept.where(when < after if whole_end_day else when <= end)
    if whole_end_day:
        after = end + dt.timedelta(days=1)
        return kept.where(when < F.lit(after).cast("timestamp_ntz"))
    return kept.where(when <= F.lit(end).cast("timestamp_ntz"))
