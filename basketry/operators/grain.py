"""One row per key out of many.

"First" and "last" always refer to an explicit order column. All operators are
plain aggregates rather than ranking windows: they combine before the shuffle (a
hot key never gathers in one task) and do not depend on how rows are spread.

Where order and values are numbers, dates or times, rows are picked with min_by, which
runs as a hash aggregate. Otherwise they are compared as ``(order, value)`` structs
with min / max, which are aggregated by sorting. Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from basketry.operators.filters import drop_nulls
from basketry.operators.grouping import group_nonnull

ORDER = "row_order"

_FIXED_WIDTH = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


def fixed_width(df: DataFrame, *columns: str) -> bool:
    """Whether aggregates over these columns can run by hashing."""
    return all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in columns)


def first_value(df: DataFrame, column: str, order: str = ORDER) -> Column:
    """Aggregate over ``df``: the first non-null value of a column."""
    known = F.col(column).isNotNull()
    if fixed_width(df, column, order):
        return F.min_by(column, F.when(known, F.col(order)))
    return F.min(F.when(known, F.struct(F.col(order), F.col(column))))[column]


def first_non_null(
    df: DataFrame, keys: list[str], columns: list[str], order: str = ORDER
) -> DataFrame:
    """Per key, the first non-null value of each column on its own.

    Rows with a null key are dropped. Values of different columns may come from
    different rows.
    """
    firsts = [first_value(df, c, order).alias(c) for c in columns]
    return group_nonnull(df, *keys).agg(*firsts)


def dedup_rows(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    order: str = ORDER,
    keep: str = "first",
) -> DataFrame:
    """Per key, the whole first (or last) row, nulls included.

    A null key is a key like any other and keeps one row. Rows of a key must differ
    in their order or else be equal.
    """
    if fixed_width(df, order, *columns):
        pick = {"first": F.min_by, "last": F.max_by}[keep]
        return df.groupBy(*keys).agg(*[pick(c, order).alias(c) for c in columns])
    pick = {"first": F.min, "last": F.max}[keep]
    ordered = F.struct(F.col(order), *[F.col(c) for c in columns])
    kept = df.groupBy(*keys).agg(pick(ordered).alias("kept"))
    return kept.select(*keys, *[F.col("kept")[c].alias(c) for c in columns])


def row_at_max(
    df: DataFrame, keys: list[str], metric: str, columns: list[str], order: str = ORDER
) -> DataFrame:
    """Per key, the row with the largest metric; the earliest one of a tie.

    Keys whose metric is null throughout have no such row and are dropped.
    """
    known = df.where(F.col(metric).isNotNull())
    earliest = dedup_rows(drop_nulls(known, *keys), [*keys, metric], columns, order)
    if fixed_width(df, metric, *columns):
        picked = [F.max_by(c, metric).alias(c) for c in columns]
        return earliest.groupBy(*keys).agg(F.max(metric).alias(metric), *picked)
    row = F.struct(F.col(metric), *[F.col(c) for c in columns])
    best = earliest.groupBy(*keys).agg(F.max(row).alias("best"))
    return best.select(
        *keys, F.col("best")[metric].alias(metric), *[F.col("best")[c].alias(c) for c in columns]
    )
