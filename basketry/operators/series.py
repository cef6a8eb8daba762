"""Results on a fixed domain and gap-free daily series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.functions import calendar as cal
from basketry.functions.ratios import percentage


def fill_domain(
    df: DataFrame, key: str, domain: Sequence, measure: str, fill=0
) -> DataFrame:
    """One row per value of a short literal domain, ``fill`` where ``df`` has none.

    ``df`` holds at most one row per key; cut to the domain it is no longer than
    the domain, which bounds what is broadcast.
    """
    values = F.array(*[F.lit(v) for v in domain])
    frame = df.sparkSession.range(0, len(domain), 1, 1).select(
        F.col("id").alias("position"), values[F.col("id").cast("int")].alias(key)
    )
    measured = df.where(F.col(key).isin(*domain)).select(key, measure)
    return (
        frame.join(F.broadcast(measured), key, "left")
        .select("position", key, F.coalesce(measure, F.lit(fill)).alias(measure))
        .orderBy("position")
        .drop("position")
    )


def two_way_share(
    df: DataFrame, is_second: Column, measure: Column, names: tuple[str, str],
    key: str, measure_name: str,
) -> DataFrame:
    """Measure and percentage of two complementary categories, always two rows.

    ``measure`` is summed per category in one global aggregate; both percentages
    are null when the total is zero.
    """
    zero = F.lit(0)
    sums = df.agg(
        F.coalesce(F.sum(F.when(~is_second, measure)), zero).alias("first"),
        F.coalesce(F.sum(F.when(is_second, measure)), zero).alias("second"),
    )
    rows = F.array(
        F.struct(F.lit(names[0]).alias(key), F.col("first").alias(measure_name)),
        F.struct(F.lit(names[1]).alias(key), F.col("second").alias(measure_name)),
    )
    return (
        sums.select((F.col("first") + F.col("second")).alias("total"), F.inline(rows))
        .withColumn("Percentage", percentage(F.col(measure_name), F.col("total")))
        .drop("total")
    )


def date_spine(
    daily: DataFrame, day: str, measure: str, as_of: dt.date | None = None
) -> DataFrame:
    """Every day from the first one present up to ``as_of`` (today by default).

    ``daily`` holds one row per day. Each row also produces the days missing
    before the next one, with measure 0. The ordering window has no key, but its
    input is one row per calendar day, not per event.
    """
    last = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    following = F.lead(day).over(Window.orderBy(day))
    runs = daily.where(F.col(day) <= last).select(
        F.col(day).alias("present"),
        F.col(measure),
        F.coalesce(F.date_sub(following, 1), last).alias("until"),
    )
    days = runs.select(
        F.explode(F.sequence("present", "until")).alias(day), "present", measure
    )
    is_present = F.col(day) == F.col("present")
    return days.select(
        day, F.when(is_present, F.col(measure)).otherwise(F.lit(0)).alias(measure)
    )


def by_month(spine: DataFrame, day: str, measure: str) -> DataFrame:
    """Monthly sums, oldest first: ``month`` (2024-05) and ``month_label`` (May 2024)."""
    months = spine.groupBy(cal.month_start(F.col(day)).alias("start")).agg(
        F.sum(measure).alias(measure)
    )
    return months.orderBy("start").select(
        cal.month_text(F.col("start")).alias("month"),
        cal.month_label(F.col("start")).alias("month_label"),
        measure,
    )


def by_quarter(spine: DataFrame, day: str, measure: str) -> DataFrame:
    quarters = spine.groupBy(cal.quarter(F.col(day)).alias("quarter")).agg(
        F.sum(measure).alias(measure)
    )
    return quarters.orderBy("quarter")


def by_year(spine: DataFrame, day: str, measure: str) -> DataFrame:
    years = spine.groupBy(cal.year(F.col(day)).alias("year")).agg(
        F.sum(measure).alias(measure)
    )
    return years.orderBy("year")
