"""Calendar buckets of a timestamp (without zone) or date column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The domains the calendar profiles are reported on.
WEEKDAY_NAMES = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
)
WEEKDAY, WEEKEND = "Weekday", "Weekend"
HOURS = tuple(range(1, 25))


def day(ts: Column) -> Column:
    return F.to_date(ts)


def month_start(ts: Column) -> Column:
    """First day of the month; grouping on a date is cheaper than on text."""
    return F.trunc(F.to_date(ts), "month")


def month_text(date: Column) -> Column:
    """``2024-05``"""
    return F.date_format(date, "yyyy-MM")


def month_label(date: Column) -> Column:
    """``May 2024``"""
    return F.date_format(date, "MMM yyyy")


def quarter(ts: Column) -> Column:
    """``2024Q2``"""
    date = F.to_date(ts)
    return F.concat(
        F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string")
    )


def year(ts: Column) -> Column:
    return F.year(F.to_date(ts))


def is_weekend(ts: Column) -> Column:
    """True on Saturday and Sunday; a missing time counts as a weekday."""
    return F.coalesce(F.weekday(F.to_date(ts)) >= 5, F.lit(False))


def weekday_name(ts: Column) -> Column:
    """English day name; null for a missing time."""
    names = F.array(*[F.lit(name) for name in WEEKDAY_NAMES])
    return F.get(names, F.weekday(F.to_date(ts)))


def hour_of_day(ts: Column) -> Column:
    """Hour counted 1..24; null for a missing time."""
    return F.hour(ts) + 1
