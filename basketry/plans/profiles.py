"""Calendar profiles shared by sessions, orders, checkouts and revenue.

The input is one row per session or order with its time; the measure is a count
of rows or a sum of money. :func:`page` gives all profiles of a page from one pass over it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.functions import calendar as cal
from basketry.functions.ratios import sum_or_zero
from basketry.functions.text import money_label, percent_label
from basketry.operators import series
from basketry.operators.grouping import group_nonnull, value_counts


def weekday_weekend(grain: DataFrame, is_weekend: Column, name: str = "Count",
                    measure: Column | None = None) -> DataFrame:
    """Two rows, ``Weekday`` and ``Weekend``: measure, percentage and its label."""
    shares = series.two_way_share(
        grain,
        is_weekend,
        F.lit(1) if measure is None else measure,
        (cal.WEEKDAY, cal.WEEKEND),
        "Category",
        name,
    )
    return shares.withColumn("Label", percent_label(F.col("Percentage")))


def by_weekday_name(grain: DataFrame, day_name: Column, name: str = "Count",
                    measure: Column | None = None) -> DataFrame:
    """Seven rows, Monday first; rows without a day are left out."""
    keyed = grain.withColumn("Day", day_name)
    return series.fill_domain(
        _measure(keyed, "Day", name, measure), "Day", cal.WEEKDAY_NAMES, name
    )


def by_hour(grain: DataFrame, hour: Column, name: str,
            measure: Column | None = None) -> DataFrame:
    """24 rows, hours 1..24; rows without a time are left out."""
    keyed = grain.withColumn("Hour_Of_Day", hour)
    return series.fill_domain(
        _measure(keyed, "Hour_Of_Day", name, measure), "Hour_Of_Day", cal.HOURS, name
    )


def _measure(keyed: DataFrame, key: str, name: str, measure: Column | None) -> DataFrame:
    if measure is None:
        return value_counts(keyed, key, name)
    return group_nonnull(keyed, key).agg(sum_or_zero(measure).alias(name))


def with_money_label(df: DataFrame, amount: str, name: str) -> DataFrame:
    return df.withColumn(name, money_label(F.col(amount)))


def rows_per_day(grain: DataFrame, ts: str, name: str,
                 as_of: dt.date | None = None) -> DataFrame:
    """Rows per day on the gap-free spine up to ``as_of``."""
    days = grain.select(cal.day(F.col(ts)).alias("day"))
    return series.date_spine(value_counts(days, "day", name), "day", name, as_of)


def page(grain: DataFrame, ts: str, name: str, measure: Column | None = None,
         gap_free: bool = False, as_of: dt.date | None = None) -> DataFrame:
    """Every calendar profile at once: ``profile``, ``position``, ``label`` and the measure.

    Profiles are ``category`` (weekday, weekend), ``weekday``, ``hour``, ``day``, ``month``,
    ``quarter`` and ``year``; rows of the first three are all there, with 0 if need be.
    ``gap_free`` lists all days up to ``as_of`` (today by default) in the series, and none
    after it. ``position`` sorts a profile's rows.

    The rows are added up once, per day and hour; all profiles come from these sums, of
    which there are 24 a calendar day however large the table is.
    """
    amount = F.count(F.lit(1)) if measure is None else sum_or_zero(measure)
    slots = grain.groupBy(
        cal.day(F.col(ts)).alias("day"), cal.hour_of_day(F.col(ts)).alias("hour")
    ).agg(amount.alias("amount"))
    zero = F.lit(0).cast(slots.schema["amount"].dataType)
    listed = F.lit(True)
    if gap_free:
        last = F.current_date() if as_of is None else F.lit(as_of).cast("date")
        listed = F.col("day") <= last
        slots = _with_missing_days(slots, last, zero)
    domain = grain.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*_fixed_rows(zero))))
    found = slots.select(F.inline(F.array(*_profile_rows(listed))), "amount")
    rows = found.where(F.col("label").isNotNull()).unionByName(domain)
    return rows.groupBy("profile", "position", "label").agg(F.sum("amount").alias(name))


def _with_missing_days(slots: DataFrame, last: Column, zero: Column) -> DataFrame:
    """Sums per day and hour, and for each missing day before ``last`` one without an hour.

    The window has no key; it orders the sums, 24 a calendar day at most.
    """
    following = F.lead("day").over(Window.orderBy("day", "hour"))
    slots = slots.withColumn("following", following)
    until = F.least(F.coalesce(F.date_sub("following", 1), last), last)
    after = F.date_add("day", 1)
    missing = F.when(after <= until, F.sequence(after, until))
    own = F.array(F.struct("day", F.col("hour"), F.col("amount")))
    filled = F.transform(
        F.coalesce(missing, F.array().cast("array<date>")),
        lambda day: F.struct(day.alias("day"), F.lit(None).cast("int").alias("hour"), zero.alias("amount")),
    )
    return slots.select(F.inline(F.concat(own, filled)))


def _row(profile: str, position: Column, label: Column) -> Column:
    return F.struct(
        F.lit(profile).alias("profile"), position.cast("long").alias("position"), label.alias("label")
    )


def _profile_rows(listed: Column) -> list[Column]:
    """The row of each profile that a day and hour belong to; without a label where none."""
    day, hour = F.col("day"), F.col("hour")
    weekend = cal.is_weekend(day)
    rows = [
        _row("category", weekend.cast("int"), F.when(weekend, cal.WEEKEND).otherwise(cal.WEEKDAY)),
        _row("weekday", F.weekday(day), cal.weekday_name(day)),
        _row("hour", hour, hour.cast("string")),
    ]
    series_labels = {
        "day": day.cast("string"),
        "month": cal.month_text(day),
        "quarter": cal.quarter(day),
        "year": cal.year(day).cast("string"),
    }
    for profile, label in series_labels.items():
        shown = F.when(listed, label)
        rows.append(_row(profile, F.regexp_replace(shown, "[-Q]", ""), shown))
    return rows


def _fixed_rows(zero: Column) -> list[Column]:
    labels = [
        *(("category", i, label) for i, label in enumerate((cal.WEEKDAY, cal.WEEKEND))),
        *(("weekday", i, label) for i, label in enumerate(cal.WEEKDAY_NAMES)),
        *(("hour", hour, str(hour)) for hour in cal.HOURS),
    ]
    return [
        F.struct(
            F.lit(profile).alias("profile"), F.lit(position).cast("long").alias("position"),
            F.lit(label).alias("label"), zero.alias("amount"),
        )
        for profile, position, label in labels
    ]
