"""Text clean-up and the labels reported next to numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def id_text(identifier: Column) -> Column:
    """Identifier as text without a trailing ``.0``; ``nan`` when missing."""
    text = F.regexp_replace(identifier.cast("string"), r"\.0$", "")
    return F.coalesce(text, F.lit("nan"))


def without_commas(identifier: Column) -> Column:
    return F.regexp_replace(identifier.cast("string"), ",", "")


def date_part(iso_text: Column) -> Column:
    """Date in front of the ``T`` of an ISO text; null where it is no date."""
    return F.split(iso_text, "T")[0].try_cast("date")


def duration_label(seconds: Column) -> Column:
    """``"2 hr 5 mini"``, rounded down to the minute; null for null."""
    hours = F.floor(seconds / 3600)
    minutes = F.floor((seconds % 3600) / 60)
    return F.concat(
        hours.cast("string"), F.lit(" hr "), minutes.cast("string"), F.lit(" mini")
    )


def decimal_text(number: Column) -> Column:
    """At most two decimals and at least one: ``901.0``, ``12.5``, ``12.25``."""
    return F.regexp_replace(number.cast("decimal(38,2)").cast("string"), "0$", "")


def money_label(amount: Column) -> Column:
    """Amount in euro, rounded half to even: ``€1234.5``."""
    return F.concat(F.lit("€"), decimal_text(F.bround(amount, 2)))


def percent_label(percentage: Column) -> Column:
    """One decimal, rounded half to even: ``71.4%``."""
    one_decimal = F.bround(percentage, 1).cast("decimal(38,1)")
    return F.concat(one_decimal.cast("string"), F.lit("%"))
