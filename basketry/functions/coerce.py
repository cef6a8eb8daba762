"""Text to typed values; text that does not parse becomes null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Texts the usual CSV readers take for a missing value.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)


def missing_to_null(text: Column) -> Column:
    """Null for empty text and the usual markers of a missing value."""
    return F.when(~text.isin(*MISSING_TEXT), text)


def to_id(text: Column) -> Column:
    """Text of an id, without white space around it; ``1005.0`` becomes ``1005``."""
    return F.regexp_replace(F.trim(text), r"^([+-]?[0-9]+)\.0*$", "$1")


#: Forms tried after ISO, in this order, where a column's text is not ISO.
TIME_FORMATS = (
    "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
)


def to_utc_timestamp(text: Column, formats: Iterable[str] = ()) -> Column:
    """Timestamp without zone, holding UTC; null where the text is no time.

    ISO forms (with or without offset) are read first, then ``formats`` in turn.
    Needs a session in UTC (``basketry.session.apply_settings``): the parsed
    instant is stripped of its zone in the session's zone.
    """
    read = [F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(form)) for form in formats)]
    return F.coalesce(*read).cast("timestamp_ntz")


def to_number(text: Column, data_type: str = "double") -> Column:
    """Number of the given type; null where the text is no such number."""
    return text.try_cast(data_type)


def to_whole_number(text: Column) -> Column:
    """Whole number, also from text such as ``"1005.0"``; null otherwise."""
    exact = text.try_cast("decimal(38,6)")
    return F.when(exact == F.floor(exact), exact).try_cast("bigint")
