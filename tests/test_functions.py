"""Column expressions on hand-made values."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.functions import calendar as cal, coerce, ratios, text


def values(spark, schema, items, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {schema}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def at(*parts):
    return dt.datetime(*parts)


def test_timestamps_become_utc(spark):
    got = values(
        spark, "string",
        ["2024-01-05 10:20:30", "2024-01-05T10:20:30+02:00", "2024-01-05 10:20:30 +0100",
         "2024-01-05", "yesterday", "", None],
        coerce.to_utc_timestamp,
    )
    assert got == [
        at(2024, 1, 5, 10, 20, 30), at(2024, 1, 5, 8, 20, 30), at(2024, 1, 5, 9, 20, 30),
        at(2024, 1, 5), None, None, None,
    ]


def test_numbers_and_bad_text(spark):
    assert values(spark, "string", ["1.5", "x", None], coerce.to_number) == [1.5, None, None]
    assert values(spark, "string", ["1005.0", "7", "1.5", "x"], coerce.to_whole_number) == [
        1005, 7, None, None,
    ]
    assert values(spark, "string", ["", "NaN", "nan", "Nan", "a"], coerce.missing_to_null) == [
        None, None, None, "Nan", "a",
    ]


def test_calendar(spark):
    friday, saturday = at(2024, 3, 29, 23, 59), at(2024, 3, 30, 0, 0)
    times = [friday, saturday, None]
    run = lambda expression: values(spark, "timestamp_ntz", times, expression)
    assert run(cal.weekday_name) == ["Friday", "Saturday", None]
    assert run(cal.hour_of_day) == [24, 1, None]
    assert run(cal.quarter) == ["2024Q1", "2024Q1", None]
    assert run(cal.year) == [2024, 2024, None]
    assert run(cal.month_start) == [dt.date(2024, 3, 1)] * 2 + [None]
    assert run(lambda c: cal.month_label(cal.day(c))) == ["Mar 2024"] * 2 + [None]
    assert run(lambda c: cal.month_text(cal.day(c))) == ["2024-03"] * 2 + [None]


def test_all_seven_day_names_in_order(spark):
    days = [at(2024, 1, d) for d in range(1, 8)]  # 2024-01-01 was a Monday
    assert tuple(values(spark, "timestamp_ntz", days, cal.weekday_name)) == cal.WEEKDAY_NAMES


def test_calendar_does_not_depend_on_the_session_zone(spark):
    clock_change = [at(2024, 3, 10, 2, 30)]  # does not exist in New York
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, "timestamp_ntz", clock_change, cal.hour_of_day) == [3]
        assert values(spark, "timestamp_ntz", clock_change, cal.weekday_name) == ["Sunday"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ids(spark):
    assert values(spark, "string", ["1005", "1005.0", "10.05", None], text.id_text) == [
        "1005", "1005", "10.05", "nan",
    ]
    assert values(spark, "bigint", [7010, None], text.id_text) == ["7010", "nan"]
    assert values(spark, "string", ["1,005"], text.without_commas) == ["1005"]
    assert values(spark, "string", ["2024-02-01T10:00:00Z", "2024-02-01", "T", None], text.date_part) == [
        dt.date(2024, 2, 1), dt.date(2024, 2, 1), None, None,
    ]


def test_durations(spark):
    got = values(spark, "double", [0.0, 59.9, 3600.0, 7325.5, None], text.duration_label)
    assert got == ["0 hr 0 mini", "0 hr 0 mini", "1 hr 0 mini", "2 hr 2 mini", None]


@pytest.mark.parametrize("number", [0.0, 0.125, 0.135, 901.0, 12.5, 12.25, 99999.995, 1e9])
def test_labels_match_rounded_floats(spark, number):
    import numpy as np

    assert values(spark, "double", [number], text.money_label) == [f"€{np.round(number, 2)}"]
    assert values(spark, "double", [number], text.percent_label) == [f"{np.round(number, 1)}%"]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a int, b int").orderBy("b")
    assert [r[0] for r in df.select(ratios.percentage(F.col("a"), F.col("b"))).collect()] == [
        None, 25.0,
    ]
    empty = spark.createDataFrame([(None,)], "v decimal(18,2)")
    [row] = empty.agg(ratios.sum_or_zero(F.col("v")), ratios.exact_mean(F.col("v"))).collect()
    assert tuple(row) == (0, None)
    assert values(spark, "double", [0.125, 0.375, 2.5], lambda c: ratios.rounded(c, 2)) == [
        0.12, 0.38, 2.5,
    ]


def test_shuffle_partitions_follow_the_input():
    from basketry.session import shuffle_partitions

    assert shuffle_partitions(0) == 200
    assert shuffle_partitions(100 * 1024**4) == 819_200
