"""Building blocks on hand-made frames."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from basketry.operators import distribution, filters, grain, grouping, membership, ranking, series

D = Decimal


# -- filters -----------------------------------------------------------------

@pytest.fixture
def timed(frame):
    return frame(
        "id int, t timestamp_ntz",
        (1, dt.datetime(2024, 1, 1, 0, 0)), (2, dt.datetime(2024, 1, 1, 9, 0)),
        (3, dt.datetime(2024, 1, 2, 0, 0)), (4, dt.datetime(2024, 1, 2, 0, 1)), (5, None),
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def test_date_filter_defaults_stop_at_the_last_midnight(timed):
    assert ids(filters.filter_by_date(timed, "t")) == [1, 2, 3]


def test_date_filter_bounds(timed):
    day1, day2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    keep = lambda **kw: ids(filters.filter_by_date(timed, "t", **kw))
    assert keep(start=day2) == [3]
    assert keep(end=day1) == [1]
    assert keep(start=day1, end=day2) == [1, 2, 3]
    assert keep(end=day1, whole_end_day=True) == [1, 2]
    assert keep(whole_end_day=True) == [1, 2, 3, 4]


def test_date_filter_on_nothing(frame):
    assert filters.filter_by_date(frame("t timestamp_ntz", (None,)), "t").count() == 0


def test_replacements_and_lists(frame, rows):
    df = frame("a string", ("",), ("x",), (None,))
    assert rows(df.select(filters.replace_null("a", "Unknown"))) == [("",), ("Unknown",), ("x",)]
    assert rows(df.select(filters.replace_value("a", "", "None"))) == [("None",), ("x",), (None,)]
    assert rows(filters.one_of(df, "a", ["x", "y"])) == [("x",)]
    assert rows(filters.drop_nulls(df, "a")) == [("",), ("x",)]


# -- grouping ----------------------------------------------------------------

def test_grouping_drops_null_keys_and_nulls(frame, rows, one):
    df = frame(
        "k string, v int", ("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 9)
    )
    assert rows(grouping.distinct_by(df, "k", "v", "n")) == [("a", 2), ("b", 0)]
    assert rows(grouping.sum_by(df, ["k"], "v", "s")) == [("a", 4), ("b", 0)]
    assert rows(grouping.max_by_key(df, ["k"], "v")) == [("a", 2), ("b", None)]
    assert rows(grouping.min_by_key(df, ["k"], "v")) == [("a", 1), ("b", None)]
    assert rows(grouping.value_counts(df, "k", "n")) == [("a", 3), ("b", 1)]
    assert one(grouping.distinct_count(df, "v", "n")) == 3
    assert one(grouping.distinct_count(df, "v", "n", rsd=0.05)) == 3


# -- one row per key ---------------------------------------------------------

LINES = (
    # key, price, name, order
    (1, None, "Ann", 2), (1, D("5.00"), None, 1), (1, D("7.00"), "Bob", 3),
    (None, D("1.00"), "Nil", 5), (None, D("2.00"), "Nul", 4), (2, None, None, 6),
)


@pytest.fixture
def lines(frame):
    return frame("k int, price decimal(18,2), name string, row_order bigint", *LINES)


def test_first_non_null_takes_each_column_on_its_own(lines, rows):
    got = grain.first_non_null(lines, ["k"], ["price", "name"])
    assert rows(got) == [(1, D("5.00"), "Ann"), (2, None, None)]


def test_dedup_keeps_whole_rows_and_one_null_key(lines, rows):
    first = grain.dedup_rows(lines, ["k"], ["price", "name"])
    assert rows(first) == [(1, D("5.00"), None), (2, None, None), (None, D("2.00"), "Nul")]
    last = grain.dedup_rows(lines, ["k"], ["price", "name"], keep="last")
    assert rows(last) == [(1, D("7.00"), "Bob"), (2, None, None), (None, D("1.00"), "Nil")]


def test_row_at_max_takes_the_earliest_of_a_tie(frame, rows):
    df = frame(
        "k string, m int, v string, row_order bigint",
        ("a", 2, "late", 9), ("a", 2, "early", 3), ("a", 1, "first", 1),
        ("b", None, "x", 4), (None, 5, "y", 5),
    )
    assert rows(grain.row_at_max(df, ["k"], "m", ["v"])) == [("a", 2, "early")]


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(
    st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 5)),
), min_size=1, max_size=30))
def test_firsts_match_pandas(spark, data):
    pdf = pd.DataFrame(data, columns=["k", "v"]).astype("Float64")
    table = [(k, v, i) for i, (k, v) in enumerate(data)]
    df = spark.createDataFrame(table, "k int, v int, row_order int").repartition(3, "row_order")
    clean = lambda s: {None if pd.isna(k) else int(k): None if pd.isna(v) else int(v) for k, v in s}
    first = grain.first_non_null(df, ["k"], ["v"]).collect()
    assert clean((r.k, r.v) for r in first) == clean(pdf.groupby("k")["v"].first().items())
    whole = grain.dedup_rows(df, ["k"], ["v"]).collect()
    kept = pdf.drop_duplicates("k")
    assert clean((r.k, r.v) for r in whole) == clean(zip(kept["k"], kept["v"]))


# -- ranking -----------------------------------------------------------------

def test_ties_go_to_the_smaller_key_and_nulls_go_last(frame):
    df = frame("k string, m int", ("c", 5), ("a", 5), ("b", 5), ("d", 9), ("e", None))
    keys = lambda d: [r.k for r in d.collect()]
    assert keys(ranking.top_n(df, "m", 3, ["k"])) == ["d", "a", "b"]
    assert keys(ranking.bottom_n(df, "m", 2, ["k"])) == ["a", "b"]
    assert keys(ranking.top_n(df, "m", 9, ["k"])) == ["d", "a", "b", "c", "e"]
    assert keys(ranking.sort_by(df, "m", ["k"])) == ["d", "a", "b", "c", "e"]
    assert keys(ranking.sort_by(df, "m", ["k"], descending=False)) == ["a", "b", "c", "d", "e"]


def test_limits_are_checked():
    assert ranking.check_limit(200) == 200
    for wrong in (0, -1):
        with pytest.raises(ValueError):
            ranking.check_limit(wrong)


# -- fixed domains and series ------------------------------------------------

def test_fill_domain_keeps_the_order_and_ignores_strangers(frame):
    df = frame("k string, n bigint", ("b", 2), ("z", 7))
    got = series.fill_domain(df, "k", ("b", "a"), "n")
    assert [tuple(r) for r in got.collect()] == [("b", 2), ("a", 0)]


def test_two_way_share(frame, rows):
    df = frame("w boolean, m decimal(18,2)", (True, D("1.00")), (False, D("2.50")), (False, D("0.50")))
    got = series.two_way_share(df, F.col("w"), F.col("m"), ("no", "yes"), "k", "sum")
    assert rows(got) == [("no", D("3.00"), 75.0), ("yes", D("1.00"), 25.0)]
    none = series.two_way_share(df.limit(0), F.col("w"), F.col("m"), ("no", "yes"), "k", "sum")
    assert rows(none) == [("no", D("0.00"), None), ("yes", D("0.00"), None)]


def day(d, m=1):
    return dt.date(2024, m, d)


def test_date_spine_fills_gaps_up_to_the_given_day(frame, rows):
    daily = frame("day date, n bigint", (day(2), 3), (day(5), 1))
    spine = series.date_spine(daily, "day", "n", day(7))
    assert rows(spine) == [
        (day(2), 3), (day(3), 0), (day(4), 0), (day(5), 1), (day(6), 0), (day(7), 0),
    ]
    assert rows(series.date_spine(daily, "day", "n", day(3))) == [(day(2), 3), (day(3), 0)]
    assert rows(series.date_spine(daily, "day", "n", day(1))) == []
    assert rows(series.date_spine(daily.limit(0), "day", "n", day(7))) == []


def test_date_spine_ends_today_by_default(spark, frame):
    today = spark.sql("select current_date()").first()[0]
    daily = frame("day date, n bigint", (today - dt.timedelta(3), 1))
    assert series.date_spine(daily, "day", "n").count() == 4


def test_calendar_sums(frame):
    spine = frame("day date, n bigint", (day(31, 3), 1), (day(1, 4), 2), (day(1, 1), 4))
    assert [tuple(r) for r in series.by_month(spine, "day", "n").collect()] == [
        ("2024-01", "Jan 2024", 4), ("2024-03", "Mar 2024", 1), ("2024-04", "Apr 2024", 2),
    ]
    assert [tuple(r) for r in series.by_quarter(spine, "day", "n").collect()] == [
        ("2024Q1", 5), ("2024Q2", 2),
    ]
    assert [tuple(r) for r in series.by_year(spine, "day", "n").collect()] == [(2024, 7)]


# -- membership --------------------------------------------------------------

def test_not_in_is_not_fooled_by_nulls(frame, rows):
    df = frame("id int", (1,), (2,), (None,))
    other = frame("x int", (2,), (2,), (None,))
    assert rows(membership.not_in(df, "id", other, "x")) == [(1,)]


# -- quantiles and histogram -------------------------------------------------

def money_frame(spark, amounts):
    cells = [(None if a is None else D(str(a)).quantize(D("0.01")),) for a in amounts]
    return spark.createDataFrame(cells, "price decimal(18,2)").repartition(3)


amounts_lists = st.lists(
    st.one_of(
        st.none(),
        st.decimals(-50, 50, places=2),
        st.decimals(0, 9_999_999_999_999, places=2),
        st.sampled_from([D("0.00"), D("10.00"), D("19.99")]),
    ),
    max_size=25,
)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(amounts_lists)
def test_quantiles_match_numpy(spark, amounts):
    counts = distribution.amount_counts(money_frame(spark, amounts), "price")
    [got] = distribution.exact_quantiles(counts, (0.0, 0.25, 0.5, 0.75, 1.0)).collect()
    known = [float(a) for a in amounts if a is not None]
    if not known:
        assert tuple(got) == (None,) * 5
    else:
        assert np.allclose(tuple(got), np.quantile(known, (0, 0.25, 0.5, 0.75, 1)), rtol=1e-12)


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(amounts_lists)
def test_rows_before_is_a_running_count(spark, amounts):
    counts = distribution.amount_counts(money_frame(spark, amounts), "price")
    known = [a for a in amounts if a is not None]
    for row in distribution.rows_before(counts).collect():
        assert row.before == sum(a < row.amount for a in known)
        assert row.weight == sum(a == row.amount for a in known)


def brute_histogram(amounts):
    """Counts in exact fractions; bins are closed on the right, the first one on both sides."""
    known = sorted(Fraction(str(a)) for a in amounts if a is not None)
    low, spread, last = known[0], known[-1] - known[0], len(known) - 1

    def quartile(part):
        at = part * last
        return known[floor(at)] + (known[ceil(at)] - known[floor(at)]) * (at - floor(at))

    middle = quartile(Fraction(3, 4)) - quartile(Fraction(1, 4))
    bins = 5
    if middle > 0 and len(amounts) > 1:
        bins = max(1, int(float(spread) / (2 * float(middle) / len(amounts) ** (1 / 3))))
    counts = [0] * bins
    for amount in known:
        counts[max(0, ceil((amount - low) * bins / spread) - 1)] += 1
    return counts


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_approximate_quantiles_keep_their_rank(spark, accuracy):
    amounts = [(i * 7919 % 10_007) / 100 for i in range(10_007)] + [5.0] * 3000
    quantiles = (0.0, 0.1, 0.5, 0.77, 1.0)
    [found] = distribution.approx_quantiles(money_frame(spark, amounts), "price", quantiles, accuracy).collect()
    for quantile, value in zip(quantiles, found):
        below = sum(a < float(value) for a in amounts)
        upto = sum(a <= float(value) for a in amounts)
        slack = len(amounts) / accuracy + 1
        assert below - slack <= quantile * len(amounts) <= upto + slack
    [none] = distribution.approx_quantiles(money_frame(spark, [None]), "price", (0.5,)).collect()
    assert none.q0 is None


@pytest.mark.parametrize("amounts", [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
    [0.1 * i for i in range(200)],
    [900 + (i * 37 % 400) / 10 for i in range(300)],
    [5, 5, 5, 5, 5, 5, 5, 9],
    [None, 1, 2.5, 2.5, 4, None, 19.99, 3],
    [0, 0, 0.5, 1000],
])
def test_histogram_matches_brute_force(spark, amounts):
    got = distribution.equal_width_histogram(money_frame(spark, amounts), "price")
    counts = [r.Count for r in got.orderBy("bin").collect()]
    assert counts == brute_histogram(amounts)
    assert sum(counts) == sum(a is not None for a in amounts)


def test_histogram_labels(spark):
    got = distribution.equal_width_histogram(money_frame(spark, range(11)), "price").orderBy("bin")
    labels = [r.Price_Range for r in got.collect()]
    assert labels[0].startswith("0 - ")  # the first edge lies below zero
    assert labels[-1].endswith(" - 10.0")
    assert got.first().bin_left == 0.0


def test_histogram_of_equal_amounts_and_of_none(spark):
    [row] = distribution.equal_width_histogram(money_frame(spark, [8, 8, 8]), "price").collect()
    assert (row.Price_Range, row.Count) == ("7.99 - 8.01", 3)
    assert distribution.equal_width_histogram(money_frame(spark, [None]), "price").count() == 0
    assert distribution.equal_width_histogram(money_frame(spark, []), "price").count() == 0
