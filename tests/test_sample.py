"""The sample views, and invariants across queries on the whole sample."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.catalog import QUERIES
from basketry.sources import sample


def run(spark, sample_dir, name):
    return QUERIES[name].on_sample(spark, sample_dir)


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_keys_the_views_rely_on(spark, sample_dir):
    read = lambda t: spark.read.parquet(f"{sample_dir}/{t}.parquet")
    for table, key in (("part", "p_partkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"),
                       ("nation", "n_nationkey"), ("region", "r_regionkey")):
        assert read(table).groupBy(key).count().where("count > 1").count() == 0
    lines, heads = read("lineitem"), read("orders")
    assert lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count() == 0
    # the event feed is in time order, so event_id orders events as (ts, event_id) does
    events = read("events").toPandas().sort_values("event_id")
    assert events["ts"].is_monotonic_increasing and events["event_id"].is_unique


def test_order_lines_are_complete(spark, sample_dir):
    rows = sample.orders(spark, sample_dir)
    read = lambda t: spark.read.parquet(f"{sample_dir}/{t}.parquet")
    lines, heads = read("lineitem"), read("orders")
    without = heads.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count()
    assert without > 0
    assert rows.count() == lines.count() + without
    assert rows.where("Product_ID is null").count() == without


@pytest.mark.parametrize("table", ["orders", "journey", "customers", "products", "abandoned"])
def test_leaving_columns_out_changes_no_row(spark, sample_dir, table):
    whole = sample.TABLES[table](spark, sample_dir)
    for column in whole.columns:
        part = sample.TABLES[table](spark, sample_dir, (column,))
        assert part.columns == [column]
        assert part.count() == whole.count(), column


def test_session_numbers_match_a_plain_walk(spark, sample_dir):
    got = sample.journey(spark, sample_dir, ("event_id", "session")).toPandas()
    events = spark.read.parquet(f"{sample_dir}/events.parquet").toPandas()
    events = events.sort_values(["user_id", "ts", "event_id"])
    gap = events.groupby("user_id")["ts"].diff()
    opens = gap.isna() | (gap > pd.Timedelta(hours=12))
    events["expected"] = opens.groupby(events["user_id"]).cumsum()
    both = events.merge(got, on="event_id")
    assert len(both) == len(events) and (both["expected"] == both["session"]).all()


def test_gap_of_exactly_twelve_hours_is_no_new_session(spark):
    events = spark.sql("""
        select * from values (1, timestamp_ntz'2024-01-01 11:00:00'),
          (1, timestamp_ntz'2024-01-01 23:00:00'), (1, timestamp_ntz'2024-01-02 11:00:00.000001'),
          (2, timestamp_ntz'2024-01-01 00:00:00'), (2, timestamp_ntz'2024-01-01 11:59:59'), (3, null)
        as t(user_id, ts)""")
    got = sample._with_sessions(events).orderBy("user_id", "ts").collect()
    assert [r.session for r in got] == [1, 1, 2, 1, 1, None]


@pytest.mark.parametrize("page, column, prefix", [
    ("ord", "order_count", "per"), ("abn", "abandoned_count", "per"),
    ("cj", "session_count", "sessions_per"), ("rev", "Order_Total_Price", "per"),
])
def test_periods_add_up(spark, sample_dir, page, column, prefix):
    sums = {
        period: total(run(spark, sample_dir, f"{page}_{prefix}_{period}"), column)
        for period in ("day", "month", "quarter", "year")
    }
    assert len({round(s, 2) for s in sums.values()}) == 1


def test_calendar_profiles_add_up(spark, sample_dir):
    orders = run(spark, sample_dir, "ord_total").first()[0]
    for name, column in (("ord_weekday_weekend", "Count"), ("ord_by_weekday_name", "Count"),
                         ("ord_by_hour", "Number_Of_Orders"), ("ord_per_day", "order_count")):
        assert total(run(spark, sample_dir, name), column) == orders
    sessions = run(spark, sample_dir, "cj_total_sessions").first()[0]
    for name, column in (("cj_sessions_weekday_weekend", "Count"),
                         ("cj_sessions_by_weekday_name", "Count"),
                         ("cj_sessions_by_hour", "Number_Of_Sessions")):
        assert total(run(spark, sample_dir, name), column) == sessions
    revenue = run(spark, sample_dir, "rev_total").first()[0]
    for name, column in (("rev_weekday_weekend", "Revenue"), ("rev_by_weekday_name", "Revenue"),
                         ("rev_by_hour", "Total_Revenue"), ("rev_per_year", "Order_Total_Price")):
        assert total(run(spark, sample_dir, name), column) == pytest.approx(revenue, rel=1e-12)


def test_histogram_covers_every_published_price(spark, sample_dir):
    published = run(spark, sample_dir, "prod_total_published").first()[0]
    assert total(run(spark, sample_dir, "prod_price_histogram"), "Count") == published


def test_queries_are_stable_under_repartition(spark, sample_dir, rows):
    for name in ("cj_sessions_weekday_weekend", "cj_top10_sessions_by_time", "cj_bounce_rate_event",
                 "cj_peak_session_rows", "ord_highest_valued", "cust_top_spend"):
        query = QUERIES[name]
        frames = [sample.TABLES[t](spark, sample_dir, c) for t, c in query.run.needs.items()]
        spread = [f.repartition(7, F.rand(3)) for f in frames]
        assert rows(query.run(*frames, **query.choices)) == rows(query.run(*spread, **query.choices))


def test_sold_and_unsold_make_up_the_catalogue(spark, sample_dir):
    products = sample.products(spark, sample_dir, ("Product_ID", "Product_Published_At"))
    sold = sample.orders(spark, sample_dir, ("Product_ID",)).distinct()
    published = products.where("Product_Published_At is not null")
    unsold = run(spark, sample_dir, "prod_unsold").count()
    assert 0 < unsold < published.count()
    assert unsold + published.join(sold, "Product_ID", "left_semi").count() == published.count()
