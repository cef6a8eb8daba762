"""What the optimised plans look like when no table is small.

With broadcasts switched off by size, the plans are those of large tables; the
only broadcasts left are results on a fixed domain.
"""

from __future__ import annotations

import re

import pytest

from basketry.catalog import QUERIES
from basketry.plans import orders, revenue
from basketry.sources.files import read_csv

FIXED_DOMAIN = ("weekday_name", "by_hour", "cj_bounce_rate_event")


@pytest.fixture(scope="module")
def large(spark):
    """No automatic broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_plans: dict[str, str] = {}


def plan_of(spark, sample_dir, name):
    if name not in _plans:
        df = QUERIES[name].on_sample(spark, sample_dir)
        _plans[name] = df._jdf.queryExecution().executedPlan().toString()
    return _plans[name]


@pytest.mark.parametrize("name", QUERIES)
def test_plan_scales(large, sample_dir, name):
    plan = plan_of(large, sample_dir, name)
    # no pairs of everything with everything, no Python workers, nothing cached
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InMemory"):
        assert operator not in plan.replace("InMemoryFileIndex", "")
    if not name.endswith(FIXED_DOMAIN):
        assert "BroadcastExchange" not in plan
    # windows without a key only order days or leading digits of amounts
    for window in re.findall(r"Window \[.*?windowspecdefinition\(([^()]*(?:\([^()]*\))?[^()]*)\)", plan):
        first = window.split(",")[0]
        if re.search(r" ASC| DESC", first):
            assert re.match(r"(day|high)#", first), window


def test_distinct_orders_and_customers_read_no_lines(large, sample_dir):
    for name in ("ord_total", "ord_max_per_customer", "cust_total_paying"):
        assert "lineitem.parquet" not in plan_of(large, sample_dir, name)


def scans(plan, table):
    """Files of a table that are really read (an exchange that is reused counts once)."""
    return plan.count(f"/{table}.parquet]")


def test_sessions_without_events_are_numbered_in_one_scan(large, sample_dir):
    for name in ("cj_repeat_viewers", "cj_total_sessions", "cj_avg_sessions_per_customer", "cj_top_ips_by_session"):
        assert scans(plan_of(large, sample_dir, name), "events") == 1, name


def test_order_filters_reach_both_branches(large, sample_dir):
    for name in ("ord_filtered", "rev_filtered", "ord_cancelled"):
        plan = plan_of(large, sample_dir, name)
        filters = [line for line in plan.splitlines() if "Filter " in line and "o_order" in line]
        assert scans(plan, "lineitem") == 2 and len(filters) >= 2, plan
    assert scans(plan_of(large, sample_dir, "prod_avg_per_customer"), "lineitem") == 1


def test_date_ranges_of_orders_reach_the_scan(large, sample_dir):
    for name in ("ord_filtered", "rev_filtered"):
        plan = plan_of(large, sample_dir, name)
        assert re.search(r"PushedFilters: \[[^]]*LessThanOrEqual\(o_orderdate,ScalarSubquery", plan), plan


def test_amounts_are_counted_in_one_scan(large, sample_dir):
    for name in ("prod_price_histogram", "prod_price_quartiles", "prod_price_quantiles"):
        assert scans(plan_of(large, sample_dir, name), "part") <= 1, name


def test_filters_and_columns_reach_the_scan(large, sample_dir):
    plan = plan_of(large, sample_dir, "cj_total_time_per_event")
    assert "In(event_type, [click,error,signup,view])" in plan
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
    filtered = plan_of(large, sample_dir, "cj_filtered")
    assert re.search(r"PushedFilters: \[IsNotNull\(ts\), LessThanOrEqual\(ts,ScalarSubquery", filtered)


def test_sessions_are_picked_by_hash_aggregates(large, sample_dir):
    for name in ("cj_sessions_by_hour", "cj_sessions_weekday_weekend", "cj_bounce_rate_event",
                 "cj_top10_sessions_by_time"):
        assert "SortAggregate" not in plan_of(large, sample_dir, name)


def test_order_profiles_are_picked_by_hash_aggregates(large, sample_dir):
    for name in ("ord_by_hour", "ord_avg_value", "rev_total", "rev_per_day", "abn_by_hour"):
        assert "SortAggregate" not in plan_of(large, sample_dir, name), name


def test_a_page_of_profiles_reads_what_one_profile_reads(large, sample_dir):
    for page, single in (("ord_page", "ord_by_hour"), ("abn_page", "abn_by_hour"), ("rev_page", "rev_by_hour")):
        plan, one = plan_of(large, sample_dir, page), plan_of(large, sample_dir, single)
        for table in ("orders", "lineitem"):
            assert scans(plan, table) == scans(one, table), (page, table)
        assert "SortAggregate" not in plan, page


def test_loaded_files_are_aggregated_by_hash(large, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text("Order_ID,Order_Created_At,Order_Total_Price\n#1,2024-01-01 10:00:00,5\n")
    lines = read_csv(large, "orders", str(path))
    for query in (orders.by_hour, orders.avg_value, revenue.total, revenue.by_hour):
        assert "SortAggregate" not in query(lines)._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_no_full_sort(large, sample_dir):
    for name in ("cust_top_spend", "ord_least_valued", "prod_most_sold", "cj_top_products_viewed"):
        assert "TakeOrderedAndProject" in plan_of(large, sample_dir, name)
