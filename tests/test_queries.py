"""Queries on hand-made tables: nulls, ties, order of rows, empty input."""

from __future__ import annotations

import datetime as dt
import inspect
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basketry.catalog import QUERIES
from basketry.plans import abandoned, customers, journey, orders, products, revenue
from basketry.sources.schemas import SCHEMAS, MissingColumnsError

D = Decimal
AT = dt.datetime


@pytest.fixture
def order_lines(frame):
    """Four orders; order 1 starts with an unknown price, order 4 has no time."""
    return frame(
        "row_order bigint, Order_ID bigint, Customer_ID bigint, Customer_Name string, "
        "Order_Total_Price decimal(18,2), Order_Refund_Amount decimal(18,2), "
        "Order_Created_At timestamp_ntz, Order_Cancelled_At string, Order_Referring_Site string, "
        "Product_ID bigint, Product_Name string, Product_Quantity bigint",
        (1, 1, 10, "Ann", None, D("1.00"), AT(2024, 1, 6, 0, 5), "x", "web", 7, "cup", 2),
        (2, 1, 10, "Ann", D("20.00"), D("9.00"), AT(2024, 1, 6, 0, 5), "x", "web", 8, "pot", 1),
        (3, 2, 10, "Ann", D("5.00"), None, AT(2024, 1, 8, 23, 59), None, None, 7, "cup", None),
        (4, 3, 11, "Bob", D("7.50"), D("0.50"), AT(2024, 1, 8, 12, 0), None, "app", None, None, 3),
        (5, None, 12, None, D("3.00"), D("0.00"), AT(2024, 1, 8, 0, 0), None, "web", 9, "pan", 1),
        (6, 4, None, "Cy", D("1.00"), D("0.00"), None, None, "app", 9, "pan", 1),
    )


def test_order_counts(order_lines, one):
    assert one(orders.total(order_lines)) == 4
    assert one(customers.total_paying(order_lines)) == 3
    assert one(orders.cancelled(order_lines)) == 2  # lines, not orders
    assert one(orders.avg_per_customer(order_lines)) == 1.0  # 2, 1 and 0 orders
    assert one(orders.max_per_customer(order_lines)) == 2
    assert one(products.avg_per_customer(order_lines)) == 1.0  # 2, 0 and 1 products


def test_a_page_of_profiles_equals_the_single_queries(order_lines):
    until = dt.date(2024, 2, 2)

    def profile(page, name, measure):
        return {r.label: r[measure] for r in page.where(F.col("profile") == name).orderBy("position").collect()}

    def single(df, key, measure):
        return {str(r[key]): r[measure] for r in df.collect()}

    found = orders.page(order_lines, as_of=until)
    for name, query, key, measure in (
        ("category", orders.weekday_weekend(order_lines), "Category", "Count"),
        ("weekday", orders.by_weekday_name(order_lines), "Day", "Count"),
        ("hour", orders.by_hour(order_lines), "Hour_Of_Day", "Number_Of_Orders"),
        ("day", orders.per_day(order_lines, as_of=until), "day", "order_count"),
        ("month", orders.per_month(order_lines, as_of=until), "month", "order_count"),
        ("quarter", orders.per_quarter(order_lines, as_of=until), "quarter", "order_count"),
        ("year", orders.per_year(order_lines, as_of=until), "year", "order_count"),
    ):
        want = single(query, key, measure)
        assert list(profile(found, name, "order_count").items()) == list(want.items()), name
    assert profile(found, "month", "order_count") == {"2024-01": 3, "2024-02": 0}

    early = orders.page(order_lines, as_of=dt.date(2024, 1, 7))
    assert profile(early, "day", "order_count") == {"2024-01-06": 1, "2024-01-07": 0}
    assert sum(profile(early, "weekday", "order_count").values()) == 3

    found = revenue.page(order_lines)
    price = "Order_Total_Price"
    assert profile(found, "day", price) == single(revenue.per_day(order_lines), "day", price)
    assert profile(found, "hour", price) == single(revenue.by_hour(order_lines), "Hour_Of_Day", "Total_Revenue")
    assert profile(found, "category", price) == single(revenue.weekday_weekend(order_lines), "Category", "Revenue")


def test_first_known_price_against_first_line(order_lines, one, rows):
    # mean of 20, 5, 7.5 and 1: the first known price per known order
    assert one(orders.avg_value(order_lines)) == 8.38
    # whole first lines, the one without order id included: null, 5, 7.5, 3, 1
    assert one(revenue.total(order_lines)) == D("16.50")
    assert one(revenue.average(order_lines)) == 4.12
    assert one(revenue.refund_total(order_lines)) == D("1.50")
    assert rows(customers.order_summary(order_lines)) == [("Ann", 2, D("25.00"))]
    assert one(customers.repeat_count(order_lines)) == 1
    spend = [tuple(r) for r in customers.top_spend(order_lines).collect()]
    assert spend == [("Bob", D("7.50")), ("Ann", D("5.00")), ("Cy", D("1.00"))]
    least = [r.Customer_Name for r in customers.least_spend(order_lines, n=2).collect()]
    assert least == ["Cy", "Ann"]


def test_valued_orders_rank_the_first_order(order_lines):
    got = [tuple(r) for r in orders.highest_valued(order_lines).collect()]
    # Ann: first id 1, first known price 20, taken from different lines
    assert got == [("Ann", 1, D("20.00")), ("Bob", 3, D("7.50")), ("Cy", 4, D("1.00"))]
    assert [r.Customer_Name for r in orders.least_valued(order_lines, n=1).collect()] == ["Cy"]


def test_referring_sites(order_lines, rows):
    assert rows(orders.by_referring_site(order_lines)) == [("app", 2), ("web", 1)]
    assert rows(revenue.by_referring_site(order_lines)) == [("app", D("8.50")), ("web", D("3.00"))]


def test_order_calendar(order_lines, rows):
    # the order without a time is a weekday one, but has no day and no hour
    assert rows(orders.weekday_weekend(order_lines)) == [
        ("Weekday", 3, 75.0, "75.0%"), ("Weekend", 1, 25.0, "25.0%"),
    ]
    days = {r.Day: r.Count for r in orders.by_weekday_name(order_lines).collect()}
    assert days["Monday"] == 2 and days["Saturday"] == 1 and sum(days.values()) == 3
    hours = {r.Hour_Of_Day: r.Number_Of_Orders for r in orders.by_hour(order_lines).collect()}
    assert len(hours) == 24 and (hours[1], hours[13], hours[24]) == (1, 1, 1)
    assert rows(orders.per_day(order_lines, as_of=dt.date(2024, 1, 9))) == [
        (dt.date(2024, 1, 6), 1), (dt.date(2024, 1, 7), 0),
        (dt.date(2024, 1, 8), 2), (dt.date(2024, 1, 9), 0),
    ]


def test_revenue_calendar(order_lines, rows):
    assert [tuple(r)[:2] + tuple(r)[4:] for r in revenue.weekday_weekend(order_lines).collect()] == [
        ("Weekday", D("16.50"), "€16.5"), ("Weekend", D("0.00"), "€0.0"),
    ]
    # no spine: only days with orders, the unknown price counts as 0
    assert rows(revenue.per_day(order_lines)) == [
        (dt.date(2024, 1, 6), D("0.00")), (dt.date(2024, 1, 8), D("15.50")),
    ]
    hours = {r.Hour_Of_Day: r.Overall_Revenue for r in revenue.by_hour(order_lines).collect()}
    assert hours[1] == "€3.0" and hours[2] == "€0.0" and hours[24] == "€5.0"
    labels = {r.Day: r.Total_Revenue for r in revenue.by_weekday_name(order_lines).collect()}
    assert labels["Monday"] == "€15.5" and labels["Sunday"] == "€0.0"


@pytest.fixture
def checkouts(frame):
    return frame(
        "row_order bigint, Order_ID bigint, Customer_ID bigint, Order_Created_At timestamp_ntz, "
        "Order_Referring_Site string",
        (1, 1, 10, AT(2024, 1, 6), "web"), (2, 2, 10, AT(2024, 1, 7), None),
        (3, 3, 10, AT(2024, 1, 8), "web"), (4, 4, 11, AT(2024, 1, 8), None),
        (5, None, 11, None, "web"), (6, None, 11, None, "web"),
    )


def test_abandoned_checkouts(checkouts, one, rows):
    assert one(abandoned.total(checkouts)) == 4
    assert one(abandoned.avg_per_customer(checkouts)) == 2
    assert one(abandoned.max_per_customer(checkouts)) == 3
    # missing ids count as one order, missing sites as "Unknown"
    assert rows(abandoned.by_referring_site(checkouts)) == [("Unknown", 2), ("web", 3)]
    assert rows(abandoned.weekday_weekend(checkouts))[1] == ("Weekend", 2, 50.0, "50.0%")


def test_average_of_abandoned_orders_is_cut_off(checkouts, one):
    assert one(abandoned.avg_per_customer(checkouts.where("coalesce(Order_ID, 0) <> 3"))) == 1


@pytest.fixture
def events(frame):
    """Visitor a has two sessions, b one; c has no session, one event no visitor."""
    return frame(
        "row_order bigint, Customer_IP string, session bigint, Event_Time timestamp_ntz, "
        "Event string, Time_On_Page decimal(18,2), Product_ID bigint, Product_Name string, "
        "Collection_Name string, Search_Term string",
        (1, "a", 1, None, "Home", D("5.00"), None, None, None, "mug"),
        (2, "a", 1, AT(2024, 1, 6, 23, 0), "Product", D("9.00"), 1005, "cup", "tea", None),
        (3, "a", 1, AT(2024, 1, 7, 1, 0), "Cart Add", D("90.00"), 1005, "cup", "tea", None),
        (4, "a", 2, AT(2024, 1, 8, 9, 0), "Home", D("12.00"), None, "cup", "tea", "mug"),
        (5, "b", 1, AT(2024, 1, 8, 9, 30), "Product", None, 7010, "pot", "tea", "pan"),
        (6, "c", None, AT(2024, 1, 8, 10, 0), "Home", D("4.00"), 7010, "pot", None, None),
        (7, None, 3, AT(2024, 1, 8, 10, 0), "Cart", D("4.00"), 7010, "pot", "jar", None),
    )


def test_sessions(events, one, rows):
    assert one(journey.total_viewers(events)) == 3
    assert one(journey.repeat_viewers(events)) == 1
    assert one(journey.total_sessions(events)) == 3
    assert one(journey.avg_sessions_per_customer(events)) == 1.5
    assert [tuple(r) for r in journey.top_ips_by_session(events).collect()] == [
        ("a", 2), ("b", 1), ("c", None),
    ]
    peaks = journey.peak_session_rows(events).select("Customer_IP", "session", "Event")
    assert rows(peaks) == [("a", 2, "Home"), ("b", 1, "Product")]
    assert rows(journey.sessions_per_day(events, as_of=dt.date(2024, 1, 8))) == [
        (dt.date(2024, 1, 6), 1), (dt.date(2024, 1, 7), 1), (dt.date(2024, 1, 8), 2),
    ]


def test_session_calendar(events, rows):
    # the first event of session (a, 1) has no time: a weekday session that
    # takes its day and hour from the next event
    assert rows(journey.sessions_weekday_weekend(events))[0][:2] == ("Weekday", 3)
    days = {r.Day: r.Count for r in journey.sessions_by_weekday_name(events).collect()}
    assert days["Saturday"] == 1 and days["Monday"] == 2 and sum(days.values()) == 3
    hours = {r.Hour_Of_Day: r.Number_Of_Sessions for r in journey.sessions_by_hour(events).collect()}
    assert hours[24] == 1 and hours[10] == 2 and len(hours) == 24


def test_session_times(events, rows):
    [row] = journey.session_duration(events).collect()
    assert (row.total_seconds, row.total_duration) == (D("116.00"), "0 hr 1 mini")
    assert row.average_seconds == pytest.approx(116 / 3)  # b's unknown time counts as 0
    top = [tuple(r) for r in journey.longest_sessions(events).collect()]
    assert top == [
        ("a", "0 hr 1 mini", dt.date(2024, 1, 6)),
        ("a", "0 hr 0 mini", dt.date(2024, 1, 8)),
        ("b", "0 hr 0 mini", dt.date(2024, 1, 8)),
    ]


def test_views_and_carts(events, one, rows):
    assert [tuple(r) for r in journey.top_products_viewed(events).collect()] == [("pot", 2), ("cup", 1)]
    assert [tuple(r) for r in journey.top_collections_viewed(events).collect()] == [("tea", 2), ("jar", 0)]
    assert rows(journey.top_cart_products(events)) == [("cup", 1)]
    assert one(journey.cart_total(events)) == 1
    assert rows(journey.search_term_freq(events, weights=True)) == [("mug", 2, 1.0), ("pan", 1, 0.5)]
    assert journey.search_term_freq(events).columns == ["Search_Term", "Count"]
    assert rows(journey.top_cart_products(events, n=9)) == [("cup", 1)]


def test_page_times(events, rows):
    assert rows(journey.total_time_per_event(events)) == [
        ("Cart", D("4.00"), "0 hr 0 mini"), ("Home", D("21.00"), "0 hr 0 mini"),
        ("Product", D("9.00"), "0 hr 0 mini"),
    ]
    means = {r.Event: r.Time_On_Page for r in journey.avg_time_per_event(events).collect()}
    assert means == {"Cart": 4.0, "Home": 7.0, "Product": 9.0}
    assert [tuple(r)[:3] for r in journey.time_per_product(events).collect()] == [
        ("1005", "cup", D("99.00")), ("nan", "cup", D("12.00")), ("7010", "pot", D("8.00")),
    ]
    assert [r.Collection_Name for r in journey.time_per_collection(events).collect()] == ["tea", "jar"]
    assert rows(journey.viewers_per_event(events)) == [("Cart", 0), ("Home", 2), ("Product", 2)]


def test_bounce_rates(events, one, rows):
    # totals: a 116, b 0 (unknown), c 4
    assert one(journey.bounce_rate_customer(events)) == 66.67
    # last page events: (a, 1) Product 9 s, (a, 2) Home 12 s, (b, 1) unknown,
    # (c, no session) Home 4 s; nobody known had Cart or Collection
    assert rows(journey.bounce_rate_event(events)) == [
        ("Cart", 0.0), ("Collection", 0.0), ("Home", 50.0), ("Product", 50.0),
    ]


@pytest.fixture
def variants(frame):
    return frame(
        "row_order bigint, Product_ID bigint, Product_Title string, Product_Type string, "
        "Product_Published_At string, Product_Created_At timestamp_ntz, Variant_Price decimal(18,2)",
        (1, 7, "cup", "tea", "2024-02-01T08:00:00Z", AT(2024, 1, 1), D("4.00")),
        (2, 7, "cup", "tea", "2024-02-01T08:00:00Z", AT(2024, 1, 1), D("6.00")),
        (3, 8, "pot", "", "2024-01-15T08:00:00Z", AT(2024, 1, 2), D("6.00")),
        (4, 9, "pan", None, "2024-01-10T08:00:00Z", AT(2024, 1, 3), None),
        (5, 5, "jar", "tea", None, AT(2024, 1, 4), D("1.00")),
        (6, 3, "lid", "tea", "2024-01-20T08:00:00Z", AT(2024, 1, 4, 1), D("5.00")),
        (7, 3, "lid", "tea", "2024-01-20T08:00:00Z", AT(2024, 1, 4, 1), D("5.00")),
    )


def test_products(variants, order_lines, one, rows):
    assert one(products.total_published(variants)) == 4
    assert rows(products.count_by_type(variants)) == [("No Type", 1), ("tea", 2)]
    assert [tuple(r) for r in products.most_priced(variants, n=3).collect()] == [
        (7, "cup", D("6.00")), (8, "pot", D("6.00")), (3, "lid", D("5.00")),
    ]
    assert [tuple(r) for r in products.least_priced(variants, n=2).collect()] == [
        (7, "cup", D("4.00")), (3, "lid", D("5.00")),
    ]
    assert [tuple(r) for r in products.most_sold(order_lines).collect()] == [
        ("cup", 2), ("pan", 2), ("pot", 1),
    ]
    assert [tuple(r) for r in products.unsold(variants, order_lines).collect()] == [
        ("3", "lid", dt.date(2024, 1, 20)),
    ]
    assert sum(r.Count for r in products.price_histogram(variants).collect()) == 5
    assert products.filtered(variants).count() == 5  # the last day's 01:00 is left out
    assert "row_order" not in products.filtered(variants).columns


def empty_table(spark, table, columns):
    known = {f.name: f.dataType.simpleString() for f in SCHEMAS[table]} | {"row_order": "bigint"}
    names = known if columns is None else columns
    return spark.createDataFrame([], ", ".join(f"{c} {known[c]}" for c in names))


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("load_")])
def test_empty_tables(spark, name):
    query = QUERIES[name]
    frames = [empty_table(spark, t, c) for t, c in query.run.needs.items()]
    got = query.run(*frames, **query.choices).collect()
    if name.endswith(("weekday_weekend", "weekday_name", "by_hour")):
        assert len(got) in (2, 7, 24)
        assert all(not v for r in got for k, v in r.asDict().items()
                   if k in ("Count", "Revenue", "Percentage"))
    elif name.endswith("_page"):
        assert sorted({r[0] for r in got}) == ["category", "hour", "weekday"] and len(got) == 33
        assert not any(r[3] for r in got)
    elif name == "cj_bounce_rate_event":
        assert [r.Bounce_Rate for r in got] == [0.0] * 4
    elif len(got) == 1:
        assert not any(v for v in got[0].asDict().values() if not isinstance(v, str))
    else:
        assert got == []


def test_missing_columns_are_named(order_lines):
    with pytest.raises(MissingColumnsError, match="Customer_Name, Order_Total_Price"):
        customers.top_spend(order_lines.drop("Customer_Name", "Order_Total_Price"))
    with pytest.raises(TypeError, match="orders"):
        customers.top_spend()


def test_any_positive_limit_will_do(order_lines, events, checkouts):
    for query, frame in (
        (customers.top_spend, order_lines), (customers.least_spend, order_lines),
        (orders.highest_valued, order_lines), (orders.least_valued, order_lines),
        (abandoned.by_referring_site, checkouts), (journey.top_ips_by_session, events),
        (journey.top_products_viewed, events), (journey.top_collections_viewed, events),
        (journey.top_cart_products, events),
    ):
        assert query(frame, n=200).count() == len(query(frame, n=200).collect()) > 0
        with pytest.raises(ValueError):
            query(frame, n=0)
    assert inspect.signature(customers.top_spend).parameters["n"].default == 5


@pytest.mark.parametrize("query", [
    customers.order_summary, customers.top_spend, orders.highest_valued, orders.weekday_weekend,
    revenue.per_day, revenue.by_referring_site,
])
def test_results_do_not_depend_on_where_rows_are(order_lines, rows, query):
    assert rows(query(order_lines)) == rows(query(order_lines.repartition(7)))
    assert rows(query(order_lines)) == rows(query(order_lines.orderBy(F.desc("row_order"))))
