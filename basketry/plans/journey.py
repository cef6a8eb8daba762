"""Customer-journey page: visitors, sessions, page time, bounce rates.

The table holds one row per page event. A session is identified by visitor and
per-visitor session number; visitors are counted by IP.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions import calendar as cal
from basketry.functions.ratios import exact_mean, percentage, ratio, rounded, sum_or_zero
from basketry.functions.text import duration_label, id_text
from basketry.operators import series
from basketry.operators.filters import drop_nulls, filter_by_date, one_of
from basketry.operators.grain import ORDER, first_non_null, first_value, row_at_max
from basketry.operators.grouping import (
    distinct_by, distinct_count, group_nonnull, max_by_key, sum_by, value_counts,
)
from basketry.operators.ranking import check_limit, sort_by, top_n
from basketry.plans import profiles
from basketry.plans.inputs import Whole, requires

# Event names and limits of the bounce reports.
PAGE_EVENTS = ("Cart", "Home", "Product", "Collection")
CART_EVENT = "Cart Add"
VISITOR_BOUNCE_SECONDS = 30
EVENT_BOUNCE_SECONDS = 10

_SESSION = ["Customer_IP", "session"]
_TIMED = ("Customer_IP", "session", "Event_Time", ORDER)
_SESSION_TIME = ("Customer_IP", "session", "Time_On_Page")
_PAGE_TIME = ("Event", "Time_On_Page")


@requires(journey=("Customer_IP",))
def total_viewers(journey: DataFrame) -> DataFrame:
    """Distinct visitors."""
    return distinct_count(journey, "Customer_IP", "total_viewers")


def _sessions_per_visitor(journey: DataFrame) -> DataFrame:
    """Highest session number per visitor; visitors without any are left out."""
    return max_by_key(drop_nulls(journey, "session"), ["Customer_IP"], "session")


@requires(journey=("Customer_IP", "session"))
def repeat_viewers(journey: DataFrame) -> DataFrame:
    """Visitors with at least two sessions."""
    repeated = _sessions_per_visitor(journey).where(F.col("session") >= 2)
    return repeated.agg(F.count(F.lit(1)).alias("repeat_viewers"))


@requires(journey=("Customer_IP", "session"))
def total_sessions(journey: DataFrame) -> DataFrame:
    """Sessions of all visitors."""
    return _sessions_per_visitor(journey).agg(
        sum_or_zero(F.col("session")).alias("total_sessions")
    )


@requires(journey=("Customer_IP", "session", "Event_Time", "Event", "Time_On_Page", ORDER))
def peak_session_rows(journey: DataFrame) -> DataFrame:
    """First event of each visitor's last (highest-numbered) session."""
    return row_at_max(
        journey, ["Customer_IP"], "session", ["Event_Time", "Event", "Time_On_Page"]
    )


@requires(journey=Whole(["Event_Time"]))
def filtered(journey: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
             whole_end_day: bool = False) -> DataFrame:
    """Events in the date range."""
    return filter_by_date(journey, "Event_Time", start, end, whole_end_day).drop(ORDER)


def _first_per_session(journey: DataFrame, name: str, value: Column) -> DataFrame:
    """Per session, the first known value of a fixed-width expression over its events."""
    events = journey.withColumn(name, value)
    return first_non_null(events, _SESSION, [name])


@requires(journey=_TIMED)
def sessions_weekday_weekend(journey: DataFrame) -> DataFrame:
    """Sessions on weekdays and weekends, by the first event of the session."""
    sessions = _first_per_session(journey, "weekend", cal.is_weekend(F.col("Event_Time")))
    return profiles.weekday_weekend(sessions, F.col("weekend"))


@requires(journey=_SESSION_TIME)
def session_duration(journey: DataFrame) -> DataFrame:
    """Total time of all sessions and mean time of a session."""
    per_session = sum_by(journey, ["session", "Customer_IP"], "Time_On_Page")
    return per_session.agg(
        sum_or_zero(F.col("Time_On_Page")).alias("total_seconds"),
        exact_mean(F.col("Time_On_Page")).alias("average_seconds"),
    ).select(
        "total_seconds",
        "average_seconds",
        duration_label(F.col("total_seconds")).alias("total_duration"),
        duration_label(F.col("average_seconds")).alias("average_duration"),
    )


@requires(journey=("Customer_IP", "session"))
def avg_sessions_per_customer(journey: DataFrame) -> DataFrame:
    """Mean number of sessions per visitor."""
    return _sessions_per_visitor(journey).agg(
        rounded(exact_mean(F.col("session"))).alias("average_sessions_per_customer")
    )


@requires(journey=("Customer_IP", "session", "Event_Time", "Time_On_Page", ORDER))
def longest_sessions(journey: DataFrame, n: int = 10) -> DataFrame:
    """The n sessions with most time on page and the date they began."""
    first_time = first_value(journey, "Event_Time")
    sessions = group_nonnull(journey, "session", "Customer_IP").agg(
        sum_or_zero(F.col("Time_On_Page")).alias("seconds"),
        cal.day(first_time).alias("Event_time"),
    )
    return top_n(sessions, "seconds", n, ["session", "Customer_IP"]).select(
        "Customer_IP", duration_label(F.col("seconds")).alias("Time_On_Page"), "Event_time"
    )


@requires(journey=("Customer_IP", "session"))
def top_ips_by_session(journey: DataFrame, n: int = 10) -> DataFrame:
    """The n visitors (up to 50) with most sessions."""
    check_limit(n)
    per_visitor = max_by_key(journey, ["Customer_IP"], "session")
    return top_n(per_visitor, "session", n, ["Customer_IP"])


@requires(journey=("Customer_IP", "session", "Event_Time"))
def sessions_per_day(journey: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Sessions per day up to ``as_of``; a session counts on each day it touches.

    Summing each visitor's distinct sessions is one distinct count of (visitor,
    session) pairs per day. Days whose events all lack a visitor stay unlisted.
    """
    events = drop_nulls(
        journey.withColumn("day", cal.day(F.col("Event_Time"))), "Customer_IP"
    )
    daily = group_nonnull(events, "day").agg(
        F.countDistinct("Customer_IP", "session").alias("session_count")
    )
    return series.date_spine(daily, "day", "session_count", as_of)


@requires(journey=("Customer_IP", "session", "Event_Time"))
def sessions_per_month(journey: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return series.by_month(sessions_per_day(journey, as_of=as_of), "day", "session_count")


@requires(journey=("Customer_IP", "session", "Event_Time"))
def sessions_per_quarter(journey: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return series.by_quarter(sessions_per_day(journey, as_of=as_of), "day", "session_count")


@requires(journey=("Customer_IP", "session", "Event_Time"))
def sessions_per_year(journey: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return series.by_year(sessions_per_day(journey, as_of=as_of), "day", "session_count")


@requires(journey=("Product_Name", "Customer_IP"))
def top_products_viewed(journey: DataFrame, n: int = 10) -> DataFrame:
    """The n products (up to 50) seen by most visitors."""
    check_limit(n)
    seen = distinct_by(journey, "Product_Name", "Customer_IP", "Unique_Visitors")
    return top_n(seen, "Unique_Visitors", n, ["Product_Name"])


@requires(journey=("Collection_Name", "Customer_IP"))
def top_collections_viewed(journey: DataFrame, n: int = 10) -> DataFrame:
    """The n collections (up to 50) seen by most visitors."""
    check_limit(n)
    seen = distinct_by(journey, "Collection_Name", "Customer_IP", "Unique_Visitors")
    return top_n(seen, "Unique_Visitors", n, ["Collection_Name"])


@requires(journey=("Event", "Product_Name", "Customer_IP"))
def top_cart_products(journey: DataFrame, n: int = 10, cart_event: str = CART_EVENT) -> DataFrame:
    """The n products (10 to 50) put into the cart by most visitors."""
    check_limit(n)
    added = journey.where(F.col("Event") == cart_event)
    by_product = distinct_by(added, "Product_Name", "Customer_IP", "Unique_Visitors")
    return top_n(by_product, "Unique_Visitors", n, ["Product_Name"])


@requires(journey=("Search_Term",))
def search_term_freq(journey: DataFrame, weights: bool = False) -> DataFrame:
    """Uses of each search term; ``weights`` adds the share of the most used term."""
    counts = value_counts(journey, "Search_Term", "Count")
    if not weights:
        return counts
    most = counts.agg(F.max("Count").alias("most")).scalar()
    return counts.withColumn("Weight", ratio(F.col("Count"), most))


@requires(journey=("Event", "Product_Name", "Customer_IP"))
def cart_total(journey: DataFrame, cart_event: str = CART_EVENT) -> DataFrame:
    """Products put into carts: each visitor counts once per product."""
    added = journey.where(F.col("Event") == cart_event)
    return added.agg(
        F.countDistinct("Product_Name", "Customer_IP").alias("total_added_to_cart")
    )


@requires(journey=_TIMED)
def sessions_by_weekday_name(journey: DataFrame) -> DataFrame:
    """Sessions per day of the week, by their first event with a time."""
    sessions = _first_per_session(journey, "day", cal.day(F.col("Event_Time")))
    return profiles.by_weekday_name(sessions, cal.weekday_name(F.col("day")))


@requires(journey=_TIMED)
def sessions_by_hour(journey: DataFrame) -> DataFrame:
    """Sessions per hour of the day, by their first event with a time."""
    sessions = _first_per_session(journey, "hour", cal.hour_of_day(F.col("Event_Time")))
    return profiles.by_hour(sessions, F.col("hour"), "Number_Of_Sessions")


def _page_time(journey: DataFrame, events: Sequence[str], measure: Column) -> DataFrame:
    per_event = group_nonnull(one_of(journey, "Event", events), "Event").agg(
        measure.alias("Time_On_Page")
    )
    return per_event.withColumn(
        "Time_On_Page_Display", duration_label(F.col("Time_On_Page"))
    )


@requires(journey=_PAGE_TIME)
def avg_time_per_event(journey: DataFrame, events: Sequence[str] = PAGE_EVENTS) -> DataFrame:
    """Mean time on page per page event."""
    return _page_time(journey, events, exact_mean(F.col("Time_On_Page")))


@requires(journey=_PAGE_TIME)
def total_time_per_event(journey: DataFrame, events: Sequence[str] = PAGE_EVENTS) -> DataFrame:
    """Total time on page per page event."""
    return _page_time(journey, events, sum_or_zero(F.col("Time_On_Page")))


def _time_table(journey: DataFrame, keys: list[str]) -> DataFrame:
    totals = sum_by(journey, keys, "Time_On_Page", "total_seconds")
    labelled = totals.withColumn("Time_On_Page", duration_label(F.col("total_seconds")))
    return sort_by(labelled, "total_seconds", keys)


@requires(journey=("Product_ID", "Product_Name", "Time_On_Page"))
def time_per_product(journey: DataFrame) -> DataFrame:
    """Total time per product id and name, longest first."""
    keyed = journey.withColumn("Product_ID", id_text(F.col("Product_ID")))
    return _time_table(keyed, ["Product_ID", "Product_Name"])


@requires(journey=("Collection_Name", "Time_On_Page"))
def time_per_collection(journey: DataFrame) -> DataFrame:
    """Total time per collection, longest first."""
    return _time_table(journey, ["Collection_Name"])


@requires(journey=("Event", "Customer_IP"))
def viewers_per_event(journey: DataFrame, events: Sequence[str] = PAGE_EVENTS) -> DataFrame:
    """Distinct visitors per page event."""
    pages = one_of(journey, "Event", events)
    return distinct_by(pages, "Event", "Customer_IP", "Total_Viewers")


@requires(journey=("Customer_IP", "Time_On_Page"))
def bounce_rate_customer(journey: DataFrame, threshold: float = VISITOR_BOUNCE_SECONDS) -> DataFrame:
    """Percentage of visitors whose total time is below the threshold (seconds)."""
    per_visitor = sum_by(journey, ["Customer_IP"], "Time_On_Page")
    bounced = F.count_if(F.col("Time_On_Page") < threshold)
    return per_visitor.agg(
        rounded(percentage(bounced, F.count(F.lit(1)))).alias("bounce_rate")
    )


@requires(journey=("Customer_IP", "session", "Event", "Time_On_Page", ORDER))
def bounce_rate_event(
    journey: DataFrame,
    events: Sequence[str] = PAGE_EVENTS,
    threshold: float = EVENT_BOUNCE_SECONDS,
) -> DataFrame:
    """Per page event, the percentage of its visitors who bounced on it.

    A visitor bounces on an event when it is the last page event of one of the
    visitor's sessions and took less than ``threshold`` seconds. Events nobody
    had are reported with 0.

    One pass: sessions are reduced to their last page event and the page events
    seen, then to (event, visitor) pairs. Events are handled by their position
    in the list, which keeps the first, largest aggregate fixed-width.
    """
    positions = range(len(events))
    names = F.array(*[F.lit(e) for e in events])
    pages = one_of(journey, "Event", events).withColumn(
        "page", F.array_position(names, F.col("Event")) - 1
    )
    sessions = pages.groupBy(*_SESSION).agg(
        F.max_by("page", ORDER).alias("last_page"),
        F.max_by("Time_On_Page", ORDER).alias("last_time"),
        *[F.max(F.col("page") == p).alias(f"saw_{p}") for p in positions],
    )
    seen = F.array(*[F.when(F.col(f"saw_{p}"), F.lit(p)) for p in positions])
    visits = sessions.select(
        "Customer_IP", "last_page", "last_time", F.explode(F.array_compact(seen)).alias("page")
    )
    bounced = (F.col("page") == F.col("last_page")) & (F.col("last_time") < threshold)
    visitors = group_nonnull(visits, "page", "Customer_IP").agg(
        F.max(F.coalesce(bounced, F.lit(False))).alias("bounced")
    )
    rates = visitors.groupBy("page").agg(
        rounded(percentage(F.count_if("bounced"), F.count(F.lit(1)))).alias("Bounce_Rate")
    )
    rates = rates.select(names[F.col("page")].alias("Event"), "Bounce_Rate")
    return series.fill_domain(rates, "Event", events, "Bounce_Rate", fill=0.0)
