"""Abandoned-checkout page: the order profiles on checkouts never completed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from basketry.functions import calendar as cal
from basketry.functions.ratios import exact_mean
from basketry.functions.text import id_text
from basketry.operators import series
from basketry.operators.filters import filter_by_date, replace_null
from basketry.operators.grain import ORDER
from basketry.operators.grouping import distinct_by, distinct_count
from basketry.operators.ranking import check_limit, top_n
from basketry.plans import profiles
from basketry.plans.inputs import Whole, requires
from basketry.plans.orders import order_times

_TIMED = ("Order_ID", "Order_Created_At", ORDER)
_PER_CUSTOMER = ("Customer_ID", "Order_ID")


@requires(abandoned=("Order_ID",))
def total(abandoned: DataFrame) -> DataFrame:
    """Distinct abandoned orders."""
    return distinct_count(abandoned, "Order_ID", "total_abandoned_orders")


@requires(abandoned=Whole(["Order_Created_At"]))
def filtered(abandoned: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
             whole_end_day: bool = False) -> DataFrame:
    """Abandoned checkouts created in the date range."""
    return filter_by_date(abandoned, "Order_Created_At", start, end, whole_end_day).drop(ORDER)


@requires(abandoned=_TIMED)
def weekday_weekend(abandoned: DataFrame) -> DataFrame:
    is_weekend = cal.is_weekend(F.col("Order_Created_At"))
    return profiles.weekday_weekend(order_times(abandoned), is_weekend)


@requires(abandoned=_TIMED)
def by_weekday_name(abandoned: DataFrame) -> DataFrame:
    return profiles.by_weekday_name(
        order_times(abandoned), cal.weekday_name(F.col("Order_Created_At"))
    )


@requires(abandoned=_TIMED)
def by_hour(abandoned: DataFrame) -> DataFrame:
    hour = cal.hour_of_day(F.col("Order_Created_At"))
    return profiles.by_hour(order_times(abandoned), hour, "Number_Of_Orders")


@requires(abandoned=_TIMED)
def per_day(abandoned: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Abandoned orders per day up to ``as_of`` (today by default)."""
    return profiles.rows_per_day(
        order_times(abandoned), "Order_Created_At", "abandoned_count", as_of
    )


@requires(abandoned=_TIMED)
def per_month(abandoned: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return series.by_month(per_day(abandoned, as_of=as_of), "day", "abandoned_count")


@requires(abandoned=_TIMED)
def per_quarter(abandoned: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return series.by_quarter(per_day(abandoned, as_of=as_of), "day", "abandoned_count")


@requires(abandoned=_TIMED)
def per_year(abandoned: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return series.by_year(per_day(abandoned, as_of=as_of), "day", "abandoned_count")


@requires(abandoned=_TIMED)
def page(abandoned: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """All calendar profiles of abandoned checkouts from one pass, see :func:`profiles.page`."""
    return profiles.page(
        order_times(abandoned), "Order_Created_At", "abandoned_count", gap_free=True, as_of=as_of
    )


@requires(abandoned=_PER_CUSTOMER)
def avg_per_customer(abandoned: DataFrame) -> DataFrame:
    """Mean number of abandoned orders per customer, decimals cut off."""
    per_customer = distinct_by(abandoned, "Customer_ID", "Order_ID", "orders")
    return per_customer.agg(
        exact_mean(F.col("orders")).cast("bigint").alias("average_abandoned_orders")
    )


@requires(abandoned=_PER_CUSTOMER)
def max_per_customer(abandoned: DataFrame) -> DataFrame:
    """Largest number of abandoned orders of one customer."""
    per_customer = distinct_by(abandoned, "Customer_ID", "Order_ID", "orders")
    return per_customer.agg(F.max("orders").alias("most_abandoned_orders"))


@requires(abandoned=("Order_ID", "Order_Referring_Site"))
def by_referring_site(abandoned: DataFrame, n: int = 10) -> DataFrame:
    """Abandoned orders per site, top n (up to 50).

    A missing site is ``Unknown``; checkouts without an id count as one order.
    """
    check_limit(n)
    known = abandoned.select(
        replace_null("Order_Referring_Site", "Unknown"),
        id_text(F.col("Order_ID")).alias("Order_ID"),
    )
    per_site = distinct_by(known, "Order_Referring_Site", "Order_ID", "Total_Abandoned_Orders")
    return top_n(per_site, "Total_Abandoned_Orders", n, ["Order_Referring_Site"])
