"""Order page: when orders are placed, order values, referring sites.

The table holds one row per order line; unless said otherwise each order counts
once, with its first known value.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions import calendar as cal
from basketry.functions.ratios import exact_mean, rounded
from basketry.operators import series
from basketry.operators.filters import drop_nulls, filter_by_date
from basketry.operators.grain import ORDER, dedup_rows, first_non_null
from basketry.operators.grouping import distinct_by, distinct_count, group_nonnull
from basketry.operators.ranking import bottom_n, check_limit, top_n
from basketry.plans import profiles
from basketry.plans.inputs import Whole, requires

_TIMED = ("Order_ID", "Order_Created_At", ORDER)
_VALUED = ("Customer_Name", "Order_ID", "Order_Total_Price", ORDER)


def order_times(orders: DataFrame) -> DataFrame:
    """One row per order with its first known creation time."""
    return first_non_null(orders, ["Order_ID"], ["Order_Created_At"])


@requires(orders=("Order_ID",))
def total(orders: DataFrame) -> DataFrame:
    """Distinct orders."""
    return distinct_count(orders, "Order_ID", "total_orders")


@requires(orders=Whole(["Order_Created_At"]))
def filtered(orders: DataFrame, start: dt.date | None = None, end: dt.date | Column | None = None,
             whole_end_day: bool = False) -> DataFrame:
    """Order lines created in the date range."""
    kept = filter_by_date(orders, "Order_Created_At", start, end, whole_end_day)
    return kept.drop(ORDER)


@requires(orders=_TIMED)
def weekday_weekend(orders: DataFrame) -> DataFrame:
    """Orders on weekdays and weekends; an order without a time is a weekday one."""
    is_weekend = cal.is_weekend(F.col("Order_Created_At"))
    return profiles.weekday_weekend(order_times(orders), is_weekend)


@requires(orders=_TIMED)
def by_weekday_name(orders: DataFrame) -> DataFrame:
    """Orders per day of the week."""
    return profiles.by_weekday_name(
        order_times(orders), cal.weekday_name(F.col("Order_Created_At"))
    )


@requires(orders=_TIMED)
def by_hour(orders: DataFrame) -> DataFrame:
    """Orders per hour of the day."""
    hour = cal.hour_of_day(F.col("Order_Created_At"))
    return profiles.by_hour(order_times(orders), hour, "Number_Of_Orders")


@requires(orders=_TIMED)
def per_day(orders: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Orders per day from the first order up to ``as_of`` (today by default)."""
    return profiles.rows_per_day(
        order_times(orders), "Order_Created_At", "order_count", as_of
    )


@requires(orders=_TIMED)
def per_month(orders: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return series.by_month(per_day(orders, as_of=as_of), "day", "order_count")


@requires(orders=_TIMED)
def per_quarter(orders: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return series.by_quarter(per_day(orders, as_of=as_of), "day", "order_count")


@requires(orders=_TIMED)
def per_year(orders: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return series.by_year(per_day(orders, as_of=as_of), "day", "order_count")


@requires(orders=_TIMED)
def page(orders: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """All calendar profiles of orders from one pass, see :func:`profiles.page`."""
    return profiles.page(
        order_times(orders), "Order_Created_At", "order_count", gap_free=True, as_of=as_of
    )


@requires(orders=("Customer_ID", "Order_ID"))
def avg_per_customer(orders: DataFrame) -> DataFrame:
    """Mean number of distinct orders per customer."""
    per_customer = distinct_by(orders, "Customer_ID", "Order_ID", "orders")
    return per_customer.agg(
        rounded(exact_mean(F.col("orders"))).alias("average_orders_per_customer")
    )


# A line column is declared although only rows are counted: the measure is
# about order lines, so the input has to be at line level.
@requires(orders=("Order_Cancelled_At", "Product_ID"))
def cancelled(orders: DataFrame) -> DataFrame:
    """Order *lines* that belong to a cancelled order."""
    return drop_nulls(orders, "Order_Cancelled_At").agg(
        F.count(F.lit(1)).alias("total_cancelled_orders")
    )


@requires(orders=("Customer_ID", "Order_ID"))
def max_per_customer(orders: DataFrame) -> DataFrame:
    """Largest number of distinct orders of one customer."""
    per_customer = distinct_by(orders, "Customer_ID", "Order_ID", "orders")
    return per_customer.agg(F.max("orders").alias("max_orders_per_customer"))


@requires(orders=("Order_ID", "Order_Total_Price", ORDER))
def avg_value(orders: DataFrame) -> DataFrame:
    """Mean order value."""
    per_order = first_non_null(orders, ["Order_ID"], ["Order_Total_Price"])
    return per_order.agg(
        rounded(exact_mean(F.col("Order_Total_Price"))).alias("average_order_value")
    )


def _first_order_per_customer(orders: DataFrame) -> DataFrame:
    firsts = first_non_null(orders, ["Customer_Name"], ["Order_ID", "Order_Total_Price"])
    return drop_nulls(firsts, "Order_ID")


@requires(orders=_VALUED)
def highest_valued(orders: DataFrame, n: int = 5) -> DataFrame:
    """Customers ranked by the price of their *first* order, highest n (up to 50)."""
    check_limit(n)
    firsts = _first_order_per_customer(orders)
    return top_n(firsts, "Order_Total_Price", n, ["Customer_Name"])


@requires(orders=_VALUED)
def least_valued(orders: DataFrame, n: int = 5) -> DataFrame:
    """Customers ranked by the price of their *first* order, lowest n (up to 50)."""
    check_limit(n)
    firsts = _first_order_per_customer(orders)
    return bottom_n(firsts, "Order_Total_Price", n, ["Customer_Name"])


@requires(orders=("Order_ID", "Order_Referring_Site", ORDER))
def by_referring_site(orders: DataFrame, n: int = 5) -> DataFrame:
    """Orders per referring site, top n; orders without a site are left out."""
    check_limit(n)
    per_order = dedup_rows(orders, ["Order_ID"], ["Order_Referring_Site"])
    per_site = group_nonnull(per_order, "Order_Referring_Site").agg(
        F.count("Order_ID").alias("Total_Orders")
    )
    return top_n(per_site, "Total_Orders", n, ["Order_Referring_Site"])
