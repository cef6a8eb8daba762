"""Revenue page: each order counts once, as its whole first line."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions import calendar as cal
from basketry.functions.ratios import exact_mean, rounded, sum_or_zero
from basketry.operators import series
from basketry.operators.filters import filter_by_date
from basketry.operators.grain import ORDER, dedup_rows
from basketry.operators.grouping import sum_by
from basketry.operators.ranking import check_limit, top_n
from basketry.plans import profiles
from basketry.plans.inputs import Whole, requires

_PRICED = ("Order_ID", "Order_Total_Price", ORDER)
_TIMED = ("Order_ID", "Order_Created_At", "Order_Total_Price", ORDER)


def _order_rows(orders: DataFrame, *columns: str) -> DataFrame:
    return dedup_rows(orders, ["Order_ID"], list(columns))


def _timed_revenue(orders: DataFrame) -> DataFrame:
    return _order_rows(orders, "Order_Created_At", "Order_Total_Price")


@requires(orders=_PRICED)
def total(orders: DataFrame) -> DataFrame:
    """Total revenue."""
    rows = _order_rows(orders, "Order_Total_Price")
    return rows.agg(rounded(sum_or_zero(F.col("Order_Total_Price"))).alias("total_revenue"))


@requires(orders=_PRICED)
def average(orders: DataFrame) -> DataFrame:
    """Mean revenue per order."""
    rows = _order_rows(orders, "Order_Total_Price")
    return rows.agg(rounded(exact_mean(F.col("Order_Total_Price"))).alias("avg_order_revenue"))


@requires(orders=("Order_ID", "Order_Refund_Amount", ORDER))
def refund_total(orders: DataFrame) -> DataFrame:
    """Total amount refunded."""
    rows = _order_rows(orders, "Order_Refund_Amount")
    return rows.agg(sum_or_zero(F.col("Order_Refund_Amount")).alias("total_refund"))


@requires(orders=Whole(["Order_Created_At"]))
def filtered(orders: DataFrame, start: dt.date | None = None, end: dt.date | Column | None = None,
             whole_end_day: bool = False) -> DataFrame:
    """Order lines created in the date range."""
    kept = filter_by_date(orders, "Order_Created_At", start, end, whole_end_day)
    return kept.drop(ORDER)


@requires(orders=_TIMED)
def weekday_weekend(orders: DataFrame) -> DataFrame:
    """Revenue on weekdays and weekends; an order without a time is a weekday one."""
    shares = profiles.weekday_weekend(
        _timed_revenue(orders), cal.is_weekend(F.col("Order_Created_At")),
        "Revenue", F.col("Order_Total_Price"),
    )
    return profiles.with_money_label(shares, "Revenue", "Total_Revenue")


@requires(orders=_TIMED)
def by_weekday_name(orders: DataFrame) -> DataFrame:
    """Revenue per day of the week."""
    days = profiles.by_weekday_name(
        _timed_revenue(orders), cal.weekday_name(F.col("Order_Created_At")),
        "Revenue", F.col("Order_Total_Price"),
    )
    return profiles.with_money_label(days, "Revenue", "Total_Revenue")


@requires(orders=_TIMED)
def by_hour(orders: DataFrame) -> DataFrame:
    """Revenue per hour of the day."""
    hours = profiles.by_hour(
        _timed_revenue(orders), cal.hour_of_day(F.col("Order_Created_At")),
        "Total_Revenue", F.col("Order_Total_Price"),
    )
    return profiles.with_money_label(hours, "Total_Revenue", "Overall_Revenue")


@requires(orders=_TIMED)
def per_day(orders: DataFrame) -> DataFrame:
    """Revenue per day with orders (days without orders are not listed)."""
    daily = _timed_revenue(orders).withColumn("day", cal.day(F.col("Order_Created_At")))
    return sum_by(daily, ["day"], "Order_Total_Price")


@requires(orders=_TIMED)
def per_month(orders: DataFrame) -> DataFrame:
    return series.by_month(per_day(orders), "day", "Order_Total_Price")


@requires(orders=_TIMED)
def per_quarter(orders: DataFrame) -> DataFrame:
    return series.by_quarter(per_day(orders), "day", "Order_Total_Price")


@requires(orders=_TIMED)
def per_year(orders: DataFrame) -> DataFrame:
    return series.by_year(per_day(orders), "day", "Order_Total_Price")


@requires(orders=_TIMED)
def page(orders: DataFrame) -> DataFrame:
    """All calendar profiles of revenue from one pass, see :func:`profiles.page`."""
    return profiles.page(
        _timed_revenue(orders), "Order_Created_At", "Order_Total_Price", F.col("Order_Total_Price")
    )


@requires(orders=("Order_ID", "Order_Referring_Site", "Order_Total_Price", ORDER))
def by_referring_site(orders: DataFrame, n: int = 5) -> DataFrame:
    """Revenue per referring site, top n; orders without a site are left out."""
    check_limit(n)
    rows = _order_rows(orders, "Order_Referring_Site", "Order_Total_Price")
    per_site = sum_by(rows, ["Order_Referring_Site"], "Order_Total_Price", "Total_Revenue")
    return top_n(per_site, "Total_Revenue", n, ["Order_Referring_Site"])
