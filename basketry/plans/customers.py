"""Customer page: listed, paying and repeat customers, spenders, regions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from basketry.functions.ratios import sum_or_zero
from basketry.operators.filters import filter_by_date
from basketry.operators.grain import ORDER, dedup_rows, first_non_null
from basketry.operators.grouping import distinct_by, distinct_count, group_nonnull, sum_by
from basketry.operators.ranking import bottom_n, check_limit, top_n
from basketry.plans.inputs import Whole, requires

_SPEND = ("Order_ID", "Customer_Name", "Order_Total_Price", ORDER)


@requires(customers=("Customer_ID",))
def total_listed(customers: DataFrame) -> DataFrame:
    """Distinct customers in the customer list."""
    return distinct_count(customers, "Customer_ID", "total_listed_customers")


@requires(orders=("Customer_ID",))
def total_paying(orders: DataFrame) -> DataFrame:
    """Distinct customers with an order."""
    return distinct_count(orders, "Customer_ID", "total_paying_customers")


@requires(orders=_SPEND)
def order_summary(orders: DataFrame, min_orders: int = 2) -> DataFrame:
    """Orders placed and total spending of customers with at least two orders.

    Each order counts once, with its first known price and customer name.
    """
    per_order = first_non_null(orders, ["Order_ID"], ["Customer_Name", "Order_Total_Price"])
    # Order_ID is unique here, so a row count is the distinct count.
    summary = group_nonnull(per_order, "Customer_Name").agg(
        F.count(F.lit(1)).alias("Orders_Placed"),
        sum_or_zero(F.col("Order_Total_Price")).alias("Total_Spending"),
    )
    return summary.where(F.col("Orders_Placed") >= min_orders)


@requires(orders=_SPEND)
def repeat_count(orders: DataFrame) -> DataFrame:
    """Number of customers with at least two orders."""
    return order_summary(orders).agg(F.count(F.lit(1)).alias("repeat_customers"))


@requires(customers=Whole(["Customer_Created_At"]))
def filtered(customers: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
             whole_end_day: bool = False) -> DataFrame:
    """Customers created in the date range."""
    kept = filter_by_date(customers, "Customer_Created_At", start, end, whole_end_day)
    return kept.drop(ORDER)


def _spend_per_customer(orders: DataFrame) -> DataFrame:
    per_order = dedup_rows(orders, ["Order_ID"], ["Customer_Name", "Order_Total_Price"])
    return sum_by(per_order, ["Customer_Name"], "Order_Total_Price")


@requires(orders=_SPEND)
def top_spend(orders: DataFrame, n: int = 5) -> DataFrame:
    """The n customers (up to 50) who spent most, each order counted once."""
    check_limit(n)
    return top_n(_spend_per_customer(orders), "Order_Total_Price", n, ["Customer_Name"])


@requires(orders=_SPEND)
def least_spend(orders: DataFrame, n: int = 5) -> DataFrame:
    """The n customers (up to 50) who spent least, each order counted once."""
    check_limit(n)
    return bottom_n(_spend_per_customer(orders), "Order_Total_Price", n, ["Customer_Name"])


@requires(customers=("Customer_Province", "Customer_ID"))
def by_province(customers: DataFrame) -> DataFrame:
    """Distinct customers per province."""
    return distinct_by(customers, "Customer_Province", "Customer_ID", "Unique_Customers")


@requires(customers=("Customer_Country", "Customer_ID"))
def by_country(customers: DataFrame) -> DataFrame:
    """Distinct customers per country."""
    return distinct_by(customers, "Customer_Country", "Customer_ID", "Unique_Customers")
