"""Product page: catalogue size, prices, sales and unsold products.

The products table holds one row per variant. A product is published when its
publishing date is known.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from basketry.functions.ratios import exact_mean, rounded
from basketry.functions.text import date_part, without_commas
from basketry.operators.distribution import (
    amount_counts, approx_quantiles, equal_width_histogram, exact_quantiles,
)
from basketry.operators.filters import drop_nulls, filter_by_date, replace_value
from basketry.operators.grain import ORDER
from basketry.operators.grouping import (
    distinct_by, distinct_count, max_by_key, min_by_key, sum_by,
)
from basketry.operators.membership import not_in
from basketry.operators.ranking import bottom_n, check_limit, top_n
from basketry.plans.inputs import Whole, requires
from basketry.sources.shared import stored

_PRICED = ("Product_ID", "Product_Title", "Product_Published_At", "Variant_Price")
_PRODUCT = ["Product_ID", "Product_Title"]


def published(products: DataFrame) -> DataFrame:
    return drop_nulls(products, "Product_Published_At")


@requires(orders=("Customer_ID", "Product_ID"))
def avg_per_customer(orders: DataFrame) -> DataFrame:
    """Mean number of distinct products ordered by a customer."""
    per_customer = distinct_by(orders, "Customer_ID", "Product_ID", "products")
    return per_customer.agg(
        rounded(exact_mean(F.col("products"))).alias("average_products_per_customer")
    )


@requires(products=("Product_ID", "Product_Published_At"))
def total_published(products: DataFrame) -> DataFrame:
    """Distinct published products."""
    return distinct_count(published(products), "Product_ID", "total_products")


@requires(products=Whole(["Product_Created_At"]))
def filtered(products: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
             whole_end_day: bool = False) -> DataFrame:
    """Products created in the date range."""
    return filter_by_date(products, "Product_Created_At", start, end, whole_end_day).drop(ORDER)


@requires(products=("Product_ID", "Product_Type", "Product_Published_At"))
def count_by_type(products: DataFrame, n: int = 5) -> DataFrame:
    """Published products per type, top n; an empty type is ``No Type``, a null one is left out."""
    check_limit(n)
    typed = published(products).select(
        replace_value("Product_Type", "", "No Type"), "Product_ID"
    )
    return top_n(distinct_by(typed, "Product_Type", "Product_ID", "Count"), "Count", n, ["Product_Type"])


@requires(orders=("Product_Name", "Product_Quantity"))
def most_sold(orders: DataFrame, n: int = 5) -> DataFrame:
    """Products with the largest quantity sold, top n."""
    check_limit(n)
    sold = sum_by(orders, ["Product_Name"], "Product_Quantity")
    return top_n(sold, "Product_Quantity", n, ["Product_Name"])


@requires(products=_PRICED)
def most_priced(products: DataFrame, n: int = 5) -> DataFrame:
    """Published products with the highest variant price, top n."""
    check_limit(n)
    prices = max_by_key(published(products), _PRODUCT, "Variant_Price")
    return top_n(prices, "Variant_Price", n, _PRODUCT)


@requires(products=_PRICED)
def least_priced(products: DataFrame, n: int = 5) -> DataFrame:
    """Published products with the lowest variant price, bottom n by price, id and title."""
    check_limit(n)
    prices = min_by_key(published(products), _PRODUCT, "Variant_Price")
    return bottom_n(prices, "Variant_Price", n, _PRODUCT)


@requires(products=("Product_ID", "Product_Title", "Product_Published_At"), orders=("Product_ID",))
def unsold(products: DataFrame, orders: DataFrame) -> DataFrame:
    """Published products in no order, oldest first."""
    unsold_rows = not_in(published(products), "Product_ID", orders)
    listed = drop_nulls(unsold_rows, *_PRODUCT).distinct()
    shown = listed.select(
        without_commas(F.col("Product_ID")).alias("Product_ID"),
        "Product_Title",
        date_part(F.col("Product_Published_At")).alias("Product_Published_At"),
    )
    return shown.orderBy(F.asc_nulls_last("Product_Published_At"), *_PRODUCT)


@requires(products=("Product_Published_At", "Variant_Price"))
def price_quartiles(products: DataFrame) -> DataFrame:
    """Lower and upper quartile of the published variants' prices."""
    counts = stored(amount_counts(published(products), "Variant_Price"), "amounts")
    return exact_quantiles(counts, (0.25, 0.75)).toDF("lower_quartile", "upper_quartile")


@requires(products=("Product_Published_At", "Variant_Price"))
def price_quantiles(products: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Prices that about a tenth, half and nine tenths of the published variants do not exceed."""
    found = approx_quantiles(published(products), "Variant_Price", (0.1, 0.5, 0.9), accuracy)
    return found.toDF("low_price", "middle_price", "high_price")


@requires(products=("Product_Published_At", "Variant_Price"))
def price_histogram(products: DataFrame) -> DataFrame:
    """Published variants per price range."""
    return equal_width_histogram(published(products), "Variant_Price")
