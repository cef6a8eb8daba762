"""All named queries, ready to run on the sample tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType

from basketry.operators.filters import latest_date
from basketry.plans import abandoned, customers, journey, orders, products, revenue
from basketry.plans.inputs import Whole
from basketry.session import apply_settings
from basketry.sources import as_text, sample

# The reader's choices used on the sample tables (FIXTURES.md).
JOURNEY_AS_OF = dt.date(2024, 2, 5)
ORDERS_AS_OF = dt.date(2001, 8, 15)
PAGE_EVENTS = ("click", "error", "signup", "view")
CART_EVENT = "purchase"
VISITOR_BOUNCE = 2500
EVENT_BOUNCE = 10


@dataclass(frozen=True)
class Query:
    """A query, the reader's choices and options of the tables it reads.

    ``latest`` are choices that are the latest date of a column: name -> (table, column).
    ``between`` names the option by which a table's view takes the range of dates that the
    choices ``start`` and ``end`` make: table -> option.
    """

    run: Callable[..., DataFrame]
    choices: dict = field(default_factory=dict)
    table_options: dict = field(default_factory=dict)
    latest: dict = field(default_factory=dict)
    between: dict = field(default_factory=dict)

    def on_sample(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The query over whole sample tables; money is shown as double."""
        apply_settings(spark)
        latest = {
            name: latest_date(sample.TABLES[table](spark, sf_dir, (column,)), column)
            for name, (table, column) in self.latest.items()
        }
        chosen = self.choices | latest
        dates = {table: {option: (chosen.get("start"), chosen.get("end"))} for table, option in self.between.items()}
        frames = [
            sample.TABLES[table](
                spark, sf_dir, None if isinstance(columns, Whole) else columns,
                **self.table_options.get(table, {}), **dates.get(table, {}),
            )
            for table, columns in self.run.needs.items()
        ]
        return money_as_double(self.run(*frames, **self.choices, **latest))


@dataclass(frozen=True)
class Loading:
    """A sample table written as flawed CSV, as text or in files, and read by the loader."""

    load: Callable[[SparkSession, str], DataFrame]

    def on_sample(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return money_as_double(self.load(apply_settings(spark), sf_dir))


def money_as_double(df: DataFrame) -> DataFrame:
    shown = [
        F.col(c.name).cast("double").alias(c.name) if isinstance(c.dataType, DecimalType) else c.name
        for c in df.schema
    ]
    return df.select(*shown)


_pages = {"events": PAGE_EVENTS}
_cart = {"cart_event": CART_EVENT}
# The latest order date needs neither lines nor names.
_to_latest_order = {"end": ("orders", "Order_Created_At")}
_created = {"orders": "created"}
_until_journey = {"as_of": JOURNEY_AS_OF}
_until_orders = {"as_of": ORDERS_AS_OF}

QUERIES: dict[str, Query | Loading] = {
    # loading
    "load_orders": Loading(as_text.orders),
    "load_journey": Loading(as_text.journey),
    "load_products": Loading(as_text.products),
    "load_files_orders": Loading(as_text.order_files),
    "load_files_journey": Loading(as_text.journey_files),
    "load_files_products": Loading(as_text.product_files),
    "load_files_first_last": Loading(as_text.first_and_last_in_files),
    "load_files_rejects": Loading(as_text.rejects_in_files),
    # customers
    "cust_total_listed": Query(customers.total_listed),
    "cust_total_paying": Query(customers.total_paying),
    "cust_repeat_count": Query(customers.repeat_count),
    "cust_filtered": Query(customers.filtered),
    "cust_top_spend": Query(customers.top_spend),
    "cust_least_spend": Query(customers.least_spend),
    "cust_order_summary": Query(customers.order_summary),
    "cust_by_province": Query(customers.by_province),
    "cust_by_country": Query(customers.by_country),
    # customer journey
    "cj_total_viewers": Query(journey.total_viewers),
    "cj_repeat_viewers": Query(journey.repeat_viewers),
    "cj_total_sessions": Query(journey.total_sessions),
    "cj_peak_session_rows": Query(journey.peak_session_rows),
    "cj_filtered": Query(journey.filtered),
    "cj_sessions_weekday_weekend": Query(journey.sessions_weekday_weekend),
    "cj_session_duration_total_avg": Query(journey.session_duration),
    "cj_avg_sessions_per_customer": Query(journey.avg_sessions_per_customer),
    "cj_top10_sessions_by_time": Query(journey.longest_sessions),
    "cj_top_ips_by_session": Query(journey.top_ips_by_session),
    "cj_sessions_per_day": Query(journey.sessions_per_day, _until_journey),
    "cj_sessions_per_month": Query(journey.sessions_per_month, _until_journey),
    "cj_sessions_per_quarter": Query(journey.sessions_per_quarter, _until_journey),
    "cj_sessions_per_year": Query(journey.sessions_per_year, _until_journey),
    "cj_top_products_viewed": Query(journey.top_products_viewed),
    "cj_top_collections_viewed": Query(journey.top_collections_viewed),
    "cj_top_cart_products": Query(journey.top_cart_products, _cart),
    "cj_search_term_freq": Query(journey.search_term_freq, {"weights": True}),
    "cj_cart_total": Query(journey.cart_total, _cart),
    "cj_sessions_by_weekday_name": Query(journey.sessions_by_weekday_name),
    "cj_sessions_by_hour": Query(journey.sessions_by_hour),
    "cj_avg_time_per_event": Query(journey.avg_time_per_event, _pages),
    "cj_total_time_per_event": Query(journey.total_time_per_event, _pages),
    "cj_time_per_product": Query(journey.time_per_product),
    "cj_time_per_collection": Query(journey.time_per_collection),
    "cj_viewers_per_event": Query(journey.viewers_per_event, _pages),
    "cj_bounce_rate_customer": Query(
        journey.bounce_rate_customer, {"threshold": VISITOR_BOUNCE}
    ),
    "cj_bounce_rate_event": Query(
        journey.bounce_rate_event, {**_pages, "threshold": EVENT_BOUNCE}
    ),
    # orders
    "ord_total": Query(orders.total),
    "ord_filtered": Query(orders.filtered, latest=_to_latest_order, between=_created),
    "ord_weekday_weekend": Query(orders.weekday_weekend),
    "ord_by_weekday_name": Query(orders.by_weekday_name),
    "ord_by_hour": Query(orders.by_hour),
    "ord_per_day": Query(orders.per_day, _until_orders),
    "ord_per_month": Query(orders.per_month, _until_orders),
    "ord_per_quarter": Query(orders.per_quarter, _until_orders),
    "ord_per_year": Query(orders.per_year, _until_orders),
    "ord_page": Query(orders.page, _until_orders),
    "ord_avg_per_customer": Query(orders.avg_per_customer),
    "ord_cancelled": Query(orders.cancelled),
    "ord_max_per_customer": Query(orders.max_per_customer),
    "ord_avg_value": Query(orders.avg_value),
    "ord_highest_valued": Query(orders.highest_valued),
    "ord_least_valued": Query(orders.least_valued),
    "ord_by_referring_site": Query(orders.by_referring_site),
    # abandoned checkouts
    "abn_total": Query(abandoned.total),
    "abn_filtered": Query(abandoned.filtered),
    "abn_weekday_weekend": Query(abandoned.weekday_weekend),
    "abn_by_weekday_name": Query(abandoned.by_weekday_name),
    "abn_by_hour": Query(abandoned.by_hour),
    "abn_per_day": Query(abandoned.per_day, _until_orders),
    "abn_per_month": Query(abandoned.per_month, _until_orders),
    "abn_per_quarter": Query(abandoned.per_quarter, _until_orders),
    "abn_per_year": Query(abandoned.per_year, _until_orders),
    "abn_page": Query(abandoned.page, _until_orders),
    "abn_avg_per_customer": Query(abandoned.avg_per_customer),
    "abn_max_per_customer": Query(abandoned.max_per_customer),
    "abn_by_referring_site": Query(abandoned.by_referring_site),
    # products
    # Empty lines add no product, so every order may have one.
    "prod_avg_per_customer": Query(
        products.avg_per_customer, table_options={"orders": {"empty_line_each": True}}
    ),
    "prod_total_published": Query(products.total_published),
    "prod_filtered": Query(products.filtered),
    "prod_count_by_type": Query(products.count_by_type),
    "prod_most_sold": Query(products.most_sold),
    "prod_most_priced": Query(products.most_priced),
    "prod_least_priced": Query(products.least_priced),
    "prod_unsold": Query(products.unsold),
    "prod_price_quartiles": Query(products.price_quartiles),
    "prod_price_quantiles": Query(products.price_quantiles),
    "prod_price_histogram": Query(products.price_histogram),
    # revenue
    "rev_total": Query(revenue.total),
    "rev_avg": Query(revenue.average),
    "rev_refund_total": Query(revenue.refund_total),
    "rev_filtered": Query(revenue.filtered, latest=_to_latest_order, between=_created),
    "rev_weekday_weekend": Query(revenue.weekday_weekend),
    "rev_by_weekday_name": Query(revenue.by_weekday_name),
    "rev_by_hour": Query(revenue.by_hour),
    "rev_per_day": Query(revenue.per_day),
    "rev_per_month": Query(revenue.per_month),
    "rev_per_quarter": Query(revenue.per_quarter),
    "rev_per_year": Query(revenue.per_year),
    "rev_page": Query(revenue.page),
    "rev_by_referring_site": Query(revenue.by_referring_site),
}
