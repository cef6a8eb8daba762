"""The canonical tables as views of the TPC-H-like sample tables.

The sample has no shop extract, so some columns are stand-ins (see FIXTURES.md).
A view is assembled for the columns that are asked for: dimension tables join on
their primary key with a left join, so leaving one out changes no row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from basketry.operators.grain import ORDER

# Start of the derived calendar columns, session gap in hours.
CALENDAR_START = "1995-01-01"
SESSION_GAP_HOURS = 12

ORDER_COLUMNS = (
    "Order_ID", "Customer_ID", "Customer_Name", "Order_Total_Price", "Order_Refund_Amount",
    "Order_Created_At", "Order_Cancelled_At", "Order_Referring_Site", "Product_ID",
    "Product_Name", "Product_Quantity",
)
JOURNEY_COLUMNS = (
    "Customer_IP", "Event_Time", "Event", "Time_On_Page", "session", "Product_ID",
    "Product_Name", "Collection_Name", "Search_Term", "event_id",
)


# The columns of the sample tables used here. Stating them saves
# the footer-reading job that every schema inference starts.
SAMPLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def _hours_after(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def _calendar_day(number: Column) -> Column:
    return F.date_add(F.lit(CALENDAR_START).cast("date"), number.cast("int"))


#: Multiples of it are apart by more than a line number, which is below 8.
_LINES = 8


def _line() -> Column:
    """Number of an order's line; 0 stands for an order without lines."""
    return F.coalesce("l_linenumber", F.lit(0))


def _order_facts(by_line: bool = False) -> dict[str, Column]:
    """Order-level columns, over the base table ``orders`` (and ``customer``).

    ``by_line``: some values differ between the lines of an order, so that the first
    known value and the first row of an order are different things. They depend on the
    order key and the line number only.
    """
    key = F.col("o_orderkey")
    price, site, name = _money("o_totalprice"), F.col("o_orderpriority"), F.col("c_name")
    place = key
    if by_line:
        first, later = _line() == 1, _line() > 1
        other = (price + _line()).cast("decimal(18,2)")
        price = F.when(~(first & (key % 3 == 0)), F.when(later & (key % 5 == 0), other).otherwise(price))
        site = F.when(~(first & (key % 4 == 1)), site)
        name = F.when(~(first & (key % 6 == 2)), name)
        place = key * _LINES + _line()
    return {
        "Order_ID": key,
        "Customer_ID": F.col("o_custkey"),
        "Customer_Name": name,
        "Order_Total_Price": price,
        "Order_Refund_Amount": F.when(key % 7 == 0, _money("o_totalprice")).otherwise(
            F.lit(0).cast("decimal(18,2)")
        ),
        "Order_Created_At": _hours_after(F.col("o_orderdate"), key % 24),
        "Order_Cancelled_At": F.when(
            (F.col("o_orderstatus") == "F") & (key % 10 == 0), F.col("o_orderdate")
        ),
        "Order_Referring_Site": F.when(key % 20 != 0, site),
        ORDER: place,
    }


def _product() -> Column:
    """Every fourth part is sold, so that most of the catalogue is not."""
    part = F.col("l_partkey")
    return part - (part - 1) % 4


_LINE_FACTS = {
    "Product_ID": _product,
    "Product_Name": lambda: F.col("p_name"),
    "Product_Quantity": lambda: F.col("l_quantity").cast("bigint"),
}
#: Columns that are the same in all lines of an order.
_CONSTANT = {"Order_ID", "Customer_ID", "Order_Refund_Amount", "Order_Created_At", "Order_Cancelled_At"}
_USES = {
    "Order_ID": ["o_orderkey"],
    "Customer_ID": ["o_custkey"],
    "Customer_Name": ["o_custkey", "o_orderkey"],
    "Order_Total_Price": ["o_orderkey", "o_totalprice"],
    "Order_Refund_Amount": ["o_orderkey", "o_totalprice"],
    "Order_Created_At": ["o_orderkey", "o_orderdate"],
    "Order_Cancelled_At": ["o_orderkey", "o_orderstatus", "o_orderdate"],
    "Order_Referring_Site": ["o_orderkey", "o_orderpriority"],
    ORDER: ["o_orderkey"],
    "Product_ID": ["l_partkey"],
    "Product_Name": ["l_partkey"],
    "Product_Quantity": ["l_quantity"],
}


def _ordered_about(
    heads: DataFrame, start: dt.date | None, end: Column | dt.date | None
) -> DataFrame:
    """Orders whose time, 0 to 23 hours after the stored date, can lie between the bounds."""
    if start is not None:
        before = dt.datetime.combine(start, dt.time()) - dt.timedelta(hours=23)
        heads = heads.where(F.col("o_orderdate") >= F.lit(before).cast("timestamp_ntz"))
    if end is not None:
        end = end if isinstance(end, Column) else F.lit(end).cast("timestamp_ntz")
        heads = heads.where(F.col("o_orderdate") <= end)
    return heads


def orders(
    spark: SparkSession,
    sf_dir: str,
    columns: Iterable[str] | None = None,
    empty_line_each: bool = False,
    created: tuple[dt.date | None, Column | dt.date | None] = (None, None),
) -> DataFrame:
    """One row per order line, and one per order without lines.

    Orders join their lines first and names come last, so a filter on orders reaches
    both the join and the branch of orders without lines. Both are joins AQE can split
    on the side of the lines. Every line belongs to an order (foreign key), so columns
    of lines alone need no join. Columns that are the same in all lines of an order,
    and no others, are attached to the lines with a left join, which Catalyst drops when
    the query is insensitive to repeated rows.

    ``empty_line_each`` adds the empty line to every order instead of to those without
    lines: for queries that more empty lines cannot change, one pass over the lines.

    ``created`` are midnights no wanted ``Order_Created_At`` lies before or after. Orders
    certainly outside are skipped by their stored date, which the scan can do; those
    near the bounds are left to the query's own filter.
    """
    wanted = ORDER_COLUMNS + (ORDER,) if columns is None else tuple(columns)
    line_level = [c for c in wanted if c in _LINE_FACTS]
    heads = _ordered_about(read_table(spark, sf_dir, "orders"), *created)
    lines = read_table(spark, sf_dir, "lineitem")
    same_order = F.col("l_orderkey") == F.col("o_orderkey")
    if set(wanted) <= _CONSTANT:
        rows = heads.join(lines.select("l_orderkey"), same_order, "left")
        return rows.select(*[_order_facts()[c].alias(c) for c in wanted])

    used = [c for name in wanted for c in _USES[name]]
    heads = heads.select("o_orderkey", *sorted({c for c in used if c.startswith("o_")} - {"o_orderkey"}))
    own = sorted({c for c in used if c.startswith("l_")})
    if set(wanted) - set(line_level):
        with_lines = heads.join(lines.select("l_orderkey", "l_linenumber", *own), same_order)
    else:
        with_lines = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", *own)
    if not empty_line_each:
        heads = heads.join(lines.select("l_orderkey").distinct(), same_order, "left_anti")
    rows = with_lines.drop("l_orderkey").unionByName(heads, allowMissingColumns=True)
    if "Customer_Name" in wanted:
        names = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
        rows = rows.join(names, F.col("o_custkey") == F.col("c_custkey"), "left")
    if "Product_Name" in wanted:
        parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
        rows = rows.join(parts, _product() == F.col("p_partkey"), "left")
    facts = _order_facts(by_line=True) | {c: _LINE_FACTS[c]() for c in line_level}
    return rows.select(*[facts[c].alias(c) for c in wanted])


def abandoned(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Orders never completed, one row each."""
    names = ("Order_ID", "Customer_ID", "Order_Created_At", "Order_Referring_Site", ORDER)
    wanted = names if columns is None else tuple(columns)
    facts = _order_facts()
    pending = read_table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    return pending.select(*[facts[c].alias(c) for c in wanted])


def customers(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    names = ("Customer_ID", "Customer_Province", "Customer_Country", "Customer_Created_At", ORDER)
    wanted = names if columns is None else tuple(columns)
    rows = read_table(spark, sf_dir, "customer")
    if "Customer_Province" in wanted or "Customer_Country" in wanted:
        nations = read_table(spark, sf_dir, "nation")
        rows = rows.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if "Customer_Country" in wanted:
        regions = read_table(spark, sf_dir, "region")
        rows = rows.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    key = F.col("c_custkey")
    created_on = _calendar_day(key % 365).cast("timestamp_ntz")
    facts = {
        "Customer_ID": key,
        "Customer_Province": F.col("n_name"),
        "Customer_Country": F.col("r_name"),
        "Customer_Created_At": _hours_after(created_on, key % 24),
        ORDER: key,
    }
    return rows.select(*[facts[c].alias(c) for c in wanted])


def products(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    key = F.col("p_partkey")
    on = _calendar_day(key % 1000)
    facts = {
        "Product_ID": key,
        "Product_Title": F.col("p_name"),
        "Product_Type": F.when(F.col("p_size") % 10 == 0, F.lit("")).otherwise(F.col("p_type")),
        "Variant_Price": _money("p_retailprice"),
        "Product_Created_At": _hours_after(on.cast("timestamp_ntz"), key % 24),
        "Product_Published_At": F.when(
            key % 8 != 0, F.concat(F.date_format(on, "yyyy-MM-dd"), F.lit("T00:00:00Z"))
        ),
        ORDER: key,
    }
    wanted = tuple(facts) if columns is None else tuple(columns)
    return read_table(spark, sf_dir, "part").select(*[facts[c].alias(c) for c in wanted])


def _half_day(ts: Column) -> list[Column]:
    """Slot of half a day; as long as the session gap."""
    return [
        F.to_date(ts).alias("slot_day"),
        F.floor(F.hour(ts) / SESSION_GAP_HOURS).alias("slot_half"),
    ]


def _with_sessions(events: DataFrame, whole: bool = True) -> DataFrame:
    """Number each user's sessions; a gap over 12 hours starts a new one.

    Unless ``whole`` events are asked for, the summaries are on the left of the join
    back, which Catalyst drops when the query is insensitive to repeated rows.

    Events of one half-day slot are never more than 12 hours apart, hence always
    in one session. So sessions are numbered on (user, slot) summaries: the
    window sorts at most two rows per user and day, however many events a user
    has, and the numbers go back to the events by an ordinary equi-join.
    """
    slot = ["user_id", "slot_day", "slot_half"]
    slotted = events.select("*", *_half_day(F.col("ts")))
    slots = slotted.groupBy(*slot).agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))
    in_time = Window.partitionBy("user_id").orderBy("slot_day", "slot_half")
    gap = F.col("from_ts") - F.lag("to_ts").over(in_time)
    opens = F.coalesce(gap > F.make_dt_interval(hours=F.lit(SESSION_GAP_HOURS)), F.lit(True))
    numbered = slots.select(*slot, opens.cast("bigint").alias("opens")).select(
        *slot, F.sum("opens").over(in_time).alias("session")
    )
    if not whole:
        return numbered.join(slotted.select(*slot), slot, "left")
    return slotted.join(numbered, slot, "left")


def journey(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per event, in the order of the event feed (``event_id``)."""
    wanted = JOURNEY_COLUMNS + (ORDER,) if columns is None else tuple(columns)
    rows = read_table(spark, sf_dir, "events")
    product = F.get_json_object("props", "$.k").try_cast("bigint")
    if {"Product_ID", "Product_Name", "Collection_Name", "Search_Term"} & set(wanted):
        rows = rows.withColumn("k", product)
    if {"Product_Name", "Collection_Name", "Search_Term"} & set(wanted):
        parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
        rows = rows.join(parts, F.col("k") == F.col("p_partkey"), "left")
    if "session" in wanted:
        rows = _with_sessions(rows, whole=bool(set(wanted) - {"Customer_IP", "session"}))
    facts = {
        "Customer_IP": lambda: F.col("user_id").cast("string"),
        "Event_Time": lambda: F.col("ts"),
        "Event": lambda: F.col("event_type"),
        "Time_On_Page": lambda: _money("value"),
        "session": lambda: F.col("session"),
        "Product_ID": lambda: F.col("k"),
        "Product_Name": lambda: F.col("p_name"),
        "Collection_Name": lambda: F.col("p_type"),
        "Search_Term": lambda: F.when(F.col("event_type") == "view", F.col("p_brand")),
        "event_id": lambda: F.col("event_id"),
        ORDER: lambda: F.col("event_id"),
    }
    return rows.select(*[facts[c]().alias(c) for c in wanted])


TABLES: dict[str, Callable[..., DataFrame]] = {
    "orders": orders,
    "customers": customers,
    "journey": journey,
    "abandoned": abandoned,
    "products": products,
}
