"""The five canonical tables.

``row_order`` is not part of a table's content: it is the position of a row in
its source and gives "first" and "last" a meaning on a distributed table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DecimalType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

_MONEY = DecimalType(18, 2)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


class IdType(StringType):
    """Text of an id; whole numbers written with decimals (``1005.0``) lose them."""


_ID, _TEXT, _TIME = IdType(), StringType(), TimestampNTZType()

SCHEMAS = {
    # one row per order line; order-level values repeat
    "orders": _table(
        Order_ID=_ID, Customer_ID=_ID, Customer_Name=_TEXT, Order_Total_Price=_MONEY,
        Order_Refund_Amount=_MONEY, Order_Created_At=_TIME, Order_Updated_At=_TIME,
        Order_Cancelled_At=_TEXT, Order_Referring_Site=_TEXT, Product_ID=_ID,
        Product_Name=_TEXT, Product_Quantity=LongType(),
    ),
    "customers": _table(
        Customer_ID=_ID, Customer_Created_At=_TIME, Customer_Updated_At=_TIME,
        Customer_Province=_TEXT, Customer_Country=_TEXT,
    ),
    # one row per page event
    "journey": _table(
        Customer_IP=_TEXT, session=LongType(), Event_Time=_TIME, Event=_TEXT,
        Time_On_Page=DecimalType(18, 6), Product_ID=_ID, Product_Name=_TEXT,
        Collection_Name=_TEXT, Search_Term=_TEXT,
    ),
    "abandoned": _table(
        Order_ID=_ID, Order_Created_At=_TIME, Customer_ID=_ID, Order_Referring_Site=_TEXT,
    ),
    # one row per variant
    "products": _table(
        Product_ID=_ID, Product_Title=_TEXT, Product_Type=_TEXT, Product_Published_At=_TEXT,
        Product_Created_At=_TIME, Variant_Price=_MONEY, Variant_Created_At=_TIME,
    ),
}


class MissingColumnsError(ValueError):
    """A table lacks columns that a query needs."""


def check_columns(df: DataFrame, table: str, columns: Iterable[str]) -> None:
    """Raise :class:`MissingColumnsError` naming every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"table {table!r} lacks the columns {', '.join(missing)}")
