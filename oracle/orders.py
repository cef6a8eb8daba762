from __future__ import annotations

from oracle import tables as t

SHOWN = """Order_ID, Customer_ID, Customer_Name,
       CAST(Order_Total_Price AS DOUBLE) AS Order_Total_Price,
       CAST(Order_Refund_Amount AS DOUBLE) AS Order_Refund_Amount,
       Order_Created_At, Order_Cancelled_At, Order_Referring_Site,
       Product_ID, Product_Name, Product_Quantity"""

_DAILY = "SELECT CAST(Order_Created_At AS DATE) AS day, count(*) AS n FROM v_known GROUP BY 1"

_periods = t.per_period(_DAILY, "order_count", "2001-08-15")

_FIRST = """
SELECT Customer_Name, arg_min(Order_ID, row_order) AS Order_ID,
       CAST(arg_min(Order_Total_Price, row_order) FILTER (WHERE Order_Total_Price IS NOT NULL) AS DOUBLE)
           AS Order_Total_Price
FROM v_orders WHERE Customer_Name IS NOT NULL GROUP BY Customer_Name
"""

_PER_CUSTOMER = "SELECT Customer_ID, count(DISTINCT Order_ID) AS n FROM v_orders GROUP BY Customer_ID"

SQL = {
    "ord_total": "SELECT count(DISTINCT Order_ID) AS total_orders FROM v_orders",
    "ord_filtered": t.date_filtered("v_orders", "Order_Created_At", SHOWN),
    "ord_weekday_weekend": t.weekday_weekend("v_known", "Order_Created_At"),
    "ord_by_weekday_name": t.by_weekday_name("v_known", "Order_Created_At"),
    "ord_by_hour": t.by_hour("v_known", "Order_Created_At", "Number_Of_Orders"),
    **{f"ord_per_{period}": sql for period, sql in _periods.items()},
    "ord_page": t.page(
        "v_known", "Order_Created_At", "1",
        t.date_spine(_DAILY, "2001-08-15") + " SELECT day, n FROM spine", "order_count", "BIGINT",
    ),
    "ord_avg_per_customer":
        f"SELECT round_even(avg(n), 2) AS average_orders_per_customer FROM ({_PER_CUSTOMER})",
    "ord_cancelled":
        "SELECT count(Order_Cancelled_At) AS total_cancelled_orders FROM v_orders",
    "ord_max_per_customer": f"SELECT max(n) AS max_orders_per_customer FROM ({_PER_CUSTOMER})",
    "ord_avg_value": """
SELECT round_even(CAST(sum(Order_Total_Price) AS DOUBLE) / count(Order_Total_Price), 2)
       AS average_order_value FROM v_known""",
    "ord_highest_valued": _FIRST + "ORDER BY Order_Total_Price DESC NULLS LAST, Customer_Name LIMIT 5",
    "ord_least_valued": _FIRST + "ORDER BY Order_Total_Price NULLS LAST, Customer_Name LIMIT 5",
    "ord_by_referring_site": """
SELECT Order_Referring_Site, count(Order_ID) AS Total_Orders
FROM v_first WHERE Order_Referring_Site IS NOT NULL GROUP BY Order_Referring_Site
ORDER BY Total_Orders DESC, Order_Referring_Site LIMIT 5""",
}
