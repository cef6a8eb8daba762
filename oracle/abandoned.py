from __future__ import annotations

from oracle import tables as t

_DAILY = "SELECT CAST(Order_Created_At AS DATE) AS day, count(*) AS n FROM v_abandoned GROUP BY 1"

_periods = t.per_period(_DAILY, "abandoned_count", "2001-08-15")

_PER_CUSTOMER = """
SELECT Customer_ID, count(DISTINCT Order_ID) AS n FROM v_abandoned GROUP BY Customer_ID"""

SQL = {
    "abn_total": "SELECT count(DISTINCT Order_ID) AS total_abandoned_orders FROM v_abandoned",
    "abn_filtered": t.date_filtered(
        "v_abandoned", "Order_Created_At",
        "Order_ID, Customer_ID, Order_Created_At, Order_Referring_Site",
    ),
    "abn_weekday_weekend": t.weekday_weekend("v_abandoned", "Order_Created_At"),
    "abn_by_weekday_name": t.by_weekday_name("v_abandoned", "Order_Created_At"),
    "abn_by_hour": t.by_hour("v_abandoned", "Order_Created_At", "Number_Of_Orders"),
    **{f"abn_per_{period}": sql for period, sql in _periods.items()},
    "abn_page": t.page(
        "v_abandoned", "Order_Created_At", "1",
        t.date_spine(_DAILY, "2001-08-15") + " SELECT day, n FROM spine", "abandoned_count", "BIGINT",
    ),
    "abn_avg_per_customer": f"""
SELECT CAST(trunc(avg(n)) AS BIGINT) AS average_abandoned_orders FROM ({_PER_CUSTOMER})""",
    "abn_max_per_customer": f"SELECT max(n) AS most_abandoned_orders FROM ({_PER_CUSTOMER})",
    "abn_by_referring_site": """
SELECT coalesce(Order_Referring_Site, 'Unknown') AS Order_Referring_Site,
       count(DISTINCT coalesce(CAST(Order_ID AS VARCHAR), 'nan')) AS Total_Abandoned_Orders
FROM v_abandoned GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
}
