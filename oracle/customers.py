from __future__ import annotations

from oracle.tables import date_filtered

_SPEND = """
SELECT Customer_Name, CAST(coalesce(sum(Order_Total_Price), 0) AS DOUBLE) AS Order_Total_Price
FROM v_first WHERE Customer_Name IS NOT NULL GROUP BY Customer_Name
"""

_SUMMARY = """
SELECT Customer_Name, count(DISTINCT Order_ID) AS Orders_Placed,
       CAST(coalesce(sum(Order_Total_Price), 0) AS DOUBLE) AS Total_Spending
FROM v_known WHERE Customer_Name IS NOT NULL
GROUP BY Customer_Name HAVING count(DISTINCT Order_ID) >= 2
"""

SQL = {
    "cust_total_listed":
        "SELECT count(DISTINCT Customer_ID) AS total_listed_customers FROM v_customers",
    "cust_total_paying":
        "SELECT count(DISTINCT Customer_ID) AS total_paying_customers FROM v_orders",
    "cust_repeat_count": f"SELECT count(*) AS repeat_customers FROM ({_SUMMARY})",
    "cust_filtered": date_filtered(
        "v_customers", "Customer_Created_At",
        "Customer_ID, Customer_Province, Customer_Country, Customer_Created_At",
    ),
    "cust_top_spend": _SPEND + "ORDER BY coalesce(sum(v_first.Order_Total_Price), 0) DESC, Customer_Name LIMIT 5",
    "cust_least_spend": _SPEND + "ORDER BY coalesce(sum(v_first.Order_Total_Price), 0), Customer_Name LIMIT 5",
    "cust_order_summary": _SUMMARY,
    "cust_by_province": """
SELECT Customer_Province, count(DISTINCT Customer_ID) AS Unique_Customers
FROM v_customers WHERE Customer_Province IS NOT NULL GROUP BY Customer_Province""",
    "cust_by_country": """
SELECT Customer_Country, count(DISTINCT Customer_ID) AS Unique_Customers
FROM v_customers WHERE Customer_Country IS NOT NULL GROUP BY Customer_Country""",
}
