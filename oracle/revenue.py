from __future__ import annotations

from oracle import tables as t
from oracle.orders import SHOWN

_DAILY = """
WITH daily AS (
  SELECT CAST(Order_Created_At AS DATE) AS day, coalesce(sum(Order_Total_Price), 0) AS amount
  FROM v_first GROUP BY 1
)"""

_periods = t.period_sums("daily", "amount", "Order_Total_Price", "DOUBLE")

_SHARE = "100 * (CAST(amount AS DOUBLE) / nullif(CAST((SELECT sum(amount) FROM summed) AS DOUBLE), 0))"

SQL = {
    "rev_total": """
SELECT CAST(coalesce(sum(Order_Total_Price), 0) AS DOUBLE) AS total_revenue FROM v_first""",
    "rev_avg": """
SELECT round_even(CAST(sum(Order_Total_Price) AS DOUBLE) / count(Order_Total_Price), 2)
       AS avg_order_revenue FROM v_first""",
    "rev_refund_total": """
SELECT CAST(coalesce(sum(Order_Refund_Amount), 0) AS DOUBLE) AS total_refund FROM v_first""",
    "rev_filtered": t.date_filtered("v_orders", "Order_Created_At", SHOWN),
    "rev_weekday_weekend": f"""
WITH summed AS (
  SELECT c.Category, coalesce(sum(o.Order_Total_Price), 0) AS amount
  FROM (VALUES ('Weekday'), ('Weekend')) AS c(Category)
  LEFT JOIN v_first o
    ON c.Category = CASE WHEN isodow(Order_Created_At) >= 6 THEN 'Weekend' ELSE 'Weekday' END
  GROUP BY c.Category
)
SELECT Category, CAST(amount AS DOUBLE) AS Revenue, {_SHARE} AS Percentage,
       {t.percent_label(_SHARE)} AS Label, {t.money_label("amount")} AS Total_Revenue
FROM summed""",
    "rev_by_weekday_name": f"""
WITH summed AS (
  SELECT name, coalesce(sum(Order_Total_Price), 0) AS amount
  FROM {t.DAY_NAMES} LEFT JOIN v_first ON isodow(Order_Created_At) = number + 1 GROUP BY name
)
SELECT name AS Day, CAST(amount AS DOUBLE) AS Revenue, {t.money_label("amount")} AS Total_Revenue
FROM summed""",
    "rev_by_hour": f"""
WITH summed AS (
  SELECT h.hour, coalesce(sum(Order_Total_Price), 0) AS amount
  FROM range(1, 25) AS h(hour) LEFT JOIN v_first ON hour(Order_Created_At) + 1 = h.hour
  GROUP BY h.hour
)
SELECT CAST(hour AS INTEGER) AS Hour_Of_Day, CAST(amount AS DOUBLE) AS Total_Revenue,
       {t.money_label("amount")} AS Overall_Revenue
FROM summed""",
    "rev_per_day": _DAILY + "\nSELECT day, CAST(amount AS DOUBLE) AS Order_Total_Price FROM daily",
    **{f"rev_per_{period}": _DAILY + sql for period, sql in _periods.items()},
    "rev_page": t.page(
        "v_first", "Order_Created_At", "Order_Total_Price",
        _DAILY + " SELECT day, amount AS n FROM daily WHERE day IS NOT NULL", "Order_Total_Price", "DOUBLE",
    ),
    "rev_by_referring_site": """
SELECT Order_Referring_Site, CAST(coalesce(sum(Order_Total_Price), 0) AS DOUBLE) AS Total_Revenue
FROM v_first WHERE Order_Referring_Site IS NOT NULL GROUP BY Order_Referring_Site
ORDER BY Total_Revenue DESC, Order_Referring_Site LIMIT 5""",
}
