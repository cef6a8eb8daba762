from __future__ import annotations

from oracle import tables as t

SQL = {
    "prod_avg_per_customer": """
SELECT round_even(avg(n), 2) AS average_products_per_customer
FROM (SELECT Customer_ID, count(DISTINCT Product_ID) AS n FROM v_orders GROUP BY Customer_ID)""",
    "prod_total_published": "SELECT count(DISTINCT Product_ID) AS total_products FROM v_published",
    "prod_filtered": t.date_filtered(
        "v_products", "Product_Created_At",
        """Product_ID, Product_Title, Product_Type, CAST(Variant_Price AS DOUBLE) AS Variant_Price,
       Product_Created_At, Product_Published_At""",
    ),
    "prod_count_by_type": """
SELECT CASE WHEN Product_Type = '' THEN 'No Type' ELSE Product_Type END AS Product_Type,
       count(DISTINCT Product_ID) AS Count
FROM v_published WHERE Product_Type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "prod_most_sold": """
SELECT Product_Name, CAST(coalesce(sum(Product_Quantity), 0) AS BIGINT) AS Product_Quantity
FROM v_orders WHERE Product_Name IS NOT NULL GROUP BY Product_Name
ORDER BY 2 DESC, 1 LIMIT 5""",
    "prod_most_priced": """
SELECT Product_ID, Product_Title, CAST(max(Variant_Price) AS DOUBLE) AS Variant_Price
FROM v_published WHERE Product_ID IS NOT NULL AND Product_Title IS NOT NULL GROUP BY 1, 2
ORDER BY 3 DESC, 1, 2 LIMIT 5""",
    "prod_least_priced": """
SELECT Product_ID, Product_Title, CAST(min(Variant_Price) AS DOUBLE) AS Variant_Price
FROM v_published WHERE Product_ID IS NOT NULL AND Product_Title IS NOT NULL GROUP BY 1, 2
ORDER BY 3, 1, 2 LIMIT 5""",
    "prod_unsold": """
SELECT DISTINCT CAST(Product_ID AS VARCHAR) AS Product_ID, Product_Title,
       CAST(split_part(Product_Published_At, 'T', 1) AS DATE) AS Product_Published_At
FROM v_published p
WHERE NOT EXISTS (SELECT 1 FROM v_orders o WHERE o.Product_ID = p.Product_ID)""",
    "prod_price_quartiles": """
SELECT quantile_cont(CAST(Variant_Price AS DOUBLE), 0.25) AS lower_quartile,
       quantile_cont(CAST(Variant_Price AS DOUBLE), 0.75) AS upper_quartile
FROM v_published""",
    "prod_price_quantiles": """
SELECT CAST(quantile_disc(Variant_Price, 0.1) AS DOUBLE) AS low_price,
       CAST(quantile_disc(Variant_Price, 0.5) AS DOUBLE) AS middle_price,
       CAST(quantile_disc(Variant_Price, 0.9) AS DOUBLE) AS high_price
FROM v_published""",
    "prod_price_histogram": f"""
WITH prices AS (SELECT CAST(Variant_Price AS DOUBLE) AS price FROM v_published),
stats AS (
  SELECT min(price) AS low, max(price) AS high, count(*) AS n,
         quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr FROM prices
),
binned AS (
  SELECT *, greatest(1, CAST(floor((high - low)
            / CASE WHEN iqr > 0 AND n > 1 THEN 2 * iqr / pow(n, 1.0 / 3.0)
                   ELSE (high - low) / 5 END) AS BIGINT)) AS bins FROM stats
),
edges AS (
  SELECT i, CASE WHEN i = 0 THEN low - (high - low) * 0.001
                 WHEN i = bins THEN high
                 ELSE low + i * ((high - low) / bins) END AS edge
  FROM binned, unnest(range(0, bins + 1)) AS r(i)
),
placed AS (
  SELECT price, (SELECT count(*) FROM edges WHERE edge < price) AS bin
  FROM prices WHERE price IS NOT NULL
),
bin_edges AS (
  SELECT upper.i AS bin, greatest(0, round_even(low_edge.edge, 3)) AS bin_left,
         round_even(upper.edge, 3) AS bin_right
  FROM edges upper JOIN edges low_edge ON low_edge.i = upper.i - 1
)
SELECT b.bin, bin_left, bin_right,
       {t.decimal_text("round_even(bin_left, 2)")} || ' - '
       || {t.decimal_text("round_even(bin_right, 2)")} AS Price_Range,
       count(price) AS Count
FROM bin_edges b LEFT JOIN placed p ON p.bin = b.bin GROUP BY ALL""",
}
