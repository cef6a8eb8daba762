"""The canonical tables as CTEs."""

from __future__ import annotations

_ORDER_FACTS = """
       o_orderkey AS Order_ID,
       o_custkey AS Customer_ID,
       CAST(o_totalprice AS DECIMAL(18,2)) AS Order_Total_Price,
       CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice ELSE 0 END AS DECIMAL(18,2))
           AS Order_Refund_Amount,
       o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS Order_Created_At,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN o_orderdate END
           AS Order_Cancelled_At,
       CASE WHEN o_orderkey % 20 <> 0 THEN o_orderpriority END AS Order_Referring_Site"""

# Values that differ between the lines of an order, by order key and line number.
_LINE_PRICE = """CAST(CASE WHEN line = 1 AND o_orderkey % 3 = 0 THEN NULL
                 WHEN line > 1 AND o_orderkey % 5 = 0
                 THEN CAST(o_totalprice AS DECIMAL(18,2)) + line
                 ELSE o_totalprice END AS DECIMAL(18,2)) AS Order_Total_Price"""
_LINE_SITE = """CASE WHEN o_orderkey % 20 <> 0 AND NOT (line = 1 AND o_orderkey % 4 = 1)
            THEN o_orderpriority END AS Order_Referring_Site"""

TABLES = {
    "v_orders": f"""
SELECT * EXCLUDE (Order_Total_Price, Order_Referring_Site, o_orderkey, o_totalprice, o_orderpriority, line),
       {_LINE_PRICE}, {_LINE_SITE}
FROM (
  SELECT {_ORDER_FACTS},
         o_orderkey, o_totalprice, o_orderpriority, coalesce(l_linenumber, 0) AS line,
         o_orderkey * 8 + coalesce(l_linenumber, 0) AS row_order,
         CASE WHEN NOT (coalesce(l_linenumber, 0) = 1 AND o_orderkey % 6 = 2) THEN c_name END
             AS Customer_Name,
         l_partkey - (l_partkey - 1) % 4 AS Product_ID,
         p_name AS Product_Name,
         CAST(l_quantity AS BIGINT) AS Product_Quantity
  FROM orders
  JOIN customer ON c_custkey = o_custkey
  LEFT JOIN lineitem ON l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = l_partkey - (l_partkey - 1) % 4)""",
    # one row per order: its first line as it is
    "v_first": """
SELECT * FROM v_orders QUALIFY row_number() OVER (PARTITION BY Order_ID ORDER BY row_order) = 1""",
    # one row per order: the first known value of each column
    "v_known": """
SELECT Order_ID,
       arg_min(Customer_Name, row_order) FILTER (WHERE Customer_Name IS NOT NULL) AS Customer_Name,
       arg_min(Order_Total_Price, row_order) FILTER (WHERE Order_Total_Price IS NOT NULL)
           AS Order_Total_Price,
       arg_min(Order_Created_At, row_order) FILTER (WHERE Order_Created_At IS NOT NULL)
           AS Order_Created_At
FROM v_orders GROUP BY Order_ID""",
    "v_customers": """
SELECT c_custkey AS Customer_ID, n_name AS Customer_Province, r_name AS Customer_Country,
       TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER))
           + to_hours(CAST(c_custkey % 24 AS INTEGER)) AS Customer_Created_At
FROM customer
JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey""",
    "v_keyed_events": """
SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_ts
FROM events""",
    "v_journey": """
SELECT CAST(user_id AS VARCHAR) AS Customer_IP, ts AS Event_Time, event_type AS Event,
       CAST(value AS DECIMAL(18,2)) AS Time_On_Page,
       CAST(sum(CASE WHEN previous_ts IS NULL OR ts - previous_ts > INTERVAL 12 HOURS
                     THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session,
       k AS Product_ID, p_name AS Product_Name, p_type AS Collection_Name,
       CASE WHEN event_type = 'view' THEN p_brand END AS Search_Term, event_id
FROM v_keyed_events
LEFT JOIN part ON p_partkey = k""",
    "v_abandoned": f"""
SELECT {_ORDER_FACTS}
FROM orders WHERE o_orderstatus = 'P'""",
    "v_products": """
SELECT p_partkey AS Product_ID, p_name AS Product_Title,
       CASE WHEN p_size % 10 = 0 THEN '' ELSE p_type END AS Product_Type,
       CAST(p_retailprice AS DECIMAL(18,2)) AS Variant_Price,
       TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 1000 AS INTEGER))
           + to_hours(CAST(p_partkey % 24 AS INTEGER)) AS Product_Created_At,
       CASE WHEN p_partkey % 8 <> 0
            THEN strftime(DATE '1995-01-01' + CAST(p_partkey % 1000 AS INTEGER), '%Y-%m-%d')
                 || 'T00:00:00Z' END AS Product_Published_At
FROM part""",
    "v_published": "\nSELECT * FROM v_products WHERE Product_Published_At IS NOT NULL",
}

_USES = {
    "v_first": ["v_orders"],
    "v_known": ["v_orders"],
    "v_journey": ["v_keyed_events"],
    "v_published": ["v_products"],
}

DAY_NAMES = """(VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'),
              (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) AS names(number, name)"""


def with_tables(sql: str) -> str:
    """Put the CTEs that a query names in front of it."""
    used: list[str] = []

    def use(table: str) -> None:
        for below in _USES.get(table, []):
            use(below)
        if table not in used:
            used.append(table)

    for table in TABLES:
        if table in sql:
            use(table)
    ctes = ",\n".join(f"{table} AS ({TABLES[table]})" for table in used)
    body = sql.strip()
    if not used:
        return body
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"


def date_filtered(table: str, column: str, shown: str) -> str:
    """Rows of a table up to midnight of its last date."""
    return f"""
SELECT {shown} FROM {table}
WHERE {column} >= (SELECT date_trunc('day', min({column})) FROM {table})
  AND {column} <= (SELECT date_trunc('day', max({column})) FROM {table})"""


def percent_label(number: str) -> str:
    return f"CAST(CAST(round_even({number}, 1) AS DECIMAL(38,1)) AS VARCHAR) || '%'"


def decimal_text(number: str) -> str:
    return f"regexp_replace(CAST(CAST({number} AS DECIMAL(38,2)) AS VARCHAR), '0$', '')"


def money_label(number: str) -> str:
    return "'€' || " + decimal_text(number)


def duration_label(seconds: str) -> str:
    whole = f"CAST(floor(({seconds}) / 60) AS BIGINT)"
    return f"CAST({whole} // 60 AS VARCHAR) || ' hr ' || CAST({whole} % 60 AS VARCHAR) || ' mini'"


def weekday_weekend(source: str, ts: str) -> str:
    """Rows on weekdays and weekends of a one-row-per-unit source."""
    return f"""
WITH flagged AS (
  SELECT CASE WHEN isodow({ts}) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS Category FROM {source}
), counted AS (
  SELECT c.Category, count(f.Category) AS Count
  FROM (VALUES ('Weekday'), ('Weekend')) AS c(Category)
  LEFT JOIN flagged f ON f.Category = c.Category GROUP BY c.Category
)
SELECT Category, Count,
       100 * (CAST(Count AS DOUBLE) / nullif((SELECT sum(Count) FROM counted), 0)) AS Percentage,
       {percent_label("100 * (CAST(Count AS DOUBLE) / nullif((SELECT sum(Count) FROM counted), 0))")} AS Label
FROM counted"""


def by_weekday_name(source: str, ts: str) -> str:
    return f"""
SELECT name AS Day, count(s.ts) AS Count
FROM {DAY_NAMES}
LEFT JOIN (SELECT {ts} AS ts FROM {source}) s ON isodow(s.ts) = number + 1
GROUP BY name"""


def by_hour(source: str, ts: str, name: str) -> str:
    return f"""
SELECT CAST(h.hour AS INTEGER) AS Hour_Of_Day, count(s.ts) AS {name}
FROM range(1, 25) AS h(hour)
LEFT JOIN (SELECT {ts} AS ts FROM {source}) s ON hour(s.ts) + 1 = h.hour
GROUP BY h.hour"""


def date_spine(daily: str, as_of: str) -> str:
    """CTE ``spine``: a daily query (day, n) on all days up to a date."""
    return f"""
WITH daily AS ({daily}), spine AS (
  SELECT CAST(d.day AS DATE) AS day, coalesce(n, 0) AS n
  FROM (SELECT unnest(generate_series((SELECT min(day) FROM daily)::TIMESTAMP,
                                      TIMESTAMP '{as_of}', INTERVAL 1 DAY)) AS day) d
  LEFT JOIN daily ON daily.day = CAST(d.day AS DATE)
)"""


def per_period(daily: str, name: str, as_of: str) -> dict[str, str]:
    """Day, month, quarter and year sums of a daily query (day, n) on the date spine."""
    spine = date_spine(daily, as_of)
    return {"day": f"{spine}\nSELECT day, CAST(n AS BIGINT) AS {name} FROM spine",
            **{k: spine + v for k, v in period_sums("spine", "n", name, "BIGINT").items()}}


def period_sums(source: str, amount: str, name: str, kind: str) -> dict[str, str]:
    total = f"CAST(sum({amount}) AS {kind}) AS {name}"
    return {
        "month": f"""
SELECT strftime(day, '%Y-%m') AS month, strftime(date_trunc('month', day), '%b %Y') AS month_label,
       {total} FROM {source} GROUP BY ALL""",
        "quarter": f"""
SELECT CAST(year(day) AS VARCHAR) || 'Q' || CAST(quarter(day) AS VARCHAR) AS quarter, {total}
FROM {source} GROUP BY ALL""",
        "year": f"\nSELECT CAST(year(day) AS INTEGER) AS year, {total} FROM {source} GROUP BY ALL",
    }


def page(source: str, ts: str, amount: str, days: str, name: str, kind: str) -> str:
    """All calendar profiles of a one-row-per-unit source; ``days`` is a query (day, n)."""
    sums = "coalesce(sum(u.amount), 0)"
    periods = {
        "day": ("strftime(day, '%Y%m%d')", "strftime(day, '%Y-%m-%d')"),
        "month": ("strftime(day, '%Y%m')", "strftime(day, '%Y-%m')"),
        "quarter": ("10 * year(day) + quarter(day)", "year(day) || 'Q' || quarter(day)"),
        "year": ("year(day)", "CAST(year(day) AS VARCHAR)"),
    }
    series = "\n".join(
        f"UNION ALL SELECT '{profile}', CAST({position} AS BIGINT), {label}, sum(n) FROM days GROUP BY ALL"
        for profile, (position, label) in periods.items()
    )
    return f"""
WITH u AS (SELECT {ts} AS ts, {amount} AS amount FROM {source}), days AS ({days}), found AS (
SELECT 'category' AS profile, CAST(c.position AS BIGINT) AS position, c.label, {sums} AS amount
FROM (VALUES (0, 'Weekday'), (1, 'Weekend')) AS c(position, label)
LEFT JOIN u ON c.position = CASE WHEN isodow(u.ts) >= 6 THEN 1 ELSE 0 END GROUP BY ALL
UNION ALL SELECT 'weekday', number, name, {sums} FROM {DAY_NAMES}
LEFT JOIN u ON isodow(u.ts) = number + 1 GROUP BY ALL
UNION ALL SELECT 'hour', h.hour, CAST(h.hour AS VARCHAR), {sums} FROM range(1, 25) AS h(hour)
LEFT JOIN u ON hour(u.ts) + 1 = h.hour GROUP BY ALL
{series}
)
SELECT profile, position, label, CAST(amount AS {kind}) AS {name} FROM found"""
