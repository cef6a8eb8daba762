from __future__ import annotations


def _id(key: str) -> str:
    return f"CASE WHEN {key} % 4 = 0 THEN '#' ELSE '' END || CAST({key} AS VARCHAR)"


def _time(ts: str, key: str) -> str:
    return f"CASE WHEN {key} % 6 <> 0 THEN CAST(date_trunc('second', {ts}) AS TIMESTAMP) END"


def _name(joint: str) -> str:
    return f"CASE WHEN o_orderkey % 9 <> 0 THEN 'The \"' || CAST(o_custkey AS VARCHAR) || {joint} || 'first' END"


_PRICE = "CASE WHEN o_orderkey % 5 > 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END"

SQL = {
    "load_orders": f"""
SELECT {_id("o_orderkey")} AS Order_ID,
       CASE WHEN o_orderkey % 9 <> 0 THEN 'The "' || CAST(o_custkey AS VARCHAR) || '", first' END
           AS Customer_Name,
       CASE WHEN o_orderkey % 5 > 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END
           AS Order_Total_Price,
       {_time("o_orderdate", "o_orderkey")} AS Order_Created_At,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 7 AS BIGINT) END AS Product_Quantity
FROM orders""",
    "load_journey": f"""
SELECT CAST(user_id AS VARCHAR) AS Customer_IP,
       CASE WHEN event_id % 8 <> 0 THEN CAST(event_id % 8 AS BIGINT) END AS session,
       {_time("ts", "event_id")} AS Event_Time,
       CASE WHEN event_id % 11 <> 0 THEN event_type END AS Event,
       CASE WHEN event_id % 5 <> 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS Time_On_Page,
       {_id("event_id")} AS Product_ID
FROM events""",
    "load_products": f"""
SELECT {_id("p_partkey")} AS Product_ID, p_name AS Product_Title,
       CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS Product_Type,
       {_time("TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 1000 AS INTEGER))", "p_partkey")}
           AS Product_Created_At,
       CASE WHEN p_partkey % 5 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) END
           AS Variant_Price
FROM part""",
}
_BROKEN = _name("CASE WHEN o_orderkey % 2 = 0 THEN '\",' || chr(10) ELSE '\", ' END")

SQL |= {
    "load_files_orders": SQL["load_orders"]
    .replace("SELECT ", f"SELECT {_id('o_custkey')} AS Customer_ID, {_BROKEN} AS Customer_Name, ", 1)
    .replace("""CASE WHEN o_orderkey % 9 <> 0 THEN 'The "' || CAST(o_custkey AS VARCHAR) || '", first' END
           AS Customer_Name,
       """, ""),
    "load_files_journey": SQL["load_journey"],
    "load_files_products": SQL["load_products"],
    "load_files_first_last": f"""
SELECT Customer_ID, arg_min(Order_ID, o_orderkey) AS First_Order, arg_max(Order_ID, o_orderkey) AS Last_Order,
       min(struct_pack(k := o_orderkey, p := price)).p AS First_Price,
       max(struct_pack(k := o_orderkey, p := price)).p AS Last_Price
FROM (SELECT o_orderkey, {_id("o_custkey")} AS Customer_ID, {_id("o_orderkey")} AS Order_ID, {_PRICE} AS price
      FROM orders)
GROUP BY Customer_ID""",
    "load_files_rejects": f"""
SELECT {_id("o_orderkey")} AS Order_ID, "column", "text" FROM (
    SELECT o_orderkey, 'Order_Total_Price' AS "column",
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' EUR' AS "text"
    FROM orders WHERE o_orderkey % 5 = 1
    UNION ALL SELECT o_orderkey, 'Order_Created_At', 'not a time' FROM orders WHERE o_orderkey % 6 = 0
    UNION ALL SELECT o_orderkey, 'Product_Quantity', '1.5' FROM orders WHERE o_orderkey % 7 = 0)""",
}
