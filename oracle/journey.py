from __future__ import annotations

from oracle import tables as t

_PAGES = "('click', 'error', 'signup', 'view')"

# First event of every session.
_FIRSTS = """(SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY Customer_IP, session ORDER BY Event_Time, event_id) AS r
  FROM v_journey) WHERE r = 1) AS firsts"""

_PER_VISITOR = "SELECT Customer_IP, max(session) AS session FROM v_journey GROUP BY Customer_IP"

_SESSION_TIME = """
SELECT session, Customer_IP, sum(Time_On_Page) AS seconds, min(Event_Time) AS first_time
FROM v_journey GROUP BY session, Customer_IP"""

_periods = t.per_period(
    """
  SELECT day, sum(sessions) AS n
  FROM (SELECT Customer_IP, CAST(Event_Time AS DATE) AS day, count(DISTINCT session) AS sessions
        FROM v_journey GROUP BY 1, 2) GROUP BY day""",
    "session_count", "2024-02-05",
)


def _page_time(measure: str) -> str:
    return f"""
SELECT Event, CAST({measure} AS DOUBLE) AS Time_On_Page,
       {t.duration_label(measure)} AS Time_On_Page_Display
FROM v_journey WHERE Event IN {_PAGES} GROUP BY Event"""


def _time_table(keys: str, names: str) -> str:
    return f"""
SELECT {keys}, CAST(sum(v_journey.Time_On_Page) AS DOUBLE) AS total_seconds,
       {t.duration_label("sum(v_journey.Time_On_Page)")} AS Time_On_Page
FROM v_journey WHERE {names} IS NOT NULL GROUP BY ALL"""


def _visitors(name: str, where: str = "true") -> str:
    return f"""
SELECT {name}, count(DISTINCT Customer_IP) AS Unique_Visitors FROM v_journey
WHERE {name} IS NOT NULL AND {where} GROUP BY {name} ORDER BY 2 DESC, 1 LIMIT 10"""


SQL = {
    "cj_total_viewers": "SELECT count(DISTINCT Customer_IP) AS total_viewers FROM v_journey",
    "cj_repeat_viewers":
        f"SELECT count(*) AS repeat_viewers FROM ({_PER_VISITOR}) WHERE session >= 2",
    "cj_total_sessions":
        f"SELECT CAST(sum(session) AS BIGINT) AS total_sessions FROM ({_PER_VISITOR})",
    "cj_peak_session_rows": """
SELECT Customer_IP, session, Event_Time, Event, CAST(Time_On_Page AS DOUBLE) AS Time_On_Page
FROM (SELECT *, row_number() OVER (PARTITION BY Customer_IP
                                   ORDER BY session DESC, Event_Time, event_id) AS r
      FROM v_journey) WHERE r = 1""",
    "cj_filtered": t.date_filtered(
        "v_journey", "Event_Time",
        """Customer_IP, Event_Time, Event, CAST(Time_On_Page AS DOUBLE) AS Time_On_Page, session,
       Product_ID, Product_Name, Collection_Name, Search_Term, event_id""",
    ),
    "cj_sessions_weekday_weekend": t.weekday_weekend(_FIRSTS, "Event_Time"),
    "cj_session_duration_total_avg": f"""
WITH totals AS (
  SELECT sum(seconds) AS total, CAST(sum(seconds) AS DOUBLE) / count(*) AS mean
  FROM ({_SESSION_TIME})
)
SELECT CAST(total AS DOUBLE) AS total_seconds, mean AS average_seconds,
       {t.duration_label("total")} AS total_duration, {t.duration_label("mean")} AS average_duration
FROM totals""",
    "cj_avg_sessions_per_customer": f"""
SELECT round_even(avg(session), 2) AS average_sessions_per_customer FROM ({_PER_VISITOR})""",
    "cj_top10_sessions_by_time": f"""
SELECT Customer_IP, {t.duration_label("seconds")} AS Time_On_Page,
       CAST(first_time AS DATE) AS Event_time
FROM ({_SESSION_TIME}) ORDER BY seconds DESC, session, Customer_IP LIMIT 10""",
    "cj_top_ips_by_session":
        f"{_PER_VISITOR} ORDER BY max(session) DESC, Customer_IP LIMIT 10",
    **{f"cj_sessions_per_{period}": sql for period, sql in _periods.items()},
    "cj_top_products_viewed": _visitors("Product_Name"),
    "cj_top_collections_viewed": _visitors("Collection_Name"),
    "cj_top_cart_products": _visitors("Product_Name", "Event = 'purchase'"),
    "cj_search_term_freq": """
WITH counts AS (
  SELECT Search_Term, count(*) AS Count FROM v_journey
  WHERE Search_Term IS NOT NULL GROUP BY Search_Term
)
SELECT Search_Term, Count,
       CAST(Count AS DOUBLE) / (SELECT max(Count) FROM counts) AS Weight FROM counts""",
    "cj_cart_total": """
SELECT CAST(sum(visitors) AS BIGINT) AS total_added_to_cart
FROM (SELECT Product_Name, count(DISTINCT Customer_IP) AS visitors FROM v_journey
      WHERE Event = 'purchase' AND Product_Name IS NOT NULL GROUP BY Product_Name)""",
    "cj_sessions_by_weekday_name": t.by_weekday_name(_FIRSTS, "Event_Time"),
    "cj_sessions_by_hour": t.by_hour(_FIRSTS, "Event_Time", "Number_Of_Sessions"),
    "cj_avg_time_per_event":
        _page_time("CAST(sum(v_journey.Time_On_Page) AS DOUBLE) / count(v_journey.Time_On_Page)"),
    "cj_total_time_per_event": _page_time("sum(v_journey.Time_On_Page)"),
    "cj_time_per_product": _time_table(
        "coalesce(CAST(Product_ID AS VARCHAR), 'nan') AS Product_ID, Product_Name", "Product_Name"
    ),
    "cj_time_per_collection": _time_table("Collection_Name", "Collection_Name"),
    "cj_viewers_per_event": f"""
SELECT Event, count(DISTINCT Customer_IP) AS Total_Viewers
FROM v_journey WHERE Event IN {_PAGES} GROUP BY Event""",
    "cj_bounce_rate_customer": """
SELECT round_even(100 * (CAST(count(*) FILTER (WHERE seconds < 2500) AS DOUBLE) / count(*)), 2)
       AS bounce_rate
FROM (SELECT Customer_IP, sum(Time_On_Page) AS seconds FROM v_journey GROUP BY Customer_IP)""",
    "cj_bounce_rate_event": f"""
WITH lasts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY Customer_IP, session
                                 ORDER BY Event_Time DESC, event_id DESC) AS r
    FROM v_journey WHERE Event IN {_PAGES})
  WHERE r = 1 AND Time_On_Page < 10
),
rates AS (
  SELECT names.Event,
         (SELECT count(DISTINCT Customer_IP) FROM lasts l WHERE l.Event = names.Event) AS bounced,
         (SELECT count(DISTINCT Customer_IP) FROM v_journey j WHERE j.Event = names.Event) AS seen
  FROM (VALUES ('click'), ('error'), ('signup'), ('view')) AS names(Event)
)
SELECT Event, coalesce(round_even(100 * (CAST(bounced AS DOUBLE) / nullif(seen, 0)), 2), 0)
       AS Bounce_Rate FROM rates""",
}
