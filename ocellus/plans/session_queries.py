"""Queries of the sessions operator and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ocellus.operators.sessions import sessions
from ocellus.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(table(spark, folder, "analytics_events")).select("visitor_id", "first_event_id", "last_event_id")


def p3_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(table(spark, folder, "analytics_events"))


NUMBERED = """
WITH e AS (SELECT DISTINCT id, event_type, occurred_at, visitor_id, related_search_event_id AS search_id FROM analytics_events),
v AS (SELECT e.id, e.event_type, e.occurred_at, coalesce(e.visitor_id, CASE WHEN e.event_type = 'paper_click' THEN s.visitor_id END) AS visitor_id
      FROM e LEFT JOIN (SELECT id, visitor_id FROM e WHERE event_type = 'search') s ON s.id = e.search_id),
o AS (SELECT *, lag(occurred_at) OVER w AS before FROM v WHERE visitor_id IS NOT NULL WINDOW w AS (PARTITION BY visitor_id ORDER BY occurred_at, id)),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR occurred_at - before > INTERVAL 1800 SECOND THEN 1 ELSE 0 END)
      OVER (PARTITION BY visitor_id ORDER BY occurred_at, id ROWS UNBOUNDED PRECEDING) AS session_no FROM o)
"""

QUERIES = {"p3_found": p3_found, "p3_sessions": p3_sessions}
SQL = {
    "p3_found": NUMBERED + "SELECT visitor_id, first(id ORDER BY occurred_at, id) AS first_event_id, last(id ORDER BY occurred_at, id) AS last_event_id FROM n GROUP BY visitor_id, session_no",
    "p3_sessions": NUMBERED
    + """SELECT visitor_id, CAST(session_no AS BIGINT) AS session_no, min(occurred_at) AS start_at, max(occurred_at) AS end_at,
      (epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 1000000.0::DOUBLE AS duration_s,
      first(id ORDER BY occurred_at, id) AS first_event_id, last(id ORDER BY occurred_at, id) AS last_event_id, count(*) AS n_events,
      count(*) FILTER (event_type = 'page_view') AS n_page_view, count(*) FILTER (event_type = 'search') AS n_search, count(*) FILTER (event_type = 'paper_click') AS n_paper_click
      FROM n GROUP BY visitor_id, session_no""",
}
