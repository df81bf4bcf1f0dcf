"""SQL of the llm queries that SQL can express."""

from __future__ import annotations

FREQUENT = """SELECT query_normalized, count(*) AS n_rows, count(*) / (SELECT count(query_normalized) FROM analytics_events)::DOUBLE AS share
FROM analytics_events WHERE query_normalized IS NOT NULL GROUP BY query_normalized
HAVING count(*) * 1000 >= 6 * (SELECT count(query_normalized) FROM analytics_events)"""

DISTINCT = " UNION ALL ".join(
    f"SELECT '{level}' AS level, {day} AS day, {kind} AS event_type, count(DISTINCT visitor_id) AS n_visitors, 0.0::DOUBLE AS error_bound FROM analytics_events WHERE visitor_id IS NOT NULL {by}"
    for level, day, kind, by in (
        ("total", "NULL::DATE", "NULL::VARCHAR", ""),
        ("day", "CAST(occurred_at AS DATE)", "NULL::VARCHAR", "GROUP BY CAST(occurred_at AS DATE)"),
        ("event_type", "NULL::DATE", "event_type", "GROUP BY event_type"),
        ("day_event_type", "CAST(occurred_at AS DATE)", "event_type", "GROUP BY CAST(occurred_at AS DATE), event_type"),
    )
)

# mid-rank of each score in its search, nulls 0, then the own vector ascending
RANKING = """WITH long AS (
  UNPIVOT (SELECT search_event_id, id, fts_score, semantic_score, coalesce(author_score, -1) AS author_score, coalesce(recency_score, -1) AS recency_score FROM paper_briefs)
  ON fts_score, semantic_score, author_score, recency_score INTO NAME score VALUE value),
p AS (SELECT search_event_id, id, CASE WHEN value < 0 THEN 0 ELSE rank() OVER (PARTITION BY search_event_id, score, value < 0 ORDER BY value) - 1
  + (count(*) OVER (PARTITION BY search_event_id, score, value) + 1) / 2.0::DOUBLE END AS p FROM long),
v AS (SELECT search_event_id, id, list_sort(list(p)) AS v FROM p GROUP BY search_event_id, id),
r AS (SELECT search_event_id, id, row_number() OVER (PARTITION BY search_event_id ORDER BY v DESC, id) AS rank FROM v)
"""

SQL = {
    "p2_found": f"SELECT query_normalized FROM ({FREQUENT}) WHERE trim(query_normalized) <> ''",
    "p2_frequent": FREQUENT,
    "p6_distinct_visitors": DISTINCT,
    "p6_merged": DISTINCT,
    "p7_found": RANKING + "SELECT search_event_id, id FROM r WHERE rank <= 3",
    "p7_ranking": RANKING + "SELECT search_event_id, id, rank FROM r",
}
