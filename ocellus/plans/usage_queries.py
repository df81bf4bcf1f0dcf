"""Queries of usage analytics and their SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ocellus.functions.text import beijing_time, normalize_query
from ocellus.operators import ingest, usage
from ocellus.sources.stores import EventLog
from ocellus.sources.tables import table
from ocellus.storage import shared_folder

FROM, TO = date(2019, 3, 5), date(2019, 3, 12)


def events(spark, folder):
    return table(spark, folder, "analytics_events")


def clicks(spark, folder):
    return table(spark, folder, "search_paper_unique_clicks")


def q_overview(spark, folder):
    return usage.overview(events(spark, folder), clicks(spark, folder))


def q_overview_date_range(spark, folder):
    return usage.overview(events(spark, folder), clicks(spark, folder), FROM, TO)


def q_top_keywords(spark, folder):
    return usage.top_keywords(events(spark, folder), limit=100)


def q_top_keywords_date_range(spark, folder):
    return usage.top_keywords(events(spark, folder), FROM, TO, 20)


def q_daily_activity(spark, folder):
    return usage.daily(events(spark, folder))


def q_recent_searches_page2(spark, folder):
    return usage.recent_searches(events(spark, folder), page=2, page_size=50)


def q_search_count(spark, folder):
    return usage.search_count(events(spark, folder), FROM, TO)


def q_searches_keyword_like(spark, folder):
    return usage.searches(events(spark, folder), keyword="Dry  EYE").select("id", "query_raw", "query_normalized")


def q_recent_clicks_left_join(spark, folder):
    return usage.recent_clicks(clicks(spark, folder), events(spark, folder), limit=50)


def q_clicks_keyword_like(spark, folder):
    return usage.clicks_in(clicks(spark, folder), FROM, TO, "cataract").select("id", "paper_title")


def q_click_export(spark, folder):
    return usage.click_export(clicks(spark, folder), events(spark, folder))


def q_search_export_click_lists(spark, folder):
    return usage.search_export(events(spark, folder).dropDuplicates(["id"]), clicks(spark, folder))


def q_click_ranking(spark, folder):
    return usage.click_ranking(clicks(spark, folder), limit=100)


def q_unique_click_dedup(spark, folder):
    return ingest.unique_clicks(events(spark, folder)).select("id", "search_event_id", "visitor_id", "query_normalized", "paper_id", "clicked_at")


def q_recorded_clicks(spark, folder):
    """The unique clicks that an event log writes when it is given first all other events and then the clicks."""
    log = EventLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}")
    click = F.coalesce(F.col("event_type") == "paper_click", F.lit(False))
    log.record_all(events(spark, folder).filter(~click))
    log.record_all(events(spark, folder).filter(click))
    return log.clicks.select("id", "search_event_id", "visitor_id", "query_normalized", "paper_id", "clicked_at")


def q_insert_unique_clicks(spark, folder):
    stored = clicks(spark, folder)
    return ingest.insert_unique(stored.filter("clicked_at < timestamp_ntz'2019-03-12 00:00:00'"), stored).select("search_event_id", "paper_id", "clicked_at")


def q_click_context_lookup(spark, folder):
    return ingest.with_context(events(spark, folder).filter("event_type = 'paper_click'"), events(spark, folder)).select("id", "search_event_id", "visitor_id", "query_normalized").distinct()


def q_search_event_lookup(spark, folder):
    return events(spark, folder).filter("id = 21 and event_type = 'search'").select("id", "visitor_id", "query_raw").limit(1)


def q_beijing_time(spark, folder):
    return events(spark, folder).select("id", beijing_time("occurred_at").alias("shown")).distinct()


def q_query_normalize(spark, folder):
    return events(spark, folder).select("id", normalize_query("query_raw").alias("query")).distinct()


def q_visitor_sha256(spark, folder):
    return events(spark, folder).select("id", F.sha2(F.coalesce("visitor_id", F.lit("")), 256).alias("visitor_hash")).distinct()


def q_typed_search_events(spark, folder):
    found = events(spark, folder).filter("event_type = 'search'").select("id", "occurred_at", "visitor_id", "query_raw", "user_agent", "result_count")
    return ingest.typed_events(found, "search").select("id", "event_type", "occurred_at", "query_normalized", "user_agent", "result_count", "status_code").distinct()


def q_step_timing_agg(spark, folder):
    steps = events(spark, folder).filter("latency_ms is not null").select(F.col("sort").alias("step"), F.floor("latency_ms").cast("double").alias("ms"))
    return usage.step_timing(steps, 10)


def between(column: str) -> str:
    return f"{column} >= TIMESTAMP '2019-03-05' AND {column} < TIMESTAMP '2019-03-13'"


ACTIVITY = "count(*) FILTER (event_type = 'page_view') AS page_views, count(DISTINCT CASE WHEN event_type = 'page_view' THEN visitor_id END) AS unique_visitors, count(*) FILTER (event_type = 'search') AS searches, count(DISTINCT CASE WHEN event_type = 'search' THEN visitor_id END) AS search_visitors"
NORM = r"trim(regexp_replace(lower(coalesce(query_raw, '')), '[\s\p{Z}]+', ' ', 'g'))"
TOP = "SELECT query_normalized AS keyword, count(*) AS searches, count(DISTINCT visitor_id) AS visitors, count(*) FILTER (coalesce(result_count, 0) = 0) AS zero_result_searches, max(occurred_at) AS last_searched_at FROM analytics_events WHERE event_type = 'search' AND coalesce(query_normalized, '') <> '' {more} GROUP BY 1 ORDER BY 2 DESC, 5 DESC, 1 LIMIT {n}"
TIMES = "LEFT JOIN (SELECT id AS eid, min(occurred_at) AS searched_at FROM analytics_events GROUP BY id) e ON e.eid = c.search_event_id"
SEARCH = "id, occurred_at, visitor_id, query_raw, query_normalized, year_from, year_to, sort, result_count, latency_ms, path"
BEIJING = "strftime(timezone('Asia/Shanghai', timezone('UTC', {x})), '%Y-%m-%d %H:%M:%S')"
NORM_OF = r"trim(regexp_replace(lower(coalesce({x}, '')), '[\s\p{{Z}}]+', ' ', 'g'))"
CONTEXT = f"""WITH s AS (SELECT id AS sid, min({{'v': visitor_id, 'q': query_raw}}) AS c FROM analytics_events WHERE event_type = 'search' GROUP BY id),
n AS (SELECT id, related_search_event_id AS search_event_id, coalesce(nullif(c.v, ''), visitor_id) AS visitor_id, {NORM_OF.format(x="coalesce(nullif(c.q, ''), query_raw)")} AS query_normalized, paper_id, occurred_at AS clicked_at
  FROM analytics_events LEFT JOIN s ON s.sid = related_search_event_id WHERE event_type = 'paper_click' AND coalesce(related_search_event_id, 0) <> 0 AND paper_id IS NOT NULL)"""

QUERIES = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}
SQL = {
    "overview": f"SELECT * FROM (SELECT {ACTIVITY} FROM analytics_events), (SELECT count(*) AS paper_clicks FROM search_paper_unique_clicks)",
    "overview_date_range": f"SELECT * FROM (SELECT {ACTIVITY} FROM analytics_events WHERE {between('occurred_at')}), (SELECT count(*) AS paper_clicks FROM search_paper_unique_clicks WHERE {between('clicked_at')})",
    "top_keywords": TOP.format(more="", n=100),
    "top_keywords_date_range": TOP.format(more=f"AND {between('occurred_at')}", n=20),
    "daily_activity": f"SELECT CAST(occurred_at AS DATE) AS date, {ACTIVITY}, count(*) FILTER (event_type = 'search' AND coalesce(result_count, 0) = 0) AS zero_result_searches FROM analytics_events GROUP BY 1",
    "recent_searches_page2": f"SELECT {SEARCH} FROM analytics_events WHERE event_type = 'search' ORDER BY occurred_at DESC, id DESC LIMIT 50 OFFSET 50",
    "search_count": f"SELECT count(*) AS total FROM analytics_events WHERE event_type = 'search' AND {between('occurred_at')}",
    "searches_keyword_like": "SELECT id, query_raw, query_normalized FROM analytics_events WHERE event_type = 'search' AND (query_normalized LIKE '%dry eye%' OR lower(coalesce(query_raw, '')) LIKE '%dry eye%')",
    "recent_clicks_left_join": f"SELECT id, clicked_at, visitor_id, paper_id, paper_title, search_event_id AS related_search_event_id, query_raw, query_normalized, searched_at FROM (SELECT * FROM search_paper_unique_clicks ORDER BY clicked_at DESC, id DESC LIMIT 50) c {TIMES}",
    "clicks_keyword_like": f"SELECT id, paper_title FROM search_paper_unique_clicks WHERE {between('clicked_at')} AND (query_normalized LIKE '%cataract%' OR lower(coalesce(query_raw, '')) LIKE '%cataract%' OR lower(coalesce(paper_title, '')) LIKE '%cataract%')",
    "click_export": f"SELECT clicked_at, searched_at, visitor_id, search_event_id AS related_search_event_id, query_raw, query_normalized, paper_id, paper_title FROM search_paper_unique_clicks c {TIMES}",
    "search_export_click_lists": f"""SELECT id AS search_event_id, {SEARCH.replace('id, ', '', 1)}, ip_hash, user_agent, coalesce(n, 0) AS clicked_paper_count, coalesce(ids, '') AS clicked_paper_ids, coalesce(titles, '') AS clicked_paper_titles, coalesce(times, '') AS clicked_at_times
      FROM (SELECT DISTINCT {SEARCH}, ip_hash, user_agent FROM analytics_events WHERE event_type = 'search') e
      LEFT JOIN (SELECT search_event_id AS sid, count(*) AS n, string_agg(CAST(paper_id AS VARCHAR), '; ' ORDER BY clicked_at, id) AS ids, string_agg(nullif(paper_title, ''), '; ' ORDER BY clicked_at, id) AS titles,
      string_agg({BEIJING.format(x='clicked_at')}, '; ' ORDER BY clicked_at, id) AS times FROM search_paper_unique_clicks GROUP BY 1) c ON c.sid = e.id""",
    "click_ranking": "SELECT query_normalized, paper_id, paper_title, count(*) AS unique_click_count, count(DISTINCT visitor_id) AS unique_visitors, min(clicked_at) AS first_clicked_at, max(clicked_at) AS last_clicked_at FROM search_paper_unique_clicks GROUP BY 1, 2, 3 ORDER BY 4 DESC, 7 DESC, 1 NULLS FIRST, 2, 3 NULLS FIRST LIMIT 100",
    "unique_click_dedup": CONTEXT + "SELECT id, search_event_id, visitor_id, query_normalized, paper_id, clicked_at FROM n QUALIFY row_number() OVER (PARTITION BY search_event_id, paper_id ORDER BY clicked_at, id) = 1",
    "recorded_clicks": CONTEXT + "SELECT id, search_event_id, visitor_id, query_normalized, paper_id, clicked_at FROM n QUALIFY row_number() OVER (PARTITION BY search_event_id, paper_id ORDER BY clicked_at, id) = 1",
    "insert_unique_clicks": "SELECT search_event_id, paper_id, clicked_at FROM search_paper_unique_clicks WHERE clicked_at >= TIMESTAMP '2019-03-12'",
    "click_context_lookup": CONTEXT + "SELECT DISTINCT id, search_event_id, visitor_id, query_normalized FROM n",
    "search_event_lookup": "SELECT DISTINCT id, visitor_id, query_raw FROM analytics_events WHERE id = 21 AND event_type = 'search'",
    "beijing_time": f"SELECT DISTINCT id, {BEIJING.format(x='occurred_at')} AS shown FROM analytics_events",
    "query_normalize": f"SELECT DISTINCT id, {NORM} AS query FROM analytics_events",
    "visitor_sha256": "SELECT DISTINCT id, sha256(coalesce(visitor_id, '')) AS visitor_hash FROM analytics_events",
    "typed_search_events": f"SELECT DISTINCT id, event_type, occurred_at, {NORM} AS query_normalized, user_agent[1:512] AS user_agent, result_count, NULL::INTEGER AS status_code FROM analytics_events WHERE event_type = 'search'",
    "step_timing_agg": "SELECT sort AS step, count(*) AS calls, sum(floor(latency_ms)) AS total_ms, sum(floor(latency_ms)) / count(*) AS ms_per_call, sum(floor(latency_ms)) / 10 AS ms_per_search FROM analytics_events WHERE latency_ms IS NOT NULL GROUP BY 1",
}
