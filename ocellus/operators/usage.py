"""Usage analytics over events and unique clicks. Days and date ranges are those of the stored time, which is UTC; `date_to` is
included. Every function takes a frame and gives a frame."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions.text import beijing_time

KINDS = {"page_view": "page_views", "search": "searches"}


def clamp(value: int | None, default: int, least: int, most: int) -> int:
    return min(max(int(value or default), least), most)


def between(column: str, date_from: date | None, date_to: date | None) -> Column:
    """Plain comparisons with literals, so they reach the scan."""
    out = F.lit(True)
    if date_from:
        out &= F.col(column) >= F.lit(date_from.isoformat()).cast("timestamp_ntz")
    if date_to:
        out &= F.col(column) < F.lit((date_to + timedelta(days=1)).isoformat()).cast("timestamp_ntz")
    return out


def holds(keyword: str | None, normalized: str, *raw: str) -> Column:
    """A keyword, its white space collapsed, in the normalised column or in raw ones in lower case. % and _ in it stand for any text and any character."""
    k = " ".join((keyword or "").lower().split())
    if not k:
        return F.lit(True)
    out = F.col(normalized).like(f"%{k}%")
    for c in raw:
        out |= F.lower(F.coalesce(c, F.lit(""))).like(f"%{k}%")
    return out


def searches(events: DataFrame, date_from: date | None = None, date_to: date | None = None, keyword: str | None = None, nonempty: bool = False) -> DataFrame:
    out = events.filter((F.col("event_type") == "search") & between("occurred_at", date_from, date_to)).filter(holds(keyword, "query_normalized", "query_raw"))
    return out.filter(F.coalesce("query_normalized", F.lit("")) != "") if nonempty else out


def clicks_in(clicks: DataFrame, date_from: date | None = None, date_to: date | None = None, keyword: str | None = None) -> DataFrame:
    return clicks.filter(between("clicked_at", date_from, date_to)).filter(holds(keyword, "query_normalized", "query_raw", "paper_title"))


def activity() -> list[Column]:
    """Counts by kind and of its distinct visitors."""
    is_ = {k: F.col("event_type") == k for k in KINDS}
    return [
        F.count_if(is_["page_view"]).alias("page_views"),
        F.count_distinct(F.when(is_["page_view"], F.col("visitor_id"))).alias("unique_visitors"),
        F.count_if(is_["search"]).alias("searches"),
        F.count_distinct(F.when(is_["search"], F.col("visitor_id"))).alias("search_visitors"),
    ]


def no_results() -> Column:
    return F.coalesce("result_count", F.lit(0)) == 0


def overview(events: DataFrame, clicks: DataFrame, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """One row of totals; zeros where there is nothing."""
    counted = events.filter(between("occurred_at", date_from, date_to)).agg(*activity())
    clicked = clicks_in(clicks, date_from, date_to).agg(F.count(F.lit(1)).alias("paper_clicks"))
    return counted.crossJoin(clicked)  # one row each


def top_keywords(events: DataFrame, date_from: date | None = None, date_to: date | None = None, limit: int = 20) -> DataFrame:
    asked = searches(events, date_from, date_to, nonempty=True)
    counted = asked.groupBy(F.col("query_normalized").alias("keyword")).agg(F.count(F.lit(1)).alias("searches"), F.count_distinct("visitor_id").alias("visitors"), F.count_if(no_results()).alias("zero_result_searches"), F.max("occurred_at").alias("last_searched_at"))
    return counted.orderBy(F.col("searches").desc(), F.col("last_searched_at").desc(), "keyword").limit(clamp(limit, 20, 1, 10_000))


def daily(events: DataFrame, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    chosen = events.filter(between("occurred_at", date_from, date_to))
    counted = chosen.groupBy(F.to_date("occurred_at").alias("date")).agg(*activity(), F.count_if((F.col("event_type") == "search") & no_results()).alias("zero_result_searches"))
    return counted.orderBy(F.col("date").desc())


SEARCH_COLUMNS = ("occurred_at", "visitor_id", "query_raw", "query_normalized", "year_from", "year_to", "sort", "result_count", "latency_ms", "path")


def search_count(events: DataFrame, date_from: date | None = None, date_to: date | None = None, keyword: str | None = None) -> DataFrame:
    return searches(events, date_from, date_to, keyword).agg(F.count(F.lit(1)).alias("total"))


def recent_searches(events: DataFrame, date_from: date | None = None, date_to: date | None = None, keyword: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page, latest first. A page far back costs as much as the pages before it; use date ranges to go back in time."""
    page, size = max(int(page or 1), 1), clamp(page_size, 20, 1, 200)
    found = searches(events, date_from, date_to, keyword).select("id", *SEARCH_COLUMNS)
    return found.orderBy(F.col("occurred_at").desc(), F.col("id").desc()).offset((page - 1) * size).limit(size)


def with_search_time(clicks: DataFrame, events: DataFrame) -> DataFrame:
    """Clicks with the time of the event that their search_event_id names; null where no event has the id. Of an event that was delivered several times one row counts. Only events
    that a click names are grouped."""
    named = clicks.select(F.col("search_event_id").cast("bigint").alias("id")).distinct()
    times = events.join(named, "id", "left_semi").select(F.col("id").alias("__id"), F.col("occurred_at").alias("searched_at")).groupBy("__id").agg(F.min("searched_at").alias("searched_at"))
    return clicks.join(times, clicks["search_event_id"] == times["__id"], "left").drop("__id")


def recent_clicks(clicks: DataFrame, events: DataFrame, date_from: date | None = None, date_to: date | None = None, keyword: str | None = None, limit: int = 12) -> DataFrame:
    """The limit comes before the join: it can't change which clicks are the latest, and only their events are looked up."""
    latest = clicks_in(clicks, date_from, date_to, keyword).orderBy(F.col("clicked_at").desc(), F.col("id").desc()).limit(clamp(limit, 12, 1, 100))
    joined = with_search_time(latest, events)  # at most 100 clicks
    return joined.select("id", "clicked_at", "visitor_id", "paper_id", "paper_title", F.col("search_event_id").alias("related_search_event_id"), "query_raw", "query_normalized", "searched_at").orderBy(F.col("clicked_at").desc(), F.col("id").desc())


def click_export(clicks: DataFrame, events: DataFrame, date_from: date | None = None, date_to: date | None = None, keyword: str | None = None) -> DataFrame:
    joined = with_search_time(clicks_in(clicks, date_from, date_to, keyword), events)
    return joined.select("clicked_at", "searched_at", "visitor_id", F.col("search_event_id").alias("related_search_event_id"), "query_raw", "query_normalized", "paper_id", "paper_title")


def click_ranking(clicks: DataFrame, date_from: date | None = None, date_to: date | None = None, keyword: str | None = None, limit: int = 20) -> DataFrame:
    counted = clicks_in(clicks, date_from, date_to, keyword).groupBy("query_normalized", "paper_id", "paper_title").agg(F.count(F.lit(1)).alias("unique_click_count"), F.count_distinct("visitor_id").alias("unique_visitors"), F.min("clicked_at").alias("first_clicked_at"), F.max("clicked_at").alias("last_clicked_at"))
    return counted.orderBy(F.col("unique_click_count").desc(), F.col("last_clicked_at").desc(), "query_normalized", "paper_id", "paper_title").limit(clamp(limit, 20, 1, 10_000))


def click_lists(clicks: DataFrame) -> DataFrame:
    """Per search the clicks in their order as joined texts: (search_event_id, clicked_paper_count, clicked_paper_ids, clicked_paper_titles, clicked_at_times).
    A search has one click per paper at most, so a list is as long as its results."""
    listed = clicks.groupBy("search_event_id").agg(F.array_sort(F.collect_list(F.struct("clicked_at", "id", "paper_id", "paper_title"))).alias("x"))
    part = lambda f, keep=None: F.array_join(F.transform(F.filter("x", keep) if keep else F.col("x"), f), "; ")
    return listed.select(
        "search_event_id",
        F.size("x").cast("bigint").alias("clicked_paper_count"),
        part(lambda c: c["paper_id"].cast("string")).alias("clicked_paper_ids"),
        part(lambda c: c["paper_title"], lambda c: F.coalesce(c["paper_title"], F.lit("")) != "").alias("clicked_paper_titles"),
        part(lambda c: beijing_time(c["clicked_at"])).alias("clicked_at_times"),
    )


def search_export(events: DataFrame, clicks: DataFrame, date_from: date | None = None, date_to: date | None = None, keyword: str | None = None) -> DataFrame:
    found = searches(events, date_from, date_to, keyword).select(F.col("id").alias("search_event_id"), *SEARCH_COLUMNS, "ip_hash", "user_agent")
    joined = found.join(click_lists(clicks), "search_event_id", "left")
    return joined.select("search_event_id", *SEARCH_COLUMNS, "ip_hash", "user_agent", F.coalesce("clicked_paper_count", F.lit(0)).alias("clicked_paper_count"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("clicked_paper_ids", "clicked_paper_titles", "clicked_at_times")])


# fixed values: the datasets that can be exported and their columns
EXPORTS = {
    "searches": ("search_event_id", "occurred_at", "visitor_id", "query_raw", "query_normalized", "year_from", "year_to", "sort", "result_count", "latency_ms", "path", "ip_hash", "user_agent", "clicked_paper_count", "clicked_paper_ids", "clicked_paper_titles", "clicked_at_times"),
    "keywords": ("keyword", "searches", "visitors", "zero_result_searches", "last_searched_at"),
    "daily": ("date", "page_views", "unique_visitors", "searches", "search_visitors", "zero_result_searches"),
    "clicks": ("clicked_at", "searched_at", "visitor_id", "related_search_event_id", "query_raw", "query_normalized", "paper_id", "paper_title"),
    "paper_click_ranking": ("query_normalized", "paper_id", "paper_title", "unique_click_count", "unique_visitors", "first_clicked_at", "last_clicked_at"),
}


def export(dataset: str, events: DataFrame, clicks: DataFrame, date_from: date | None = None, date_to: date | None = None, keyword: str | None = None) -> DataFrame:
    """A dataset in its order. The keyword filters searches, clicks and the ranking."""
    if dataset == "searches":
        return search_export(events, clicks, date_from, date_to, keyword).orderBy(F.col("occurred_at").desc(), F.col("search_event_id").desc())
    if dataset == "keywords":
        return top_keywords(events, date_from, date_to, 10_000)
    if dataset == "daily":
        return daily(events, date_from, date_to)
    if dataset == "clicks":
        return click_export(clicks, events, date_from, date_to, keyword).orderBy(F.col("clicked_at").desc(), "related_search_event_id", "paper_id")
    if dataset == "paper_click_ranking":
        return click_ranking(clicks, date_from, date_to, keyword, 10_000)
    raise ValueError(f"unsupported dataset: {dataset}")


def shown(df: DataFrame) -> DataFrame:
    """Times as text in China's time and dates as ISO text, for display and export files."""
    kinds = dict(df.dtypes)
    return df.select(*[(beijing_time(c) if kinds[c].startswith("timestamp") else F.date_format(c, "yyyy-MM-dd") if kinds[c] == "date" else F.col(c)).alias(c) for c in df.columns])


def step_timing(steps: DataFrame, runs: int) -> DataFrame:
    """(step, calls, total_ms, ms_per_call, ms_per_search) of rows (step, ms)."""
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("calls"), F.sum("ms").alias("total_ms")).withColumn("ms_per_call", F.col("total_ms") / F.col("calls")).withColumn("ms_per_search", F.col("total_ms") / F.lit(max(runs, 1)))


def first_clicks(clicks: DataFrame, order: tuple[str, ...] = ("clicked_at", "id")) -> DataFrame:
    """One click per search and paper, the first. The limit of the window is applied before the shuffle too, so repeated clicks on one paper don't travel."""
    w = Window.partitionBy("search_event_id", "paper_id").orderBy(*order)
    return clicks.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
