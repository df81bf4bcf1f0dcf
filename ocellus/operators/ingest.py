"""Recording events: typed rows, context of clicks, unique clicks and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.functions.text import normalize_query
from ocellus.operators.usage import first_clicks

EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("event_type", T.StringType()),
        T.StructField("occurred_at", T.TimestampNTZType()),
        *[T.StructField(n, T.StringType()) for n in ("visitor_id", "ip_hash", "user_agent", "referer", "path", "query_raw", "query_normalized")],
        T.StructField("year_from", T.IntegerType()),
        T.StructField("year_to", T.IntegerType()),
        T.StructField("sort", T.StringType()),
        T.StructField("result_count", T.IntegerType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("paper_id", T.IntegerType()),
        T.StructField("paper_title", T.StringType()),
        T.StructField("related_search_event_id", T.IntegerType()),
    ]
)
TRIMMED = {"user_agent": 512, "referer": 512}


def typed_events(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Rows in the events' schema: missing columns null, the query of searches and clicks normalised, a missing time now, long headers cut."""
    names = set(rows.columns)
    out = rows.withColumn("event_type", F.lit(kind)) if kind else rows
    asked = F.col("event_type").isin("search", "paper_click")
    columns = []
    for f in EVENTS.fields:
        c = F.col(f.name) if f.name in names or f.name == "event_type" else F.lit(None)
        if f.name == "occurred_at":
            c = F.coalesce(c.cast("timestamp_ntz"), F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"))
        elif f.name == "query_normalized" and "query_raw" in names:
            c = F.when(asked, normalize_query("query_raw")).otherwise(c)
        elif f.name in TRIMMED:
            c = F.substring(c.cast("string"), 1, TRIMMED[f.name])
        columns.append(c.cast(f.dataType).alias(f.name))
    return out.select(*columns)


def client_address(headers: DataFrame) -> DataFrame:
    """Adds client: the first address of x_forwarded_for, else x_real_ip, else peer; and ip_hash, its SHA-256."""
    first = F.nullif(F.btrim(F.split_part("x_forwarded_for", F.lit(","), F.lit(1))), F.lit(""))
    out = headers.withColumn("client", F.coalesce(first, F.nullif(F.btrim("x_real_ip"), F.lit("")), "peer"))
    return out.withColumn("ip_hash", F.sha2("client", 256))


def visitor_hash(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("visitor_id", F.sha2(F.col(column).cast("string"), 256))


def with_context(clicks: DataFrame, events: DataFrame) -> DataFrame:
    """Unique-click rows of click events: visitor and query come from the search that the click names if it exists, else from the click. Clicks that name none
    are no unique clicks. Of a search's rows, redelivered ones among them, the least counts."""
    named = clicks.filter("event_type = 'paper_click' and coalesce(related_search_event_id, 0) <> 0 and paper_id is not null")
    context = events.filter("event_type = 'search'").select(F.col("id").cast("bigint").alias("__search"), F.struct("visitor_id", "query_raw").alias("c")).groupBy("__search").agg(F.min("c").alias("c"))
    joined = named.join(context, named["related_search_event_id"].cast("bigint") == F.col("__search"), "left")
    visitor = F.coalesce(F.nullif("c.visitor_id", F.lit("")), F.col("visitor_id"))
    query = F.coalesce(F.nullif("c.query_raw", F.lit("")), F.col("query_raw"))
    return joined.select("id", F.col("related_search_event_id").alias("search_event_id"), visitor.alias("visitor_id"), query.alias("query_raw"), normalize_query(query).alias("query_normalized"), "paper_id", "paper_title", F.col("occurred_at").alias("clicked_at"))


def unique_clicks(events: DataFrame) -> DataFrame:
    """The unique clicks of an event log: per search and paper the first."""
    return first_clicks(with_context(events.filter("event_type = 'paper_click'"), events))


def insert_unique(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` whose (search_event_id, paper_id) isn't there yet, each once."""
    return first_clicks(new).join(existing.select("search_event_id", "paper_id"), ["search_event_id", "paper_id"], "left_anti").select(*new.columns)


def append_events(rows: DataFrame, path: str) -> None:
    """Appends to an event log partitioned by day, so that date ranges read only their days."""
    rows.withColumn("day", F.to_date("occurred_at")).repartition("day").write.mode("append").partitionBy("day").parquet(path)
