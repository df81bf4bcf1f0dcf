"""The event log as a stream: unique clicks and daily activity, with late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.functions.text import normalize_query
from ocellus.operators.ingest import EVENTS


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def unique_click_stream(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Clicks that are the first to arrive of their search and paper; state is dropped once the watermark has passed them."""
    clicks = events.filter("event_type = 'paper_click' and coalesce(related_search_event_id, 0) <> 0").withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late)
    return clicks.dropDuplicatesWithinWatermark(["related_search_event_id", "paper_id"]).select("id", F.col("related_search_event_id").alias("search_event_id"), "visitor_id", "query_raw", normalize_query("query_raw").alias("query_normalized"), "paper_id", "paper_title", F.col("occurred_at").alias("clicked_at"))


def daily_stream(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily counts with approximate distinct visitors; redelivered events count once while they are within the watermark."""
    timed = events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    kind = lambda k: F.col("event_type") == k
    return (
        timed.groupBy(F.window("at", "1 day").alias("day"))
        .agg(F.count_if(kind("page_view")).alias("page_views"), F.count_if(kind("search")).alias("searches"), F.approx_count_distinct(F.when(kind("page_view"), F.col("visitor_id"))).alias("unique_visitors"))
        .select(F.to_date("day.start").alias("date"), "page_views", "searches", "unique_visitors")
    )


def append_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
