"""Distinct counts by hash-range decomposition.

Identifiers are split by hash into disjoint buckets. Within a bucket, (identifier, group) pairs are deduplicated and each
combination of groups is counted exactly; since an identifier lies in one bucket only, a total is the sum of its bucket
counts, with an error bound of 0. Partial results, one row per bucket and combination, can be kept and added over buckets.
Over days and types they are merged from pairs(), which is a set: a union of pairs, deduplicated, gives the pairs of the union.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("total", "day", "event_type", "day_event_type")


def pairs(events: DataFrame, buckets: int = 256) -> DataFrame:
    """The distinct (bucket, visitor_id, day, event_type); mergeable by union and distinct. Null identifiers are left out;
    a null day or type is a group of its own. A visitor with any number of rows is reduced before the shuffle."""
    lean = events.filter("visitor_id is not null").select("visitor_id", F.to_date("occurred_at").alias("day"), "event_type")
    return lean.distinct().withColumn("bucket", F.pmod(F.xxhash64("visitor_id"), F.lit(buckets)).cast("int"))


def merge_pairs(*parts: DataFrame) -> DataFrame:
    """The pairs of all parts, made with as many buckets each: of days, types or sources that may overlap."""
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def bucket_counts(deduplicated: DataFrame) -> DataFrame:
    """(bucket, level, day, event_type, n_visitors): exact counts within each bucket."""
    at = deduplicated.repartition("bucket", "visitor_id")  # the pairs of an identifier stay together, however many tasks there are; counts are added up before they leave a task
    level = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), (F.col("day") if "day" in x.split("_") else F.lit(None).cast("date")).alias("g_day"), (F.col("event_type") if "event_type" in x else F.lit(None).cast("string")).alias("g_type")) for x in LEVELS]))
    unique = at.select("bucket", "visitor_id", level.alias("x")).select("bucket", "visitor_id", "x.level", F.col("x.g_day").alias("day"), F.col("x.g_type").alias("event_type")).distinct()
    return unique.groupBy("bucket", "level", "day", "event_type").agg(F.count(F.lit(1)).alias("n_visitors"))


def add_buckets(partial: DataFrame) -> DataFrame:
    """Adds the counts of disjoint buckets."""
    return partial.groupBy("level", "day", "event_type").agg(F.sum("n_visitors").cast("bigint").alias("n_visitors")).withColumn("error_bound", F.lit(0.0))


def distinct_visitors(events: DataFrame, buckets: int = 256) -> DataFrame:
    """(level, day, event_type, n_visitors, error_bound) for each day, type, day and type, and in total. Counts are exact.
    Repeated rows don't matter; no rows give no counts; further columns are ignored."""
    return add_buckets(bucket_counts(pairs(events, buckets)))
