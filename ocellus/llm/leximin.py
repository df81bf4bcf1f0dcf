"""One ranking from scores of different scale: leximin over percentiles.

Each score becomes its percentile among the scores of the same group, so only order counts. An item's own percentiles are
sorted ascending and items are compared by these arrays, the weakest score first: no strong score can mask a weak one.

Percentiles and ranks are found by grouped_scan(), which spreads a group over many tasks: a group may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.operators.scan import grouped_scan

SCORES = ("fts_score", "semantic_score", "author_score", "recency_score")


def percentiles(long: DataFrame, group: str) -> DataFrame:
    """(group, score, value, percentile) of the distinct values in (group, score, value): the share of the group's rows
    below the value plus half of the share of its equals. Equal values are counted before they are ranked."""
    counted = long.groupBy(group, "score", "value").agg(F.count(F.lit(1)).alias("equal"))
    return grouped_scan(counted, [group, "score"], [F.col("value")], value="equal", row="at", before="below")


def leximin(df: DataFrame, group: str = "search_event_id", item: str = "id", scores: tuple[str, ...] = SCORES, support: bool = True) -> DataFrame:
    """(group, item, rank, support): the rank from 1 in each group, and the ascending percentiles that decide it. Without support these are left out, and the places
    of scores in their group are compared as they are, which gives the same order: every percentile of a group is a place divided by the group's size.

    A null or NaN score gives no support: percentile 0. Rows without group or item are left out; a repeated (group, item) counts once, with the
    greatest of each score. Equal vectors are ranked by item. An empty table gives no rows; further columns are ignored."""
    clean = [F.when(~F.isnan(s), F.col(s)).alias(f"s{i}") for i, s in enumerate(scores)]
    items = df.select(F.col(group).alias("g"), F.col(item).alias("i"), *[F.col(s).cast("double").alias(s) for s in scores]).filter("g is not null and i is not null").select("g", "i", *clean).groupBy("g", "i").agg(*[F.max(f"s{i}").alias(f"s{i}") for i in range(len(scores))])
    long = items.select("g", "i", F.explode(F.array(*[F.struct(F.lit(k).alias("score"), F.col(f"s{k}").alias("value")) for k in range(len(scores))])).alias("x")).select("g", "i", "x.score", "x.value")
    sizes = items.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    places = percentiles(long.filter("value is not null"), "g").withColumnRenamed("value", "v")
    scored = long.join(places, (long["g"] == places["g"]) & (long["score"] == places["score"]) & (long["value"] == places["v"]), "left").select(long["g"], long["i"], long["score"], F.coalesce(F.col("below") + (F.col("equal") + 1) / 2, F.lit(0.0)).alias("p"))
    vectors = scored.groupBy("g", "i").agg(F.sort_array(F.collect_list("p")).alias("p"))  # as many numbers as there are scores
    if not support:
        ranked = grouped_scan(vectors, ["g"], [F.col("p").desc(), F.col("i")], row="rank")
        return ranked.select(F.col("g").alias(group), F.col("i").alias(item), "rank")
    relative = vectors.join(sizes, "g").select("g", "i", F.transform("p", lambda p: p / F.col("size")).alias("support"))
    ranked = grouped_scan(relative, ["g"], [F.col("support").desc(), F.col("i")], row="rank")
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), "rank", "support")
