"""Frequent values by iceberg multi-hash filtering.

First scan: exact counts of coarse buckets under several hash functions, hashes * buckets numbers whatever the data.
A value that reaches the threshold makes every one of its buckets reach it, so values with a bucket below it are
dropped; what passes is counted exactly in a second scan. Memory is bounded by the buckets in the first scan and by the
few survivors in the second; no value is sampled and none is lost.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_numbers(value: Column, hashes: int, buckets: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), value), F.lit(buckets)).cast("int") for k in range(hashes)]


def frequent_values(df: DataFrame, column: str, support: float | str, hashes: int = 3, buckets: int = 8192) -> DataFrame:
    """(<column>, n_rows, share) of each value that makes up at least `support` of the rows whose value is not null.

    Counts are exact. Null is no value; the empty string is one. Repeated rows count each. An empty table or one of nulls gives
    no rows. At most 1 / support values can come out; ties at the threshold all do. To the driver come hashes * buckets
    counts, of which at most hashes / support reach the threshold. Further columns are ignored."""
    share = Fraction(str(support))
    if not 0 < share <= 1:
        raise ValueError("support must be above 0 and at most 1")
    values = df.select(F.col(column).alias("value")).filter("value is not null")
    numbered = values.select(F.explode(F.array(*[F.struct(F.lit(k).alias("hash"), b.alias("bucket")) for k, b in enumerate(bucket_numbers(F.col("value"), hashes, buckets))])).alias("x"))
    counts = numbered.groupBy("x.hash", "x.bucket").count().collect()  # bounded: hashes * buckets rows
    total = sum(r["count"] for r in counts if r["hash"] == 0)
    least = -(-total * share.numerator // share.denominator)
    heavy: list[list[int]] = [[] for _ in range(hashes)]
    for r in counts:
        if r["count"] >= least:
            heavy[r["hash"]].append(r["bucket"])
    survivors = values
    for number, own in zip(bucket_numbers(F.col("value"), hashes, buckets), heavy, strict=True):
        survivors = survivors.filter(number.isin(own) if own else F.lit(False))
    counted = survivors.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= least)
    return counted.select(F.col("value").alias(column), "n_rows", (F.col("n_rows") / F.lit(max(total, 1))).alias("share"))
