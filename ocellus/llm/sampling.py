"""Bounded samples for fitting classifiers, and long texts in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

SPAN = 2.0**64


def below(n: int, total: int) -> Column:
    """Whether a row's hash lies in the range that holds about 3 n of `total` rows, all of a smaller table."""
    return F.col("__hash") < int(-SPAN / 2 + SPAN * 3 * n / total) if total > 3 * n else F.lit(True)


def hashed(df: DataFrame, seed: int) -> DataFrame:
    """Adds __hash of the whole row, so rows with a null or constant key are told apart by what else they hold."""
    return df.withColumn("__hash", F.xxhash64(F.lit(seed), *df.columns))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> list[Row]:
    """The n rows of least hash, fewer in a smaller table. The rows are counted first and only a range of hashes that holds about 3 n of them is sorted, so the
    cost of the sort doesn't grow with the table. Where it holds fewer than n, since many rows are the same, all are."""
    own, total = hashed(df, seed), df.count()
    rows = own.filter(below(n, total)).orderBy("__hash", key).limit(n).drop("__hash").collect()
    return rows if len(rows) >= min(n, total) else own.orderBy("__hash", key).limit(n).drop("__hash").collect()


def hash_samples(df: DataFrame, group: str, groups: tuple[str, ...], key: str, n: int, seed: int) -> list[Row]:
    """hash_sample() of each of the given groups at once, in the order of their names: one count, one sort of what the counts let through."""
    own = hashed(df.filter(F.col(group).isin(*groups)), seed)
    totals = {r[group]: r["count"] for r in own.groupBy(group).count().collect()}  # one row per given group
    order = Window.partitionBy(group).orderBy("__hash", key)

    def take(keep: Column) -> list[Row]:
        return own.filter(keep).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).orderBy(group, "__n").drop("__hash", "__n").collect()

    keep = F.lit(False)
    for g, total in totals.items():
        keep |= (F.col(group) == g) & below(n, total)
    rows = take(keep)
    short = [g for g, total in totals.items() if sum(r[group] == g for r in rows) < min(n, total)]
    if short:
        rows = sorted([r for r in rows if r[group] not in short] + take(F.col(group).isin(*short)), key=lambda r: r[group])
    return rows


def pieces(text: str, limit: int, good) -> list[str]:
    """A long text cut into pieces of about `limit` characters where good(before, after) holds for the characters at the cut; where it
    never does, the piece goes on."""
    if len(text) <= limit:
        return [text]
    out, begin, at = [], 0, limit
    while at < len(text):
        if good(text[at - 1], text[at]):
            out.append(text[begin:at])
            begin, at = at, at + limit
        else:
            at += 1
    out.append(text[begin:])
    return out
