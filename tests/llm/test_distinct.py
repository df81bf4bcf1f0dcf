import random
from datetime import datetime, timedelta

from ocellus.llm.distinct import add_buckets, bucket_counts, distinct_visitors, merge_pairs, pairs
from ocellus.llm.queries import QUERIES

SCHEMA = "visitor_id string, occurred_at timestamp_ntz, event_type string, bucket string"


def brute(rows):
    out = {}
    for v, at, kind, _ in rows:
        if v is None:
            continue
        day = at.date() if at else None
        for key in (("total", None, None), ("day", day, None), ("event_type", None, kind), ("day_event_type", day, kind)):
            out.setdefault(key, set()).add(v)
    return {k: len(s) for k, s in out.items()}


def read(df):
    return {(r.level, r.day, r.event_type): r.n_visitors for r in df.collect()}


def make(n=3000):
    r = random.Random(2)
    return [(r.choice(["hot"] * 300 + [None] * 50 + [""] + [str(i) for i in range(600)]), r.choice([None, datetime(2024, 1, 1) + timedelta(hours=r.randrange(100))]), r.choice(["a", "b", None]), "x") for _ in range(n)]


def test_against_brute_force(spark):
    rows = make()
    for buckets in (1, 7, 256):
        assert read(distinct_visitors(spark.createDataFrame(rows, SCHEMA), buckets)) == brute(rows)


def test_partial_results_merge(spark):
    rows = make()
    a, b = (pairs(spark.createDataFrame(x, SCHEMA)) for x in (rows[:1500], rows[1000:]))
    assert read(add_buckets(bucket_counts(a.unionByName(b).distinct()))) == brute(rows)
    whole = bucket_counts(pairs(spark.createDataFrame(rows, SCHEMA)))
    low, high = whole.filter("bucket < 100"), whole.filter("bucket >= 100")
    assert read(add_buckets(low.unionByName(high))) == brute(rows)


def test_pairs_merge_across_days_and_types(spark):
    rows = make()
    by_day_and_type = {}
    for row in rows:
        by_day_and_type.setdefault((row[1] and row[1].day, row[2]), []).append(row)
    parts = [pairs(spark.createDataFrame(x, SCHEMA)) for x in by_day_and_type.values()]
    assert len(parts) > 10
    assert read(add_buckets(bucket_counts(merge_pairs(*parts, parts[0])))) == brute(rows)


def test_pairs_are_a_query(spark, tmp_path):
    spark.createDataFrame(make(), SCHEMA).write.parquet(str(tmp_path / "analytics_events.parquet"))
    assert read(add_buckets(bucket_counts(QUERIES["p6_pairs"](spark, str(tmp_path))))) == brute(make())


def test_empty(spark):
    assert distinct_visitors(spark.createDataFrame([], SCHEMA)).collect() == []
