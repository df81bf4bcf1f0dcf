import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from ocellus.operators.sessions import close, run_starts, sessions

SCHEMA = "id bigint, event_type string, occurred_at timestamp_ntz, visitor_id string, related_search_event_id int, n_events string"
T0 = datetime(2024, 1, 1)


def brute(rows, gap=1800):
    seen, searches = {}, {}
    for r in rows:
        if r[0] is not None and r[2] is not None:
            seen[r[0]] = r
            if r[1] == "search" and r[3] is not None:
                searches[r[0]] = r[3]
    by = {}
    for i, kind, at, visitor, ref, _ in seen.values():
        if visitor is None and kind == "paper_click":
            visitor = searches.get(ref)
        if visitor is not None:
            by.setdefault(visitor, []).append((at, i, kind))
    out = set()
    for visitor, events in by.items():
        events.sort()
        run = [events[0]]
        for e in events[1:]:
            if e[0] - run[-1][0] > timedelta(seconds=gap):
                out.add((visitor, run[0][1], run[-1][1], len(run), sum(k == "search" for *_, k in run)))
                run = []
            run.append(e)
        out.add((visitor, run[0][1], run[-1][1], len(run), sum(k == "search" for *_, k in run)))
    return out


def run(spark, rows, **options):
    got = sessions(spark.createDataFrame(rows, SCHEMA), **options).collect()
    for r in got:
        assert r.duration_s == (r.end_at - r.start_at).total_seconds()
    return {(r.visitor_id, r.first_event_id, r.last_event_id, r.n_events, r.n_search) for r in got}


def test_closing_fills_gaps_up_to_its_size():
    for gap in (1, 2, 63, 64, 65, 1800):
        for pause in (gap - 1, gap, gap + 1):
            if pause < 1:
                continue
            tick = np.array([5, 5 + pause])
            starts = run_starts(np.zeros(2, np.int64), tick, gap)
            assert starts.tolist() == [True, pause > gap], (gap, pause)


def test_closing_keeps_the_outermost_bits():
    words = np.zeros(64, np.uint64)
    words[3] = np.uint64(1) << np.uint64(17)
    assert (close(words, 1800) == words).all()


def test_random_logs_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(1500):
        kind = r.choice(["search", "page_view", "paper_click", "other", None])
        at = T0 + timedelta(microseconds=r.choice([r.randrange(0, 3 * 86_400_000_000), 1_800_000_000 * r.randrange(0, 90), 1_800_000_001 * r.randrange(0, 90)]))
        rows.append((i, kind, at, r.choice(["a", "b", "", None, "c"]), r.choice([None, r.randrange(0, 1600)]), None))
    rows += rows[::9]
    for chunk in (3600, 86_400):
        assert run(spark, rows, chunk_seconds=chunk) == brute(rows)


def test_borders_of_seconds_and_chunks(spark):
    at = [T0, T0 + timedelta(seconds=1800), T0 + timedelta(seconds=3600, microseconds=1), T0 + timedelta(hours=23, minutes=59, seconds=59), T0 + timedelta(days=1, seconds=1)]
    rows = [(i, "search", t, "v", None, None) for i, t in enumerate(at)]
    assert run(spark, rows) == {("v", 0, 1, 2, 2), ("v", 2, 2, 1, 1), ("v", 3, 4, 2, 2)}


def test_ties_nulls_and_redelivered_events(spark):
    rows = [(7, "search", T0, "v", None, None), (3, "page_view", T0, "v", None, None), (3, "page_view", T0, "v", None, None), (None, "search", T0, "v", None, None), (9, "search", None, "v", None, None), (10, "paper_click", T0, None, None, None), (11, "paper_click", T0, None, 99, None), (12, "paper_click", T0, None, 7, None), (13, "page_view", T0, None, 7, None)]
    assert run(spark, rows) == {("v", 3, 12, 3, 1)}


def test_no_events(spark):
    assert run(spark, []) == set()


def test_a_busy_visitor_is_cut_into_chunks(spark):
    df = spark.range(20_000).select("id", F.lit("search").alias("event_type"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 10).cast("decimal(18,6)"))).alias("occurred_at"), F.lit("one").alias("visitor_id"), F.lit(None).cast("int").alias("related_search_event_id"))
    got = sessions(df).collect()
    assert [(r.first_event_id, r.last_event_id, r.n_events) for r in got] == [(0, 19_999, 20_000)]
