"""Sessions of activity by occupancy bitmaps.

Each entity's time is a bitmap with one bit per second. A closing by the gap (a dilation and an erosion, each built by
doubling shifts) fills the pauses that are not longer than the gap; the runs that remain are the sessions, and since a
closing never grows past the outermost bits, a run begins and ends at an event. Event counts per second are then joined
to the runs, and the ends are trimmed to the microsecond.

Bitmaps are sparse: only words that hold an event or can be reached from one by the gap are kept. Time is cut into
chunks, so that one very busy entity is spread over many tasks, and events are reduced to one row per entity and second
before they are brought together: a chunk has at most `chunk_seconds` rows however many events there are. Runs of
neighbouring chunks are joined last, over at most chunk_seconds / gap + 1 runs per entity and chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions.times import from_micros, micros
from ocellus.operators.scan import group_starts

ONE = np.uint64(1)


def shift_up(words: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap moved towards later bits."""
    q, r = divmod(bits, 64)
    out = np.zeros_like(words)
    n = len(words)
    if q < n:
        out[q:] = words[: n - q] << np.uint64(r) if r else words[: n - q]
        if r and q + 1 < n:
            out[q + 1 :] |= words[: n - q - 1] >> np.uint64(64 - r)
    return out


def shift_down(words: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap moved towards earlier bits."""
    q, r = divmod(bits, 64)
    out = np.zeros_like(words)
    n = len(words)
    if q < n:
        out[: n - q] = words[q:] >> np.uint64(r) if r else words[q:]
        if r and q + 1 < n:
            out[: n - q - 1] |= words[q + 1 :] << np.uint64(64 - r)
    return out


def close(words: np.ndarray, gap: int) -> np.ndarray:
    """Morphological closing with `gap` consecutive bits: zeros between ones at most `gap` bits apart become ones.
    The bitmap must have at least `gap` zero bits after its last one."""
    out, reach = words, 1
    while reach < gap:
        step = min(reach, gap - reach)
        out = out | shift_up(out, step)
        reach += step
    reach = 1
    while reach < gap:
        step = min(reach, gap - reach)
        out = out & shift_down(out, step)
        reach += step
    return out


def run_starts(group: np.ndarray, tick: np.ndarray, gap: int) -> np.ndarray:
    """True for each row that opens a run. group: non-decreasing numbers; tick: the second in the group's chunk, increasing
    in each group and never repeated."""
    spare = gap // 64 + 2
    stride = (int(tick.max()) // 64 + 1 + spare) * 64
    position = group.astype(np.int64) * stride + tick
    word, bit = position >> 6, (ONE << (position & 63).astype(np.uint64))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    held, bits = word[first], np.bitwise_or.reduceat(bit, first)
    # slots: each held word and the spare words after it, where neighbours share theirs
    step = np.minimum(np.diff(held), spare + 1)
    slot = np.r_[0, np.cumsum(step)]
    words = np.zeros(int(slot[-1]) + spare + 1, np.uint64)
    words[slot] = bits
    closed = close(words, gap)
    starts = closed & ~shift_up(closed, 1)
    own = np.repeat(slot, np.diff(np.r_[first, len(word)]))
    return (starts[own] & bit) != 0


FIELDS = ("visitor_id", "chunk", "tick", "low_us", "low_id", "high_us", "high_id", "n_events", "n_page_view", "n_search", "n_paper_click")
RUNS = "visitor_id string, start_us bigint, first_event_id bigint, end_us bigint, last_event_id bigint, n_events bigint, n_page_view bigint, n_search bigint, n_paper_click bigint"


def chunk_runs(gap: int):
    """For mapInArrow: rows of FIELDS, sorted by (visitor_id, chunk, tick) with whole chunks in a partition, to RUNS."""

    def flush(t: pa.Table) -> pa.RecordBatch:
        col = {f: t.column(f).combine_chunks() for f in FIELDS}
        number = {f: col[f].to_numpy() for f in FIELDS[1:]}
        new = group_starts([col["visitor_id"], col["chunk"]], None)
        start = run_starts(np.cumsum(new) - 1, number["tick"], gap)
        far = np.r_[True, number["low_us"][1:] - number["high_us"][:-1] > gap * 1_000_000]
        at = np.flatnonzero(start | new | far)  # the exact check of runs whose pause is the gap and a fraction of a second
        end = np.r_[at[1:], len(new)] - 1
        sums = [np.add.reduceat(number[f], at) for f in FIELDS[7:]]
        arrays = [col["visitor_id"].take(pa.array(at)), *map(pa.array, (number["low_us"][at], number["low_id"][at], number["high_us"][end], number["high_id"][end], *sums))]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in RUNS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = group_starts([batch.column("visitor_id"), batch.column("chunk")], [held[-1].column(c).slice(held[-1].num_rows - 1) for c in ("visitor_id", "chunk")] if held else None)
            cuts = np.flatnonzero(new)
            if held and len(cuts):
                whole = [*held, batch.slice(0, cuts[-1])] if cuts[-1] else held
                yield flush(pa.Table.from_batches(whole))
                held = [batch.slice(cuts[-1])]
            elif not held and cuts[-1]:
                yield flush(pa.Table.from_batches([batch.slice(0, cuts[-1])]))
                held = [batch.slice(cuts[-1])]
            else:
                held.append(batch)
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def with_visitors(events: DataFrame) -> DataFrame:
    """(id, us, event_type, visitor_id) as stored. A paper_click without visitor gets that of the search it names (the least, if
    rows of that search differ); events then without visitor, id or time are left out."""
    timed = events.filter("id is not null and occurred_at is not null")
    row = [F.col("id").cast("bigint").alias("id"), micros("occurred_at").alias("us"), "event_type"]
    known = timed.filter("visitor_id is not null").select(*row, "visitor_id")
    orphans = timed.filter("visitor_id is null and event_type = 'paper_click' and related_search_event_id is not null").select(*row, F.col("related_search_event_id").cast("bigint").alias("search_id"))
    searches = timed.filter("event_type = 'search' and visitor_id is not null").select(F.col("id").cast("bigint").alias("search_id"), "visitor_id").groupBy("search_id").agg(F.min("visitor_id").alias("visitor_id"))
    return known.unionByName(orphans.join(searches, "search_id").drop("search_id"))


def sessions(events: DataFrame, gap_seconds: int = 1800, chunk_seconds: int = 86_400) -> DataFrame:
    """Sessions of each visitor_id: (visitor_id, session_no, start_at, end_at, duration_s, first_event_id, last_event_id,
    n_events, n_page_view, n_search, n_paper_click).

    Events are taken as with_visitors() says, redelivered ones (equal in id, time, type and visitor) once, and ordered by (occurred_at, id); a pause of more than gap_seconds starts a
    new session. Events at the same time count in the order of their ids; other event types count in n_events alone; an empty visitor_id is a
    visitor like any other; no events give no sessions; further columns are ignored."""
    if gap_seconds < 1 or chunk_seconds < 1:
        raise ValueError("gap_seconds and chunk_seconds must be at least 1")
    owned = with_visitors(events)
    second = F.floor(F.col("us") / 1_000_000).cast("bigint")
    point = F.struct("us", "id")
    kinds = [F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in ("page_view", "search", "paper_click")]
    # the one shuffle of single events; it spreads a busy visitor over all tasks, and both aggregations keep to it
    once = owned.withColumn("second", second).repartition("visitor_id", "second").dropDuplicates(["visitor_id", "second", "us", "id", "event_type"])
    ticks = once.groupBy("visitor_id", "second").agg(F.min(point).alias("low"), F.max(point).alias("high"), F.count(F.lit(1)).alias("n_events"), *kinds)
    chunked = ticks.select("visitor_id", F.floor(F.col("second") / chunk_seconds).cast("bigint").alias("chunk"), F.pmod("second", F.lit(chunk_seconds)).cast("bigint").alias("tick"), F.col("low.us").alias("low_us"), F.col("low.id").alias("low_id"), F.col("high.us").alias("high_us"), F.col("high.id").alias("high_id"), *FIELDS[7:])
    runs = chunked.repartition("visitor_id", "chunk").sortWithinPartitions("visitor_id", "chunk", "tick").mapInArrow(chunk_runs(gap_seconds), RUNS)
    order = Window.partitionBy("visitor_id").orderBy("start_us")
    opens = F.coalesce((F.col("start_us") - F.lag("end_us").over(order) > gap_seconds * 1_000_000).cast("bigint"), F.lit(1))
    numbered = runs.withColumn("opens", opens).withColumn("session_no", F.sum("opens").over(order))
    merged = numbered.groupBy("visitor_id", "session_no").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min_by("first_event_id", "start_us").alias("first_event_id"), F.max_by("last_event_id", "end_us").alias("last_event_id"), *[F.sum(c).cast("bigint").alias(c) for c in FIELDS[7:]]
    )
    return merged.select("visitor_id", "session_no", from_micros(F.col("start_us")).alias("start_at"), from_micros(F.col("end_us")).alias("end_at"), ((F.col("end_us") - F.col("start_us")) / 1_000_000).alias("duration_s"), "first_event_id", "last_event_id", *FIELDS[7:])
