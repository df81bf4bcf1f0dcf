"""Running counts and sums within groups of any size.

A window over a group puts the whole group into one task. Here the rows are range partitioned by (group, order), so a
group that holds a third of all rows is spread over many tasks; each task scans its own slice and the slices' totals
shift the later ones. A partition boundary cuts at most one group, so at most one shift per partition is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.storage import cut_lineage


def differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where a and b differ; null equals null."""
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def group_starts(columns: list[pa.Array], last: list[pa.Array] | None) -> np.ndarray:
    """True for each row whose columns differ from those of the row before it; last is the row before the first."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[0] = last is None
    for i, c in enumerate(columns):
        if n > 1:
            new[1:] |= differs(c.slice(1), c.slice(0, n - 1))
        if last is not None:
            new[0] |= bool(differs(c.slice(0, 1), last[i])[0])
    return new


def grouped_scan(df: DataFrame, groups: list[str], orders: list[Column], value: str | None = None, row: str = "row_no", before: str = "before", partitions: int | None = None) -> DataFrame:
    """Adds `row`, the row's number from 1 in its group by `orders`, and with `value` also `before`, the sum of the
    value over the group's earlier rows (null counts 0). Null groups form one group. Ties keep some order; give `orders` a
    last unique column where that matters. An empty frame stays empty."""
    extra = [T.StructField("__part", T.IntegerType()), T.StructField(row, T.LongType())]
    if value is not None:
        extra.append(T.StructField(before, T.LongType()))
    schema = T.StructType([*df.schema.fields, *extra])
    keys = [F.col(g) for g in groups]
    shuffled = df.repartitionByRange(partitions, *keys, *orders) if partitions else df.repartitionByRange(*keys, *orders)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count, total = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(g) for g in groups]
            new = group_starts(columns, last)
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, at, -1))
            rows = at - begin + 1
            rows[begin < 0] = at[begin < 0] + 1 + count
            out = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(rows)]
            count = int(rows[-1])
            if value is not None:
                v = pc.fill_null(batch.column(value), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                sums = np.cumsum(v) - v
                base = np.where(begin >= 0, sums[np.maximum(begin, 0)], -total)
                own = sums - base
                out.append(pa.array(own))
                total = int(own[-1] + v[-1])
            last = [c.slice(n - 1, 1) for c in columns]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    local = cut_lineage(shuffled.sortWithinPartitions(*keys, *orders).mapInArrow(scan, schema))
    totals = [F.max(row).alias("__rows")] + ([F.sum(F.coalesce(F.col(value), F.lit(0))).cast("bigint").alias("__sum")] if value is not None else [])
    slices = local.groupBy("__part", *groups).agg(*totals)
    from pyspark.sql import Window

    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row per partition
    shifts = slices.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__shift"), *([F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__shift_sum")] if value is not None else [])).filter("__shift > 0")
    on = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = local.join(F.broadcast(shifts), on, "left")
    kept = [F.col(f.name) for f in df.schema.fields]
    columns = [*kept, (F.col(row) + F.coalesce("__shift", F.lit(0))).alias(row)]
    if value is not None:
        columns.append((F.col(before) + F.coalesce("__shift_sum", F.lit(0))).alias(before))
    return joined.select(*columns)
