"""Most similar vectors by a block matrix join.

The distinct vectors are dealt into groups of bounded size; every pair of groups is one task. There, tiles of int8
codes are multiplied (each product an exact integer, scaled afterwards), and the quantisation errors of the two vectors bound how far the
true cosine can lie from the scaled product. Pairs that may reach the threshold, or a row's k best so far, are recomputed in
double precision from the original floats and kept in heaps of size k. Nothing is lost to the quantisation: results are those of brute force.

Exact copies are one vector in the join: a group of copies costs as much as a single vector, and its members share one
list of k + 1 neighbours, which always leaves k for each member.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.storage import cut_lineage

TILE = 2048
GROUP = 16_384  # vectors in a group at most, on average; a task holds two groups


def usable(df: DataFrame, provider: str, model: str) -> DataFrame:
    """(paper_id, dimensions, blob) of vectors that can be compared: little-endian float32, exactly `dimensions` values, all finite, not
    all zero. Of several rows of a paper and dimension the one last updated counts (null times first, then the greater blob)."""
    rows = df.filter((F.col("provider") == provider) & (F.col("model") == model) & (F.length("embedding_blob") == F.col("dimensions") * 4) & (F.col("dimensions") > 0) & F.col("paper_id").isNotNull())
    last = rows.groupBy("paper_id", "dimensions").agg(F.max(F.struct("updated_at", "embedding_blob")).alias("x")).select("paper_id", "dimensions", F.col("x.embedding_blob").alias("blob"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, b in enumerate(batch.column(2)):
                v = np.frombuffer(b.as_buffer(), "<f4")
                good[i] = np.isfinite(v).all() and v.any()
            yield batch.filter(pa.array(good))

    return last.mapInArrow(check, last.schema)


class Side:
    """Vectors of a group with their int8 codes, and the least similarity that counts for each. A vector is scale * code + rest, with |rest| = error."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, least: np.ndarray | float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.raw, self.least = ids[order], raw[order], np.broadcast_to(np.asarray(least, np.float64), len(ids))[order]
        wide = self.raw.astype(np.float64)
        wide /= np.abs(wide).max(axis=1, keepdims=True)  # before squaring: tiny and huge vectors keep their direction
        self.length = np.sqrt((wide * wide).sum(axis=1))
        unit = wide / self.length[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.code = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.code * self.scale[:, None]
        self.error = np.sqrt(((unit - near) ** 2).sum(axis=1))
        self.near = np.sqrt((near * near).sum(axis=1))
        self.unit = unit.astype(np.float32)

    def exact(self, mine: np.ndarray, other: Side, theirs: np.ndarray) -> np.ndarray:
        out = np.empty(len(mine))
        for a in range(0, len(mine), 65_536):
            x, y = self.raw[mine[a : a + 65_536]].astype(np.float64), other.raw[theirs[a : a + 65_536]].astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            y /= np.abs(y).max(axis=1, keepdims=True)
            out[a : a + 65_536] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        return out


class Best:
    """For each row a heap of its k best (similarity, -id)."""

    def __init__(self, k: int, least: np.ndarray):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in least]
        self.k, self.least = k, least.copy()

    def add(self, rows: np.ndarray, similarity: np.ndarray, ids: np.ndarray) -> None:
        k = self.k
        for r, s, i in zip(rows.tolist(), similarity.tolist(), (-ids).tolist(), strict=True):
            h = self.heaps[r]
            if len(h) < k:
                heapq.heappush(h, (s, i))
            elif (s, i) > h[0]:
                heapq.heapreplace(h, (s, i))
            if len(h) == k and h[0][0] > self.least[r]:
                self.least[r] = h[0][0]

    def rows(self, ids: np.ndarray) -> tuple[list, list, list]:
        flat = [(a, -i, s) for a, h in zip(ids.tolist(), self.heaps, strict=True) for s, i in h]
        return tuple(map(list, zip(*flat, strict=True))) if flat else ([], [], [])


SLACK = 1e-6  # beyond seven roundings to float32 (scales, products with them, room, its sum, the least) of values up to 2, each by 2 ** -24 of it at most
EXACT = 1024  # so many products of int8 codes add up to less than 2 ** 24, below which float32 holds every integer


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The integer products of all int8 rows of both sides, exact at any length: longer rows are added up in parts."""
    out = None
    for a in range(0, left.shape[1], EXACT):
        part = left[:, a : a + EXACT].astype(np.float32) @ right[:, a : a + EXACT].astype(np.float32).T
        out = part if out is None else np.add(out, part, dtype=np.float64)
    return out


def join_sides(left: Side, right: Side, k: int, same: bool) -> Iterator[tuple[list, list, list]]:
    """(id, other id, cosine): the k best of each vector of one side among the other's, with a cosine of at least the vector's least."""
    rows = Best(k, left.least)
    columns = rows if same else Best(k, right.least)
    for b in range(0, len(right.ids), TILE):
        e = min(b + TILE, len(right.ids))
        far, near = right.error[b:e].max(), right.near[b:e].max()
        across = right.scale[None, b:e].astype(np.float32)
        for a in range(0, e if same else len(left.ids), TILE):
            c = min(a + TILE, len(left.ids))
            value = products(left.code[a:c], right.code[b:e]).astype(np.float32)
            value *= left.scale[a:c, None].astype(np.float32)
            value *= across
            room = left.error[a:c] * near + far + SLACK
            value += room[:, None].astype(np.float32)  # from here on the upper bound of the cosine
            i, j = np.nonzero((value >= rows.least[a:c, None].astype(np.float32)) | (value >= columns.least[None, b:e].astype(np.float32)))
            if same and a + TILE > b:
                keep = i + a < j + b
                i, j = i[keep], j[keep]
            if len(i) > 16 * k * max(c - a, e - b):  # dense: a row's or column's k-th best lower bound rules out most
                if same and a + TILE > b:
                    off = np.arange(a, c)[:, None] >= np.arange(b, e)[None, :]
                    value[off] = -2
                low_row = np.partition(value, -k, axis=1)[:, -k] - 2 * room if value.shape[1] >= k else np.full(c - a, -2.0)
                low_column = np.partition(value, -k, axis=0)[-k] - 2 * room.max() if value.shape[0] >= k else np.full(e - b, -2.0)
                upper = value[i, j]
                keep = (upper >= np.maximum(low_row, rows.least[a:c])[i]) | (upper >= np.maximum(low_column, columns.least[b:e])[j])
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            i, j = i + a, j + b
            exact = left.exact(i, right, j)
            for best, mine, ids in ((rows, i, right.ids[j]), (columns, j, left.ids[i])):
                keep = exact >= best.least[mine]
                best.add(mine[keep], exact[keep], ids[keep])
    yield rows.rows(left.ids)
    if not same:
        yield columns.rows(right.ids)


CELL = "dimensions int, id bigint, other bigint, similarity double"


def nearest(vectors: DataFrame, k: int, least: float = -1.0, group: int = GROUP) -> DataFrame:
    """(dimensions, id, other, similarity): of each distinct vector the k most similar others with a cosine of at least `least`. vectors:
    (dimensions, id, blob), each blob and id once. Equal similarities are taken by the smaller id.

    Every group is joined with itself first. The k-th best that a vector has there is the least that counts for it in the pairs of groups, so these keep few candidates."""
    n = vectors.count()
    size = max(1024, min(group, n // 6))
    groups = max(1, -(-n // size))
    own = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    placed = vectors.withColumn("own", own)
    alone = placed.withColumn("low", F.col("own")).withColumn("high", F.col("own")).withColumn("least", F.lit(least))

    def cell(table: pa.Table) -> pa.Table:
        d = table.column("dimensions")[0].as_py()
        at, ids, floor = (table.column(c).to_numpy() for c in ("own", "id", "least"))
        raw = np.frombuffer(b"".join(table.column("blob").to_pylist()), "<f4").reshape(-1, d)
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left = Side(ids[at == low], raw[at == low], floor[at == low])
        right = left if low == high else Side(ids[at == high], raw[at == high], floor[at == high])
        out: tuple[list, list, list] = ([], [], [])
        if len(left.ids) and len(right.ids):
            for part in join_sides(left, right, k, low == high):
                for have, more in zip(out, part, strict=True):
                    have.extend(more)
        return pa.table([pa.array([d] * len(out[0]), pa.int32()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["dimensions", "id", "other", "similarity"])

    found = alone.groupBy("dimensions", "low", "high").applyInArrow(cell, CELL)
    if groups == 1:
        return found
    found = cut_lineage(found)
    reached = found.groupBy("dimensions", "id").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).alias("reached"))
    floors = placed.join(reached, ["dimensions", "id"], "left").withColumn("least", F.greatest(F.lit(least), "reached")).drop("reached")
    spread = floors.withColumn("other_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).filter("own <> other_group")
    cells = spread.withColumn("low", F.least("own", "other_group")).withColumn("high", F.greatest("own", "other_group")).drop("other_group")
    every = found.unionByName(cells.groupBy("dimensions", "low", "high").applyInArrow(cell, CELL))
    order = Window.partitionBy("dimensions", "id").orderBy(F.col("similarity").desc(), "other")  # at most k rows from each cell of the vector
    return every.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def similar_papers(df: DataFrame, provider: str = "api", model: str = "eye-embed-2", k: int = 10, least: float = -1.0, group: int = GROUP) -> DataFrame:
    """(paper_id, rank, neighbour_id, similarity): of each paper with a usable vector the k most similar papers, best first, those with a
    cosine of at least `least`. Equal similarities are ranked by neighbour_id; copies of a vector are neighbours with a cosine of 1.
    Vectors of different dimensions are never compared. An empty table gives no rows; further columns are ignored."""
    papers = cut_lineage(usable(df, provider, model))
    distinct = papers.groupBy("dimensions", "blob").agg(F.min("paper_id").alias("id"))
    joined = cut_lineage(nearest(distinct.select("dimensions", "id", "blob"), k, least, group))
    owned = papers.join(distinct, ["dimensions", "blob"]).select("dimensions", "id", "paper_id")
    first = Window.partitionBy("dimensions", "id").orderBy("paper_id")  # the limit on row_number is applied before the shuffle as well
    members = owned.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).drop("n")
    itself = distinct.select("dimensions", "id", F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    wide = joined.select("dimensions", "id", "other", "similarity").unionByName(itself)
    offered = wide.join(members.select("dimensions", F.col("id").alias("other"), "paper_id"), ["dimensions", "other"]).select("dimensions", "id", "similarity", "paper_id")
    best = Window.partitionBy("dimensions", "id").orderBy(F.col("similarity").desc(), "paper_id")
    lists = offered.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).groupBy("dimensions", "id").agg(F.sort_array(F.collect_list(F.struct("n", "paper_id", "similarity"))).alias("list"))
    shown = owned.join(lists, ["dimensions", "id"]).select("paper_id", F.slice(F.filter("list", lambda x: x["paper_id"] != F.col("paper_id")), 1, k).alias("list"))
    exploded = shown.select("paper_id", F.posexplode("list").alias("at", "x"))
    return exploded.select("paper_id", (F.col("at") + 1).alias("rank"), F.col("x.paper_id").alias("neighbour_id"), F.col("x.similarity").alias("similarity"))


def similar_pairs(df: DataFrame, least: float, **options) -> DataFrame:
    """(paper_id_a, paper_id_b, similarity), a < b: pairs with a cosine of at least `least` in which one is among the other's k most similar."""
    found = similar_papers(df, least=least, **options)
    return found.groupBy(F.least("paper_id", "neighbour_id").alias("paper_id_a"), F.greatest("paper_id", "neighbour_id").alias("paper_id_b")).agg(F.max("similarity").alias("similarity"))
