"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mixture belongs to the source in whose interval of the cumulated weights the fractional part of i times
the golden ratio falls, so every stretch of slots has the sources in nearly their shares. The documents of a source are
shuffled and their tokens numbered through; block b holds the documents that begin in its tokens. The k-th slot of a
source takes block k; past the last block the source begins again, at most max_repeats times.

Both numberings, of slots and of tokens in a source, are scans spread over many tasks: a source may hold any share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.bpe import encode_column
from ocellus.operators.scan import grouped_scan
from ocellus.storage import cut_lineage

GOLDEN = 0.6180339887498949
MAX_SOURCES = 10_000


@dataclass
class Quota:
    source: str
    share: float
    max_repeats: int
    available: int
    tokens: float = 0.0


def fill(quotas: list[Quota], total: float | None) -> float:
    """Sets tokens of each quota and returns the total. Without a total: the largest for which every source meets its share, which a single scarce
    source makes small. With one: sources that can't meet theirs give all they may, and the others share what is missing in proportion to their targets."""
    whole = sum(q.share for q in quotas)
    if not whole:
        return 0.0
    for q in quotas:
        q.tokens = 0.0
    most = {id(q): float(q.available * q.max_repeats) for q in quotas}
    if total is None:
        total = min((most[id(q)] * whole / q.share for q in quotas if q.share > 0 and q.available), default=0.0)
    open_, left = [q for q in quotas if q.share > 0 and most[id(q)] > 0], total
    while open_:
        weight = sum(q.share for q in open_)
        full = [q for q in open_ if most[id(q)] < left * q.share / weight * (1 - 1e-12)]
        if not full:
            for q in open_:
                q.tokens = left * q.share / weight
            break
        for q in full:
            q.tokens = most[id(q)]
            left -= q.tokens
            open_.remove(q)
    return sum(q.tokens for q in quotas)


def slots_of(quotas: list[Quota], block_tokens: int) -> list[float]:
    """Slots of each quota. A source that gives all it may gets some more than its blocks, as the golden ratio meets a share only within the logarithm
    of the slots; those beyond its repeats stay empty."""
    margin = 3 + math.log(1 + sum(q.tokens for q in quotas) / block_tokens)
    return [-(-q.available // block_tokens) * q.max_repeats + margin if q.tokens and q.tokens >= q.available * q.max_repeats * (1 - 1e-9) else q.tokens / block_tokens for q in quotas]


def quotas_of(sized: DataFrame, targets: DataFrame) -> list[Quota]:
    """One per source of targets; several rows of a source add their shares and take the largest max_repeats."""
    wanted = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    if (n := wanted.count()) > MAX_SOURCES:
        raise ValueError(f"{n} sources have targets; {MAX_SOURCES} are the most")
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    rows = wanted.join(sizes, "source", "left").collect()  # one row per target, at most MAX_SOURCES
    return sorted((Quota(r.source, float(r.share), max(int(r.max_repeats), 0), int(r.available or 0)) for r in rows), key=lambda q: q.source)


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, block_tokens: int = 512, seed: int = 17, vocabulary: str | None = None, passes: float | None = None) -> DataFrame:
    """(slot, source, doc_id, repeat, n_tokens): the documents of the mixture in its order. repeat counts from 1; no document comes more often
    than its source's max_repeats. passes sizes the mixture by the corpus, as a multiple of the tokens of all sources that have a target: with 1 it is
    as large as they are together, whichever of them is scarce. total_tokens gives the size itself; without either every target is met in full.

    Sizes are tokens of the vocabulary. Null and empty texts have none and are left out, as are null sources and those without target. A
    source with a target but no tokens gets nothing, and the others keep their proportions. Repeated rows count each. Empty tables give
    no rows; further columns are ignored."""
    spark = documents.sparkSession
    own = documents.select("doc_id", "source", "text").join(F.broadcast(targets.select("source").distinct().limit(MAX_SOURCES + 1)), "source", "left_semi")
    sized = cut_lineage(encode_column(own, ["doc_id", "source"], "text", vocabulary, mode="count").filter("n_tokens > 0"))
    quotas = [q for q in quotas_of(sized, targets) if q.available]
    if passes is not None:
        total_tokens = passes * sum(q.available for q in quotas if q.max_repeats)
    fill(quotas, total_tokens)
    slots_each = slots_of(quotas, block_tokens)
    all_slots = sum(slots_each)
    n_slots = math.ceil(all_slots)
    shuffled = grouped_scan(sized.withColumn("__at", F.xxhash64(F.lit(seed), "doc_id")), ["source"], [F.col("__at"), F.col("doc_id")], value="n_tokens", row="__no", before="__before")
    bounds, at = [], 0.0
    for n in slots_each:
        at += n / all_slots if all_slots else 0
        bounds.append(at)
    edges = np.array(bounds[:-1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point = np.mod((batch.column(0).to_numpy() + 0.5) * GOLDEN, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(edges, point, side="right").astype(np.int32))], names=["slot", "source_no"])

    meta = spark.createDataFrame([(i, q.source, -(-q.available // block_tokens), q.max_repeats) for i, q in enumerate(quotas)], "source_no int, source string, blocks bigint, max_repeats bigint")
    slots = spark.range(n_slots).mapInArrow(place, "slot bigint, source_no int")
    ranked = grouped_scan(slots, ["source_no"], [F.col("slot")], row="k").join(F.broadcast(meta), "source_no")
    plan = ranked.select("slot", "source", F.pmod(F.col("k") - 1, "blocks").alias("block"), (F.floor((F.col("k") - 1) / F.col("blocks")) + 1).cast("bigint").alias("repeat"), "max_repeats").filter("repeat <= max_repeats")
    blocks = shuffled.select("source", F.floor(F.col("__before") / block_tokens).cast("bigint").alias("block"), "doc_id", "n_tokens")
    return plan.join(blocks, ["source", "block"]).select("slot", "source", "doc_id", "repeat", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, n_documents, most_repeats, missing_tokens) of each source with a target; missing_tokens is what the
    source lacks of its share of the mixture."""
    wanted = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    have = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("repeat").alias("most_repeats"))
    whole = have.agg(F.sum("tokens").alias("whole"))
    targeted = wanted.agg(F.sum("target_share").alias("targeted"))
    joined = wanted.join(have, "source", "left").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(targeted))  # one row each
    missing = F.greatest(F.col("target_share") / F.col("targeted") * F.coalesce("whole", F.lit(0)) - F.coalesce("tokens", F.lit(0)), F.lit(0.0))
    return joined.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(missing).cast("bigint").alias("missing_tokens"))
