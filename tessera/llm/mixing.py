"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are numbered and cut into blocks of equal size. Each source is owed its weight's share of the
slots until its blocks end; from then on the others share what it had. With G(v) for the slots that are owed in all
once a source of weight w is owed v * w blocks, block j is released at slot floor(G(j / w)) and wanted by slot
ceil(G((j + 1) / w)); while no source ends, that is floor(j / w) and ceil((j + 1) / w) with weights that sum to 1. Each
slot goes to the released block with the earliest deadline. A source's blocks then never differ from what it is owed by
one block or more. All of this is in whole numbers, so weights hold as they are given, over any number of slots.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, pinned, shuffle_width

BLOCK_ROWS = 64
POWER = 0.5  # default target weight: the source's row count to this power
SMALL_PLAN = 250_000  # blocks of a plan that is broadcast
BUCKET_ROWS = 1024  # documents that are numbered in one window, or a MAX_BUCKETS-th of a source
MAX_BUCKETS = 100_000


def whole_shares(weights: dict[str, float], resolution: int) -> dict[str, int]:
    """Weights as whole slots of a period, by largest remainders; each source gets a slot at least, taken from the largest shares."""
    total = sum(map(exact, weights.values()))
    resolution = max(resolution, len(weights))
    wanted = {s: exact(w) / total * resolution for s, w in weights.items()}
    shares = {s: max(1, int(x)) for s, x in wanted.items()}
    short = resolution - sum(shares.values())
    for s in sorted(weights, key=lambda s: (shares[s] - wanted[s], s))[: max(short, 0)]:
        shares[s] += 1
    for _ in range(-short):
        shares[max(shares, key=lambda s: (shares[s], s))] -= 1
    return shares


def exact(weight: float) -> Fraction:
    """The number as it is written: 0.1 is a tenth."""
    return Fraction(repr(float(weight)))


class Plan:
    """Slots of all blocks: `slots` by source, in the order of its blocks; `ends`, the slots at which sources are done being served."""

    def __init__(self, blocks: dict[str, int], weights: dict[str, float | Fraction]):
        given = {s: w if isinstance(w, Fraction) else exact(w) for s, w in weights.items() if blocks.get(s)}
        scale = math.lcm(*[w.denominator for w in given.values()]) if given else 1
        self.blocks = {s: blocks[s] for s in given}
        self.weights = weight = {s: w.numerator * (scale // w.denominator) for s, w in given.items()}
        # pieces of G: up to the next source's end, ended + rest * v slots are owed
        order = sorted(given, key=lambda s: (Fraction(blocks[s], weight[s]), s))
        self.ends_v = [(blocks[s], weight[s]) for s in order]
        self.float_v = [n / w for n, w in self.ends_v]
        self.ended, self.rest = [0], [sum(weight.values())]
        for s in order:
            self.ended.append(self.ended[-1] + blocks[s])
            self.rest.append(self.rest[-1] - weight[s])
        self.ends = [float(Fraction(self.ended[k] * w + self.rest[k] * n, w)) for k, (n, w) in enumerate(self.ends_v)]
        self.slots = self._placed()

    def owed_at(self, j: int, w: int) -> tuple[int, int]:
        """G(j / w), as a fraction."""
        k = min(bisect_left(self.float_v, j / w), len(self.ends_v) - 1)
        while k and j * self.ends_v[k - 1][1] <= self.ends_v[k - 1][0] * w:
            k -= 1
        while k + 1 < len(self.ends_v) and j * self.ends_v[k][1] > self.ends_v[k][0] * w:
            k += 1
        return self.ended[k] * w + self.rest[k] * j, w

    def _placed(self) -> dict[str, list[int]]:
        slots: dict[str, list[int]] = {s: [] for s in self.blocks}
        waiting = [(0, s, 0, 0) for s in sorted(self.blocks)]  # release, source, block
        ready: list[tuple[int, str, int, int]] = []  # deadline, source, block, the next block's release
        for slot in range(sum(self.blocks.values())):
            while waiting and waiting[0][0] <= slot:
                _, s, j, _ = heapq.heappop(waiting)
                a, w = self.owed_at(j + 1, self.weights[s])
                heapq.heappush(ready, (-(-a // w), s, j, a // w))
            _, s, j, release = heapq.heappop(ready)
            slots[s].append(slot)
            if j + 1 < self.blocks[s]:
                heapq.heappush(waiting, (release, s, j + 1, 0))
        return slots

    def table(self) -> pa.Table:
        """(source, block, slot, phase, deviation): phase counts the sources that have ended, deviation is from what the source is owed."""
        if not self.blocks:
            return pa.table({"_source": pa.array([], pa.string()), "_block": pa.array([], pa.int64()), "slot": pa.array([], pa.int64()), "phase": pa.array([], pa.int32()), "deviation": pa.array([], pa.float64())})
        counts = [self.blocks[s] for s in self.slots]
        slot = np.concatenate([np.array(x, np.int64) for x in self.slots.values()])
        block = np.concatenate([np.arange(n) for n in counts])
        ends = np.array(self.ends)
        phase = np.searchsorted(ends, slot + 1e-9, side="right").clip(0, len(ends) - 1)
        # what is owed when the block's slot is over
        piece = np.searchsorted(ends, slot + 1, side="left").clip(0, len(ends) - 1)
        top = self.rest[0]
        share = np.array([x / top for x in self.rest])
        v = (slot + 1 - np.array(self.ended)[piece]) / share[piece]
        weight = np.repeat([self.weights[s] / top for s in self.slots], counts)
        owed = np.minimum(v * weight, np.repeat(counts, counts))
        names = pa.array(np.repeat(np.array(list(self.slots), object), counts), pa.string())
        return pa.table({"_source": names, "_block": block, "slot": slot, "phase": phase.astype(np.int32), "deviation": block + 1 - owed})


def period(shares: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of whole shares."""
    return Plan(shares, shares).slots


def numbered(rows: DataFrame, source: str, order: str, counts: dict[str, int], bucket_rows: int) -> DataFrame:
    """rows with `_n`, from 0 on within each source, in the order of the hash `order`.

    Sources are cut into ranges of the hash with about bucket_rows rows, so that no task numbers a whole source.
    """
    table = pa.table({source: pa.array(list(counts), pa.string()), "_buckets": pa.array([-(-n // max(bucket_rows, n // MAX_BUCKETS)) for n in counts.values()], pa.int64())})
    # the hash's upper 31 bits, spread over the source's buckets in order
    upper = F.shiftrightunsigned(F.col(order), 33)
    named = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table)), source)
    placed = named.withColumn("_bucket", F.shiftright(upper * F.col("_buckets"), 31).cast("int")).drop("_buckets")
    sizes = placed.groupBy(source, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(source).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(source, "_bucket").orderBy(F.shiftrightunsigned(F.col(order), 1), F.col(order), "_tie")
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, [source, "_bucket"]).withColumn("_n", F.col("_start") + F.col("_rank")).drop("_start", "_rank", "_bucket")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    resolution: int | None = None,
    seed: int = 7,
    bucket_rows: int = BUCKET_ROWS,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, block, slot, position, phase, deviation) for each row.

    position numbers all rows in the mixed order, by slot and then by place in the block, without gaps inside a block.
    phase counts the sources that have ended. deviation is how far the source is from what its target weight owes it once
    the block is placed, in blocks. Null sources are one source, named ''. Null and repeated ids are rows like others.
    Weights name a target for sources; others, and all by default, get their row count to the power 0.5. They hold
    exactly; a caller who gives a resolution gets them rounded to that many parts first. The driver plans with a number
    for each source and each block. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    # rows without an id are the same to each other, so any order of theirs is; one hash would bring them to one task
    lone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("_hash", F.xxhash64("doc_id", lone, F.lit(seed))).withColumn("_tie", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # counts are taken from a pinned table of ids and sources, so that they can't differ from what is numbered
    rows = pinned(rows.repartition(shuffle_width(docs.sparkSession), "_hash"))
    counts = {r.source: r["count"] for r in rows.groupBy("source").count().toLocalIterator()}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    target = {s: float((weights or {}).get(s, n**POWER)) for s, n in counts.items()}
    if any(w <= 0 for w in target.values()):
        raise ValueError("target weights are above zero")
    plan = Plan(blocks, target if resolution is None else whole_shares(target, resolution)).table()
    # a row for each block; other than by broadcast, a block's few rows meet in one task
    table = docs.sparkSession.createDataFrame(plan)
    done = numbered(rows, "source", "_hash", counts, bucket_rows).withColumn("block", F.floor(F.col("_n") / block_rows))
    joined = done.join(F.broadcast(table) if len(plan) <= SMALL_PLAN else table, (F.col("source") == F.col("_source")) & (F.col("block") == F.col("_block")))
    return joined.select(
        "doc_id",
        "source",
        F.col("block").cast("long").alias("block"),
        "slot",
        (F.col("slot") * block_rows + F.col("_n") % block_rows).cast("long").alias("position"),
        "phase",
        "deviation",
    )


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns and rows, range-partitioned and sorted by their position in the mix.

    A row is known by its id, source and text, so null and repeated ids have places of their own, and the same rows have
    the same places whenever they are mixed; equal rows share one.
    """
    if not docs.take(1):
        return docs
    owner, key, place = fresh(docs, "owner", "key", "position")
    keyed = docs.withColumn(owner, F.coalesce("source", F.lit(""))).withColumn(key, F.xxhash64("doc_id", owner, "text"))
    places = mix(keyed.select(key, owner).distinct(), id_col=key, source_col=owner, **options)
    places = places.select(F.col("doc_id").alias(key), F.col("source").alias(owner), F.col("position").alias(place))
    joined = keyed.join(places, [key, owner])
    ordered = joined.repartitionByRange(shuffle_width(docs.sparkSession), place).sortWithinPartitions(place)
    return ordered.select(*docs.columns)
