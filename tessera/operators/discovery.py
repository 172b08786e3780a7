"""Minimal keys and functional dependencies by counter-examples from samples, with exact counts for what survives them.

Two rows that agree on some columns and differ in others refute every dependency whose left side they agree on and
whose right side they differ in. Rows that share values are sampled (a bounded number for each column), and their agree sets
give, for each right side, the sets of columns of which a left side must have one each. The smallest left sides that do are
the candidates; only these are counted over all rows. What the counts refute gives new counter-examples, taken from the
whole table, until all candidates hold. A sample only saves work: the result is that of counting every column set.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.dependencies import complete, distinct_counts

NO_RIGHT = -1  # the right side of a key


@dataclass(frozen=True)
class Policy:
    """Bounds of a search; what they cut off is told as a reason. Sample: rows in all; near: sampled rows that each is compared with; examples: refuted candidates a round for which rows are fetched."""

    columns: int = 64
    arity: int = 3
    sets: int = 20_000
    found: int = 500
    seconds: float | None = None
    sample: int = 5_000
    near: int = 4
    examples: int = 64


@dataclass(frozen=True)
class Discovery:
    """found: (lhs, rhs) or (columns); counted: column sets counted over all rows, of `lattice` that there are."""

    found: DataFrame
    counted: int
    lattice: int
    agree_sets: int
    rounds: int
    truncated: tuple[str, ...]

    @property
    def state(self) -> str:
        return "PARTIAL" if self.truncated else "COMPLETE"


def bits(columns: Iterable[int]) -> int:
    return sum(1 << c for c in columns)


def members(mask: int) -> tuple[int, ...]:
    return tuple(i for i in range(mask.bit_length()) if mask >> i & 1)


def sampled_cells(rows: DataFrame, policy: Policy) -> list[tuple[int, list[str | None]]]:
    """(column number, cells as texts) of rows that come in order of a hash of that column's value, so that equal values are neighbours."""
    names, total = rows.columns, rows.count()
    each = max(2, min(1000, policy.sample // max(1, len(names))))
    share = min(1.0, 8 * each / max(1, total))
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in names])
    spread = F.array(*[F.struct(F.lit(i).alias("tag"), F.xxhash64(F.lit(i), F.col(f"`{c}`").cast("string")).alias("h")) for i, c in enumerate(names)])
    wide = rows.select(cells.alias("cells"), F.explode(spread).alias("s")).select("cells", "s.tag", "s.h")
    # a share of the values, and so of the rows; few values may all be outside, then other columns' rows do
    wide = wide.where(F.lit(share >= 1) | (F.col("h").cast("double") < (share - 0.5) * 2.0**64))
    place = F.row_number().over(Window.partitionBy("tag").orderBy("h", F.xxhash64("cells")))
    found = wide.withColumn("place", place).where(F.col("place") <= each).select("tag", "place", "cells").collect()
    return [(r.tag, r.cells) for r in sorted(found, key=lambda r: (r.tag, r.place))]


def agree_masks(cells: list[list[str | None]], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The columns on which the two rows of each pair agree, as bits."""
    out = np.zeros(len(pairs[0]), np.uint64)
    for i in range(len(cells[0]) if cells else 0):
        codes: dict[str | None, int] = {}
        column = np.array([codes.setdefault(row[i], len(codes)) for row in cells], np.int64)
        out |= (column[pairs[0]] == column[pairs[1]]).astype(np.uint64) << np.uint64(i)
    return np.unique(out)


def sampled_agree_sets(rows: DataFrame, policy: Policy) -> np.ndarray:
    found = sampled_cells(rows, policy)
    cells, tags = [c for _, c in found], np.array([t for t, _ in found], np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, policy.near + 1):
        at = np.arange(max(0, len(tags) - step))
        at = at[tags[at] == tags[at + step]]
        left.append(at)
        right.append(at + step)
    everything = np.uint64(bits(range(len(rows.columns))))
    masks = agree_masks(cells, (np.concatenate(left), np.concatenate(right)))
    return masks[masks != everything]


def smallest_only(masks: np.ndarray) -> np.ndarray:
    """The masks that have no other as a part, the smallest first."""
    masks = np.unique(masks)
    masks = masks[np.argsort(np.bitwise_count(masks), kind="stable")]
    kept: list[np.ndarray] = []
    while len(masks):
        first, masks = masks[0], masks[1:]
        kept.append(first)
        masks = masks[(masks & first) != first]
    return np.array(kept, np.uint64)


def hitting_sets(must: np.ndarray, columns: list[int], arity: int) -> list[int]:
    """The smallest sets of at most `arity` columns that have a column of each of the given sets."""
    must = smallest_only(must)
    if len(must) and must[0] == 0:
        return []
    done: list[int] = []
    open_sets, last = np.zeros(1, np.uint64), np.full(1, -1)
    for _ in range(arity):
        grown, ends = [], []
        for c in columns:
            base = open_sets[last < c]
            grown.append(base | np.uint64(1 << c))
            ends.append(np.full(len(base), c))
        masks, last = np.concatenate(grown), np.concatenate(ends)
        for small in done:
            keep = (masks & np.uint64(small)) != np.uint64(small)
            masks, last = masks[keep], last[keep]
        hit = np.ones(len(masks), bool)
        for m in must:
            hit &= (masks & m) != 0
        done += [int(m) for m in masks[hit]]
        open_sets, last = masks[~hit], last[~hit]
    return done


def counter_examples(rows: DataFrame, refuted: list[tuple[int, int]], total: int, looked: int = 4_000_000) -> np.ndarray:
    """Agree sets of two rows each that agree on a left side and differ on the right one (or anywhere, for a key).

    Left values are looked through by hash, of about `looked` rows for each left side, until one stands with several right
    values; only that one's rows are fetched. A missed or false example does no harm: an agree set is told by the two rows' cells.
    """
    names = rows.columns
    texts = [F.col(f"`{c}`").cast("string") for c in names]

    def hashed(columns: Iterable[int]):
        return F.xxhash64(*[x for c in columns for x in (texts[c], texts[c].isNull())])

    share = math.ceil(max(1, total) / looked)
    rights: dict[int, list[int]] = {}
    for left, right in refuted:
        rights.setdefault(left, []).append(right)
    found = []
    for left, own in rights.items():
        part = rows.select(hashed(members(left)).alias("k"), *[hashed(range(len(names)) if a == NO_RIGHT else (a,)).alias(f"h{i}") for i, a in enumerate(own)]).where(F.pmod("k", F.lit(share)) == 0)
        ends = part.groupBy("k").agg(*[f(f"h{i}").alias(f"{n}{i}") for i in range(len(own)) for f, n in ((F.min, "a"), (F.max, "b"))])
        one = ends.agg(*[F.min(F.when(F.col(f"a{i}") != F.col(f"b{i}"), F.col("k"))).alias(f"k{i}") for i in range(len(own))])
        found.append(one.select(F.explode(F.array(*[F.struct(F.lit(left).cast("string").alias("l"), F.lit(a).alias("r"), F.col(f"k{i}").alias("k")) for i, a in enumerate(own)])).alias("c")).select("c.*").where("k IS NOT NULL"))
    keys = [(int(r.l), r.r, r.k) for r in reduce(DataFrame.unionByName, found).collect()] if found else []
    if not keys:
        return np.zeros(0, np.uint64)
    cases = F.array(*[F.when(hashed(members(left)) == k, F.struct(F.lit(i).alias("i"), hashed(range(len(names)) if a == NO_RIGHT else (a,)).alias("h"))) for i, (left, a, k) in enumerate(keys)])
    few = rows.select(F.array(*texts).alias("cells"), F.explode(F.array_compact(cases)).alias("s")).select("cells", "s.*")
    pairs = few.groupBy("i").agg(F.min(F.struct("h", "cells")).alias("a"), F.max(F.struct("h", "cells")).alias("b")).collect()
    both = [x for r in pairs for x in (r.a.cells, r.b.cells)]
    at = np.arange(0, len(both), 2)
    return agree_masks(both, (at, at + 1))


def _search(rows: DataFrame, rights: list[int], policy: Policy) -> tuple[dict[int, set[int]], dict]:
    """Smallest left sides for each right side that hold over all rows."""
    names, began, reasons = rows.columns, time.monotonic(), []
    everything = bits(range(len(names)))
    total = rows.count()
    agree = sampled_agree_sets(rows, policy) if total > 1 else np.zeros(0, np.uint64)
    weak: dict[int, list[int]] = {a: [] for a in rights}  # refuted left sides, of whose counter-examples only these columns are known
    holds: dict[int, set[int]] = {a: set() for a in rights}
    counts: dict[int, int] = {}
    rounds, closed = 0, policy.arity + 1
    while True:
        fresh: list[tuple[int, int]] = []
        for a in rights:
            out = everything & ~(0 if a == NO_RIGHT else 1 << a)
            apart = agree if a == NO_RIGHT else agree[(agree >> np.uint64(a)) & np.uint64(1) == 0]
            must = np.concatenate([~apart & np.uint64(out), np.array([out & ~x for x in weak[a]], np.uint64)])
            fresh += [(x, a) for x in hitting_sets(must, list(members(out)), policy.arity) if x not in holds[a] and x.bit_count() < closed]
        if not fresh:
            break
        if policy.seconds is not None and time.monotonic() - began > policy.seconds:
            reasons.append(f"MAX_SECONDS: over {policy.seconds} with {len(fresh)} candidates left")
            break
        # the fewest columns first, so that a search cut short has whole levels
        width = min(x.bit_count() for x, _ in fresh)
        fresh = [(x, a) for x, a in fresh if x.bit_count() == width]
        wanted = sorted({s for x, a in fresh for s in ((x,) if a == NO_RIGHT else (x, x | 1 << a))} - set(counts))
        if len(counts) + len(wanted) > policy.sets:
            reasons.append(f"MAX_SETS: {len(counts) + len(wanted)} > {policy.sets} at {width} columns")
            closed = width
            continue
        rounds += 1
        told = distinct_counts(rows, [tuple(names[c] for c in members(s)) for s in wanted])
        counts |= {s: told[tuple(names[c] for c in members(s))] for s in wanted}
        refuted = []
        for x, a in fresh:
            if counts[x] == (total if a == NO_RIGHT else counts[x | 1 << a]):
                holds[a].add(x)
            else:
                weak[a].append(x)
                refuted.append((x, a))
        if refuted:
            agree = np.unique(np.concatenate([agree, counter_examples(rows, refuted[: policy.examples], total)]))
            agree = agree[agree != np.uint64(everything)]
    lattice = sum(math.comb(len(names), k) for k in range(1, policy.arity + (NO_RIGHT not in rights) + 1))
    return holds, {"counted": len(counts), "lattice": lattice, "agree_sets": len(agree), "rounds": rounds, "truncated": reasons}


def _prepared(rows: DataFrame, columns: list[str] | None, policy: Policy, nulls: str) -> tuple[DataFrame, list[str]]:
    names, reasons = list(columns or rows.columns), []
    most = min(policy.columns, 64)  # agree sets are words of 64 bits
    if len(names) > most:
        reasons.append(f"MAX_COLUMNS: {len(names)} > {most}")
        names = names[:most]
    return complete(rows.select(*[F.col(f"`{c}`") for c in names]), nulls), reasons


def _kept(found: list[tuple], reasons: list[str], policy: Policy) -> list[tuple]:
    if len(found) > policy.found:
        reasons.append(f"MAX_FOUND: {len(found)} > {policy.found}")
    return found[: policy.found]


def discover_dependencies(rows: DataFrame, columns: list[str] | None = None, policy: Policy = Policy(), nulls: str = "EXCLUDE") -> Discovery:
    """All minimal dependencies (lhs, rhs) with at most `arity` columns on the left, over all rows under the null policy."""
    eligible, reasons = _prepared(rows, columns, policy, nulls)
    eligible.persist()
    names = eligible.columns
    holds, told = _search(eligible, list(range(len(names))), policy)
    eligible.unpersist()
    found = sorted((x.bit_count(), members(x), a) for a, left in holds.items() for x in left)
    reasons += told.pop("truncated")
    out = _kept([(",".join(names[c] for c in x), names[a]) for _, x, a in found], reasons, policy)
    return Discovery(rows.sparkSession.createDataFrame(out, "lhs string, rhs string"), truncated=tuple(reasons), **told)


def discover_keys(rows: DataFrame, columns: list[str] | None = None, policy: Policy = Policy(), nulls: str = "EXCLUDE") -> Discovery:
    """All minimal unique combinations (columns, eligible) of at most `arity` columns."""
    eligible, reasons = _prepared(rows, columns, policy, nulls)
    eligible.persist()
    names, total = eligible.columns, eligible.count()
    holds, told = _search(eligible, [NO_RIGHT], policy) if total else ({NO_RIGHT: set()}, {"counted": 0, "lattice": 0, "agree_sets": 0, "rounds": 0, "truncated": []})
    eligible.unpersist()
    found = sorted((x.bit_count(), members(x)) for x in holds[NO_RIGHT])
    reasons += told.pop("truncated")
    out = _kept([(",".join(names[c] for c in x), total) for _, x in found], reasons, policy)
    return Discovery(rows.sparkSession.createDataFrame(out, "columns string, eligible long"), truncated=tuple(reasons), **told)
