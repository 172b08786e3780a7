"""Probabilistic entity resolution: blocking, comparison levels, parameters by expectation-maximization, clusters."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import edits
from tessera.operators.graph import connected_components, joined_by_weight, settled

NEAR = 1 << 15  # records of a block whose texts meet in one task by what is left of them
GROUPS = 40  # of a key at most: 820 tiles, to which each record goes 41 times


@dataclass(frozen=True)
class Comparison:
    """How a field of two records is compared: exact, jaro_winkler or levenshtein, with levels from the strictest on."""

    field: str
    method: str = "exact"
    thresholds: tuple[float, ...] = ()
    term_frequency: bool = False  # equal rare values weigh more than equal common ones

    @property
    def levels(self) -> int:
        """The agreeing levels; level 0 is 'all else', and the highest is equality."""
        return 1 + len(self.limits)

    @property
    def limits(self) -> tuple[float, ...]:
        return self.thresholds or {"jaro_winkler": (0.95, 0.85), "levenshtein": (1, 2)}.get(self.method, ())


@dataclass(frozen=True)
class Spec:
    """mode: LINK_ONLY pairs records of different sources alone, DEDUPE_ONLY of one source, LINK_AND_DEDUPE all."""

    comparisons: tuple[Comparison, ...]
    blocking: tuple[tuple[str, ...], ...]
    mode: str = "LINK_ONLY"
    prior: float = 0.01
    iterations: int = 20
    strong: float = 0.95
    review: float = 0.80
    weight_gate: float | None = None
    independent: int = 2
    anchors: tuple[str, ...] = ()
    max_cluster: int = 50
    include_review: bool = False
    u_pairs: int = 50_000
    max_pairs: int = 10_000_000_000
    tile: int = 2_000  # records of a block that meet others in one tile
    seed: int = 11

    def __post_init__(self):
        if not self.blocking or any(not rule for rule in self.blocking):
            raise ValueError("UNSAFE_BLOCKING_RULE: each rule needs fields")


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points as rows of one width; what is beyond a text's end is never looked at."""
    width = max(width, 1)
    return np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width)


def jaro_winkler_batch(left: list[str], right: list[str], cells: int = 1 << 22) -> np.ndarray:
    """Similarity of pairs of texts by common characters near each other, raised for a common start of up to four.

    Pairs of alike lengths go together: one step for each character of the longest left text, over all pairs at once.
    """
    out = np.zeros(len(left))
    long, short = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    order = np.lexsort((short, long))
    begin = 0
    while begin < len(order):
        width = 8 + max(int(long[order[begin]]), 1)
        stop = begin + int(np.searchsorted(long[order[begin:]], width, side="right"))
        # as many pairs as fit, by the widest right text among them
        wide = np.maximum.accumulate(short[order[begin:stop]]) * np.arange(1, stop - begin + 1)
        stop = begin + max(1, int(np.searchsorted(wide, cells, side="right")))
        at = order[begin:stop]
        out[at] = _jaro_winkler_codes(_codes([left[i] for i in at], int(long[at].max())), _codes([right[i] for i in at], int(short[at].max())), long[at], short[at])
        begin = stop
    return out


def _jaro_winkler_codes(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n, places = len(a), np.arange(b.shape[1])
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free = places < lb[:, None]
    mine = np.zeros(a.shape, bool)
    rows = np.arange(n)
    for i in range(a.shape[1]):
        hit = (b == a[:, i, None]) & free & (np.abs(places - i) <= reach[:, None]) if b.shape[1] else np.zeros((n, 0), bool)
        some = hit.any(axis=1) & (i < la)
        if some.any():
            first = hit[some].argmax(axis=1)
            mine[some, i] = True
            free[rows[some], first] = False
    theirs = (places < lb[:, None]) & ~free
    m = mine.sum(axis=1)
    width = int(m.max(initial=0))
    one = np.take_along_axis(a, np.argsort(~mine, axis=1, kind="stable")[:, :width], axis=1)
    two = np.take_along_axis(b, np.argsort(~theirs, axis=1, kind="stable")[:, :width], axis=1)
    swaps = ((one != two) & (np.arange(width) < m[:, None])).sum(axis=1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        base = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3, 0.0)
    reachable = min(4, a.shape[1], b.shape[1])
    same = (a[:, :reachable] == b[:, :reachable]) & (np.arange(reachable) < np.minimum(la, lb)[:, None])
    start = np.cumprod(same, axis=1).sum(axis=1) if reachable else np.zeros(n)
    out = base + start * 0.1 * (1 - base)
    return np.where((la == 0) & (lb == 0), 1.0, np.where(m > 0, out, 0.0))


def jaro_winkler(a: str, b: str) -> float:
    return float(jaro_winkler_batch([a], [b])[0])


def _jaro_winkler_series(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each distinct pair of values of a batch is compared once; a missing side gives none."""
    pairs = pd.DataFrame({"a": a.to_numpy(), "b": b.to_numpy()}).dropna()
    kinds = pairs.drop_duplicates()
    kinds = kinds.assign(s=jaro_winkler_batch(kinds["a"].tolist(), kinds["b"].tolist()))
    return pd.Series(np.arange(len(a))).map(pairs.reset_index().merge(kinds, on=["a", "b"]).set_index("index")["s"]).astype("float64")


def jaro_winkler_of(a: Column, b: Column) -> Column:
    """Similarity of two texts that differ; equal ones, told without Python, give null."""
    return F.pandas_udf(_jaro_winkler_series, "double")(F.when(a != b, a), b)


def load(records: DataFrame, ref: str = "record_ref") -> DataFrame:
    """records, once for each reference. One reference with several contents is an error; so is none."""
    once = settled(records.distinct())
    if once.where(F.col(ref).isNull()).take(1):
        raise ValueError("RECORD_WITHOUT_REFERENCE")
    several = once.groupBy(ref).count().where("count > 1").select(ref).take(3)
    if several:
        raise ValueError(f"RECORD_REFERENCE_COLLISION: {[r[0] for r in several]}")
    return once


def pair_counts(records: DataFrame, spec: Spec) -> DataFrame:
    """(rule, keys, pairs, most) of each blocking rule, from the keys' counts alone: what a join would make before modes and orders cut it."""
    out = None
    for rule in spec.blocking:
        sizes = records.dropna(subset=list(rule)).groupBy(*rule).agg(F.count("*").alias("n"))
        pairs = F.col("n").cast("decimal(38,0)") * (F.col("n") - 1) / 2
        one = sizes.agg(F.lit(",".join(rule)).alias("rule"), F.count("*").alias("keys"), F.coalesce(F.sum(pairs), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
        out = one if out is None else out.unionByName(one)
    return out


def check_budget(records: DataFrame, spec: Spec) -> None:
    """Refuse, before any join, rules whose blocks have more pairs than the spec allows; a common value needs a narrower rule."""
    total = pair_counts(records, spec).collect()
    if sum(r.pairs for r in total) > spec.max_pairs:
        raise ValueError(f"PAIR_BUDGET_EXCEEDED: {[(r.rule, r.pairs) for r in total]} > {spec.max_pairs}")


def candidate_pairs(records: DataFrame, spec: Spec, ref: str = "record_ref", source: str = "source_id", carried: tuple[str, ...] = (), after: int = 0) -> DataFrame:
    """(l, r) references of the pairs that agree on all fields of a rule, once each; nulls never agree.

    The fields of both sides and `carried` columns come along. With `after`, only pairs that agree on none of the first so many rules.

    A block's pairs are a triangle, which is cut into tiles: its records are dealt to groups of about `spec.tile`, and each
    two groups, and each one with itself, are a tile of their own. So a common key's pairs are dealt to all tasks in
    even parts, and a rare key's block is one tile. A key has GROUPS groups at most, so that copies of its records grow as
    the records do; its tiles grow instead.
    """
    fields = sorted({c.field for c in spec.comparisons} | {f for rule in spec.blocking for f in rule} | set(carried))
    cells = F.struct(F.col(ref).alias("ref"), F.col(source).alias("source"), *[F.col(f).alias(f"f_{f}") for f in fields])
    names = ["ref", "source", *[f"f_{f}" for f in fields]]

    def agree(rule: tuple[str, ...]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"x_f_{f}") == F.col(f"y_f_{f}") for f in rule])

    sides = {"LINK_ONLY": F.col("x_source") != F.col("y_source"), "DEDUPE_ONLY": F.col("x_source") == F.col("y_source"), "LINK_AND_DEDUPE": F.lit(True)}[spec.mode]
    out = None
    for k, rule in enumerate(spec.blocking):
        if k < after:
            continue
        known = reduce(lambda x, y: x & y, [F.col(f).isNotNull() for f in rule])
        keyed = records.where(known).select(F.struct(*[F.col(f).alias(f"k{i}") for i, f in enumerate(rule)]).alias("key"), cells.alias("cells"))
        left, right = tiled(keyed, spec.tile, spec.seed)
        # a pair belongs to the first rule it agrees on, so no distinct is needed afterwards
        new = reduce(lambda x, y: x & y, [~F.coalesce(agree(other), F.lit(False)) for other in spec.blocking[:k]], F.lit(True))
        parts = 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        x, y = (s.select("key", "low", "high", *[F.col(f"cells.{c}").alias(f"{n}_{c}") for c in names]).repartition(parts, "key", "low", "high") for s, n in ((left, "x"), (right, "y")))
        # few bytes, but much work: tasks aren't joined by size
        met = x.hint("merge").join(y, ["key", "low", "high"])
        before = F.col("x_ref") < F.col("y_ref")
        # inside a group each pair is met both ways, between two groups once
        pairs = met.where(sides & new & (before | ((F.col("low") < F.col("high")) & (F.col("x_ref") > F.col("y_ref")))))

        def of(name: str, first: bool) -> Column:
            return F.when(before if first else ~before, F.col(f"x_{name}")).otherwise(F.col(f"y_{name}"))

        one = pairs.select(of("ref", True).alias("l"), of("source", True).alias("ls"), *[of(f"f_{f}", True).alias(f"l_{f}") for f in fields], of("ref", False).alias("r"), of("source", False).alias("rs"), *[of(f"f_{f}", False).alias(f"r_{f}") for f in fields])
        out = one if out is None else out.unionByName(one)
    return out


def tiled(keyed: DataFrame, tile: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The two sides (key, low, high, cells) of all tiles of all keys; keyed: (key, cells), where cells.ref tells records apart.

    Groups have `tile` records, or a GROUPS-th of the key's if these are more. A record of group g stands on the left of the tiles (g, g), (g, g + 1)… and on the right of (0, g), (1, g)… (g, g).
    """
    keyed = keyed.withColumn("spread", F.xxhash64("cells.ref", F.lit(seed)))
    sizes = settled(keyed.groupBy("key").agg(F.count("*").alias("n")))
    dealt = joined_by_weight(keyed, sizes, "key", "n").withColumn("groups", F.least(F.ceil(F.col("n") / F.lit(tile)), F.lit(GROUPS)))
    dealt = dealt.withColumn("group", F.pmod("spread", "groups"))
    left = dealt.select("key", F.col("group").alias("low"), F.explode(F.sequence("group", F.col("groups") - 1)).alias("high"), "cells")
    right = dealt.select("key", F.explode(F.sequence(F.lit(0).cast("long"), "group")).alias("low"), F.col("group").alias("high"), "cells")
    return left, right


def partners(records: DataFrame, spec: Spec, ref: str = "record_ref", source: str = "source_id") -> DataFrame:
    """The distinct records with n, how many rows each has, and before and after: how many of its row's candidate pairs have a lesser and a greater other reference.

    The pairs are those of `candidate_pairs`, of which none is made or left out: what is asked of a block are the places of
    its sorted records. Pairs that agree on several rules, or that a mode leaves out, are taken off by the places among the
    records that agree on all of that. So the work grows with the records, however many pairs they have.
    """
    modes = {"LINK_ONLY": [((), 1), ((source,), -1)], "DEDUPE_ONLY": [((source,), 1)], "LINK_AND_DEDUPE": [((), 1)]}[spec.mode]
    signs: dict[tuple[str, ...], int] = {}
    for n in range(1, len(spec.blocking) + 1):
        for rules in combinations(spec.blocking, n):
            for extra, sign in modes:
                key = tuple(sorted({f for rule in rules for f in rule} | set(extra)))
                signs[key] = signs.get(key, 0) + sign * (-1) ** (n + 1)
    columns = records.columns
    rows = records.groupBy(*columns).agg(F.count("*").alias("n"))
    if spec.mode == "LINK_ONLY":
        rows = rows.where(F.col(source).isNotNull())
    signs = {key: sign for key, sign in signs.items() if sign}
    if len(signs) > 1:
        rows = settled(rows)
    out = None
    for key, sign in signs.items():
        one = _placed(rows.dropna(subset=[*key, ref]), key, ref)
        one = one.select(*columns, "n", (F.lit(sign) * F.col("before")).alias("before"), (F.lit(sign) * F.col("after")).alias("after"))
        out = one if out is None else out.unionByName(one)
    return out if len(signs) == 1 else out.groupBy(*columns, "n").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))


def _placed(rows: DataFrame, key: tuple[str, ...], ref: str) -> DataFrame:
    """rows, which stand n times each, with how many of their key have a lesser (before) and a greater (after) reference.

    The sorted rows are cut into ranges, to whose running counts the totals of the key's ranges before them are added: a common key goes to many tasks.
    """
    ranged = settled(rows.repartitionByRange(*key, ref).withColumn("_range", F.spark_partition_id()))
    of_key = Window.partitionBy(*key)
    totals = ranged.groupBy(*key, "_range").agg(F.sum("n").alias("_here"))
    totals = totals.withColumn("_all", F.sum("_here").over(of_key)).withColumn("_past", F.sum("_here").over(of_key.orderBy("_range")) - F.col("_here"))
    inside = Window.partitionBy(*key, "_range")
    # of rows with one reference none is before another
    upto = F.sum("n").over(inside.orderBy(ref).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    beside = ranged.withColumn("_upto", upto).withColumn("_equal", F.sum("n").over(Window.partitionBy(*key, "_range", ref)))
    met = beside.join(totals, [*key, "_range"])
    return met.withColumn("before", F.col("_past") + F.col("_upto") - F.col("_equal")).withColumn("after", F.col("_all") - F.col("_past") - F.col("_upto"))


def levels_told(c: Comparison) -> list[int]:
    """The level of each edit distance of unequal texts, up to the last limit."""
    return [next(c.levels - 1 - k for k, limit in enumerate(c.limits) if d <= limit) for d in range(math.floor(max(c.limits)) + 1)]


def level(c: Comparison) -> Column:
    """The agreement level of a pair in a field: null where a side is missing."""
    a, b = F.col(f"l_{c.field}"), F.col(f"r_{c.field}")
    top = c.levels
    out = F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(a == b, top)
    if c.method == "levenshtein":
        # one distance for each pair; beyond the last limit it isn't worked out, but -1
        told = levels_told(c)
        return out.otherwise(F.coalesce(F.get(F.array(*map(F.lit, told)), F.levenshtein(a, b, len(told) - 1)), F.lit(0)))
    if c.method != "exact":
        measured = jaro_winkler_of(a, b)
        for k, limit in enumerate(c.limits):
            out = out.when(measured >= limit, top - 1 - k)
    return out.otherwise(0)


def with_levels(pairs: DataFrame, spec: Spec) -> DataFrame:
    return pairs.select("*", *[level(c).alias(f"v_{c.field}") for c in spec.comparisons])


def patterns(pairs: DataFrame, spec: Spec) -> list:
    """Comparison vectors and how many pairs have each: a table bounded by the levels, not by the pairs."""
    return pairs.groupBy(*[f"v_{c.field}" for c in spec.comparisons]).agg(F.count("*").alias("n")).collect()


def vector_counts(records: DataFrame, spec: Spec, ref: str = "record_ref", source: str = "source_id") -> DataFrame:
    """(v_<field>…, pairs, first_left, last_right) of all candidate pairs' comparison vectors: how many pairs have it, their least left and greatest right reference.

    References tell records apart. Where pairs of several sources are compared in one text by edits and else exactly, no block
    makes all its pairs: what agrees in the exact fields is counted by classes of records that are equal in them, and all
    their pairs count as far in the text. Those that are near are found by `edits.near` and counted at their level instead.
    Of each record is known how many partners it has in each vector, hence the ends. Pairs of a rule with the text itself, and
    of texts of over `edits.LONGEST` characters, are made, though once for all equal records. Other specs' pairs are all made.
    """
    names = [f"v_{c.field}" for c in spec.comparisons]
    text = next((c for c in spec.comparisons if c.method == "levenshtein"), None)
    exact = tuple(c for c in spec.comparisons if c is not text)
    kinds_of = dict(records.dtypes)
    wide = tuple(rule for rule in spec.blocking if text and text.field not in rule)
    fields = sorted({c.field for c in spec.comparisons} | {f for rule in spec.blocking for f in rule})
    plain = all(not kinds_of[f].startswith(("array", "map", "struct")) for f in fields) and all(c.method == "exact" for c in exact)
    if not wide or spec.mode != "LINK_ONLY" or kinds_of[text.field] != "string" or max(text.limits) >= 3 or not plain:
        pairs = with_levels(candidate_pairs(records, spec, ref, source), spec)
        return pairs.groupBy(*names).agg(F.count("*").alias("pairs"), F.min("l").alias("first_left"), F.max("r").alias("last_right"))

    whole = records.where(F.col(ref).isNotNull() & F.col(source).isNotNull())
    kinds = whole.groupBy(source, *fields).agg(F.count("*").alias("_n"), F.min(ref).alias("_first"), F.max(ref).alias("_last"))
    others = [f for f in fields if f != text.field]
    same = F.struct(source, *others, F.col(text.field).isNull().alias("_none")).alias("_class")
    kinds = settled(kinds.select("*", same, F.monotonically_increasing_id().alias("_kind")))
    told = ["_kind", "_n", "_first", "_last", *names, "_partners"]
    far = f"v_{text.field}"

    def sides(pairs: DataFrame, near: bool = False) -> DataFrame:
        """Both records of each pair, with the other's number; near ones are taken off the far ones."""
        both = F.array(*[F.struct(F.col(a).alias("_kind"), *[F.col(f"{a}_{c}").alias(c) for c in ("_n", "_first", "_last")], F.col(f"{b}__n").alias("_partners")) for a, b in ("lr", "rl")])
        rows = pairs.select(F.explode(both).alias("_s"), *names).select("_s.*", *names).select(*told)
        return moved(rows) if near else rows

    def moved(rows: DataFrame) -> DataFrame:
        ways = F.array(F.struct(F.col(far), F.col("_partners")), F.struct(F.lit(0).alias(far), (-F.col("_partners")).alias("_partners")))
        return rows.withColumn("_s", F.explode(ways)).drop(far, "_partners").select("*", "_s.*").select(*told)

    # all pairs that agree on a rule without the text, as if their texts were far from each other
    classes = settled(kinds.groupBy("_class").agg(F.sum("_n").alias("_n"), F.count("*").alias("_kinds"))).select("_class.*", "*")
    met = candidate_pairs(classes, replace(spec, comparisons=exact, blocking=wide), "_class", source, ("_n", "_kinds", "_none"))
    unknown = F.when(~F.col("l__none") & ~F.col("r__none"), F.lit(0)).alias(far)
    met = met.select("l", "r", "l__n", "r__n", "l__kinds", "r__kinds", *[level(c).alias(f"v_{c.field}") for c in exact], unknown)
    ways = F.array(*[F.struct(F.col(a).alias("_class"), F.col(f"{a}__kinds").alias("_kinds"), F.col(f"{b}__n").alias("_partners")) for a, b in ("lr", "rl")])
    met = met.select(F.explode(ways).alias("_s"), *names).select("_s.*", *names)
    totals = settled(met.groupBy("_class", "_kinds", *names).agg(F.sum("_partners").alias("_partners")))
    found = joined_by_weight(kinds, totals, "_class", "_kinds").select(*told)

    long = kinds.where(F.length(text.field) > edits.LONGEST)
    for k, rule in enumerate(wide):
        found = found.unionByName(moved(_near(kinds.where(F.length(text.field) <= edits.LONGEST), spec, text, rule, wide[:k], source)))
    carried = ("_n", "_first", "_last")
    if long.take(1):
        some = kinds.where(F.length(text.field) > edits.LONGEST - len(levels_told(text)) + 1)
        pairs = candidate_pairs(some, replace(spec, blocking=wide), "_kind", source, carried)
        pairs = pairs.where(F.greatest(F.length(f"l_{text.field}"), F.length(f"r_{text.field}")) > edits.LONGEST)
        found = found.unionByName(sides(with_levels(pairs, spec).where(F.col(far) > 0), near=True))
    narrow = tuple(rule for rule in spec.blocking if rule not in wide)
    if narrow:
        pairs = candidate_pairs(kinds, replace(spec, blocking=wide + narrow), "_kind", source, carried, len(wide))
        found = found.unionByName(sides(with_levels(pairs, spec)))
    each = found.groupBy("_kind", "_n", "_first", "_last", *names).agg(F.sum("_partners").alias("_partners")).where("_partners > 0")
    return each.groupBy(*names).agg(F.expr("sum(_n * _partners) div 2").alias("pairs"), F.min("_first").alias("first_left"), F.max("_last").alias("last_right"))


def _near(kinds: DataFrame, spec: Spec, text: Comparison, rule: tuple[str, ...], before: tuple[tuple[str, ...], ...], source: str) -> DataFrame:
    """(_kind, _n, _first, _last, v_<field>…, _partners): records' partners of other sources in a rule whose texts are near, and that agree on no rule before it."""
    fields = sorted({c.field for c in spec.comparisons if c is not text and c.field not in rule} | {f for other in before for f in other if f not in rule})
    known = kinds.dropna(subset=[*rule, text.field])
    keyed = known.select(F.struct(*[F.col(f).alias(f"k{i}") for i, f in enumerate(rule)]).alias("key"), F.struct(F.col("_kind").alias("ref"), "_n", "_first", "_last", F.col(source).alias("source"), F.col(text.field).alias("text"), *[F.col(f).alias(f"f_{f}") for f in fields]).alias("cells"))
    left, right = tiled(keyed, NEAR, spec.seed)
    met = left.select("*", F.lit(True).alias("is_left")).unionByName(right.select("*", F.lit(False).alias("is_left")))
    # small tiles go together, so that no block is a call of its own
    parts = 4 * int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bundles = 1 + 16 * kinds.count() // NEAR
    met = met.select(F.pmod(F.xxhash64("key", "low", "high"), F.lit(bundles)).alias("bundle"), "key.*", "low", "high", "is_left", "cells.*").repartition(min(parts, bundles), "bundle")
    kind = dict(kinds.dtypes)["_first"]
    schema = f"_kind long, _n long, _first {kind}, _last {kind}, " + "".join(f"`v_{c.field}` int, " for c in spec.comparisons) + "_partners long"
    return met.groupBy("bundle").applyInArrow(_near_in(spec, text, rule, before), schema)


def _near_in(spec: Spec, text: Comparison, rule: tuple[str, ...], before: tuple[tuple[str, ...], ...]) -> Callable[[pa.Table], pa.Table]:
    told = np.array([text.levels, *levels_told(text)[1:]])
    sizes = [c.levels + 2 for c in spec.comparisons]

    def coded(rows: pa.Table, name: str) -> np.ndarray:
        """Small numbers, equal where values are; -1 for null."""
        return rows[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def found(rows: pa.Table) -> pa.Table:
        tile = np.zeros(len(rows), np.int64)
        for name in [*[f"k{i}" for i in range(len(rule))], "low", "high"]:
            values = coded(rows, name)
            tile = np.unique(tile * (values.max() + 1) + values, return_inverse=True)[1].astype(np.int64)
        is_left, owner, n = rows["is_left"].to_numpy(), coded(rows, "source"), rows["_n"].to_numpy()
        texts = np.array(rows["text"].to_pylist(), object)
        inside = rows["low"].to_numpy() == rows["high"].to_numpy()
        values = {name[2:]: coded(rows, name) for name in rows.column_names if name.startswith("f_")}
        out: list[np.ndarray] = []
        for s in range(int(owner.max()) + 1):
            # inside a group each pair is met both ways, between two groups once
            x, y = np.flatnonzero(is_left & (owner == s)), np.flatnonzero(~is_left & np.where(inside, owner > s, owner != s))
            x, y = x[np.isin(tile[x], tile[y])], y[np.isin(tile[y], tile[x])]
            for i, j, d in edits.near(texts[x].tolist(), tile[x], texts[y].tolist(), tile[y], len(told) - 1):
                i, j = x[i], y[j]
                new = np.ones(len(i), bool)
                for other in before:
                    new &= ~np.logical_and.reduce([np.ones(len(i), bool), *[(values[f][i] == values[f][j]) & (values[f][i] >= 0) for f in other if f not in rule]])
                i, j, d = i[new], j[new], d[new]
                vector = np.zeros(len(i), np.int64)
                for c, size in zip(spec.comparisons, sizes, strict=True):
                    if c is text:
                        v = told[d] + 1
                    elif c.field in rule:
                        v = c.levels + 1
                    else:
                        a, b = values[c.field][i], values[c.field][j]
                        v = np.where((a < 0) | (b < 0), 0, np.where(a == b, c.levels + 1, 1))
                    vector = vector * size + v
                for one, other in ((i, j), (j, i)):
                    pair, at = np.unique(np.stack([one, vector]), axis=1, return_inverse=True)
                    out.append(np.vstack([pair, np.bincount(at.ravel(), n[other], pair.shape[1]).astype(np.int64)]))
        at, vector, partners = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        columns = {}
        for c, size in zip(reversed(spec.comparisons), reversed(sizes), strict=True):
            vector, v = np.divmod(vector, size)
            columns[f"v_{c.field}"] = pa.array(v - 1, pa.int32(), mask=v == 0)
        kept = rows.select(["ref", "_n", "_first", "_last"]).rename_columns(["_kind", "_n", "_first", "_last"]).take(pa.array(at))
        for c in spec.comparisons:
            kept = kept.append_column(f"v_{c.field}", columns[f"v_{c.field}"])
        return kept.append_column("_partners", pa.array(partners, pa.int64()))

    return found


def u_probabilities(records: DataFrame, spec: Spec, ref: str = "record_ref") -> dict[str, list[float]]:
    """Shares of levels among random pairs: each record is joined to one of a hash's neighbours."""
    fields = [c.field for c in spec.comparisons]
    total = records.count()
    buckets = max(1, total * total // max(1, 2 * spec.u_pairs))
    left = records.select(F.col(ref).alias("l"), *[F.col(f).alias(f"l_{f}") for f in fields], F.pmod(F.xxhash64(ref, F.lit(spec.seed)), F.lit(buckets)).alias("k"))
    right = records.select(F.col(ref).alias("r"), *[F.col(f).alias(f"r_{f}") for f in fields], F.pmod(F.xxhash64(ref, F.lit(spec.seed + 1)), F.lit(buckets)).alias("k"))
    rows = patterns(with_levels(left.join(right, "k").where("l != r"), spec), spec)
    out = {}
    for c in spec.comparisons:
        counts = [0.0] * (c.levels + 1)
        for row in rows:
            if row[f"v_{c.field}"] is not None:
                counts[row[f"v_{c.field}"]] += row.n
        whole = sum(counts)
        out[c.field] = [(x + 0.5) / (whole + 0.5 * len(counts)) for x in counts]
    return out


def m_probabilities(rows: list, spec: Spec, u: dict[str, list[float]]) -> tuple[dict[str, list[float]], float]:
    """Shares of levels among matches, and the share of matches, by expectation-maximization over vector counts."""
    m = {c.field: [0.05 / c.levels] * c.levels + [0.95] for c in spec.comparisons}
    prior = spec.prior
    for _ in range(spec.iterations):
        counts = {f: [1e-6] * len(p) for f, p in m.items()}
        matched = total = 0.0
        for row in rows:
            odds = prior / (1 - prior)
            for c in spec.comparisons:
                v = row[f"v_{c.field}"]
                if v is not None:
                    odds *= m[c.field][v] / u[c.field][v]
            share = odds / (1 + odds) * row.n
            matched, total = matched + share, total + row.n
            for c in spec.comparisons:
                v = row[f"v_{c.field}"]
                if v is not None:
                    counts[c.field][v] += share
        m = {f: [x / sum(xs) for x in xs] for f, xs in counts.items()}
        prior = min(max(matched / total, 1e-6), 1 - 1e-6) if total else prior
    return m, prior


def with_frequencies(pairs: DataFrame, records: DataFrame, spec: Spec) -> DataFrame:
    """pairs with `tf_<field>`, the share of records that have the pair's left value, for fields that ask for it."""
    for c in spec.comparisons:
        if c.term_frequency:
            known = records.where(F.col(c.field).isNotNull())
            total = known.agg(F.count("*").alias("_all"))
            shares = known.groupBy(F.col(c.field).alias(f"l_{c.field}")).agg(F.count("*").alias("_n")).join(F.broadcast(total)).select(f"l_{c.field}", (F.col("_n") / F.col("_all")).alias(f"tf_{c.field}"))
            pairs = pairs.join(shares, f"l_{c.field}", "left")
    return pairs


def scored(pairs: DataFrame, spec: Spec, m: dict[str, list[float]], u: dict[str, list[float]], prior: float) -> DataFrame:
    """pairs, or their vectors, with weight (log2 odds), probability, agreements and band."""
    weight = F.lit(math.log2(prior / (1 - prior)))
    for c in spec.comparisons:
        factors = F.array(*[F.lit(math.log2(a / b)) for a, b in zip(m[c.field], u[c.field], strict=True)])
        weight = weight + F.coalesce(F.get(factors, F.col(f"v_{c.field}")), F.lit(0.0))
        if c.term_frequency:
            rarer = F.lit(math.log2(u[c.field][-1])) - F.log2(F.col(f"tf_{c.field}"))
            weight = weight + F.coalesce(F.when(F.col(f"v_{c.field}") == c.levels, rarer), F.lit(0.0))
    agree = reduce(lambda x, y: x + y, [F.coalesce((F.col(f"v_{c.field}") == c.levels).cast("int"), F.lit(0)) for c in spec.comparisons])
    out = pairs.withColumn("weight", weight).withColumn("agreements", agree).withColumn("probability", 1 / (1 + F.pow(F.lit(2.0), -F.col("weight"))))
    gate = F.col("weight") >= spec.weight_gate if spec.weight_gate is not None else F.lit(False)
    strong = (F.col("probability") >= spec.strong) | gate
    band = F.when(strong & (F.col("agreements") >= spec.independent), "STRONG_LINK_EVIDENCE").when(strong | (F.col("probability") >= spec.review), "REVIEW_LINK_EVIDENCE").otherwise("BELOW_EVIDENCE_THRESHOLD")
    return out.withColumn("band", band)


def clusters(edges: DataFrame, records: DataFrame, spec: Spec, ref: str = "record_ref") -> DataFrame:
    """(cluster, members, size, edges, unsafe_bridge, placeholder_only, conflicting_anchors, decision) of linked records."""
    bands = ["STRONG_LINK_EVIDENCE", *(["REVIEW_LINK_EVIDENCE"] if spec.include_review else [])]
    links = edges.where(F.col("band").isin(bands)).select("l", "r", "agreements")
    labels = connected_components(links, "l", "r")
    inside = links.join(labels, links["l"] == labels["node"]).groupBy("component").agg(F.count("*").alias("edges"), F.max("agreements").alias("best"))
    members = labels.join(records.select(F.col(ref).alias("node"), *spec.anchors), "node")
    kinds = [F.countDistinct(a).alias(f"_{a}") for a in spec.anchors]
    groups = members.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("members"), F.count("*").alias("size"), *kinds)
    clash = reduce(lambda x, y: x | y, [F.col(f"_{a}") > 1 for a in spec.anchors], F.lit(False))
    out = groups.withColumn("conflicting_anchors", clash).join(inside, "component")
    out = out.withColumn("unsafe_bridge", (F.col("size") >= 3) & (F.col("edges") < F.col("size") * (F.col("size") - 1) / 2)).withColumn("placeholder_only", F.col("best") == 0)
    risky = F.col("unsafe_bridge") | F.col("placeholder_only") | F.col("conflicting_anchors") | (F.col("size") > spec.max_cluster)
    return out.select(F.col("component").alias("cluster"), "members", "size", "edges", "unsafe_bridge", "placeholder_only", "conflicting_anchors", F.when(risky, "REVIEW_CLUSTER").otherwise("CANDIDATE_CLUSTER").alias("decision"))


def resolve(records: DataFrame, spec: Spec, ref: str = "record_ref", source: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(scored pairs, clusters) of the records."""
    records = load(records, ref)
    check_budget(records, spec)
    pairs = settled(with_levels(candidate_pairs(records, spec, ref, source), spec))
    u = u_probabilities(records, spec, ref)
    m, prior = m_probabilities(patterns(pairs, spec), spec, u)
    edges = scored(with_frequencies(pairs, records, spec), spec, m, u, prior)
    return edges, clusters(edges, records, spec, ref)


def pair_universe(records: DataFrame, mode: str, source: str = "source_id") -> int:
    """How many pairs there would be without blocking."""
    counts = [r["count"] for r in records.groupBy(source).count().collect()]
    n, within = sum(counts), sum(c * (c - 1) // 2 for c in counts)
    return {"LINK_AND_DEDUPE": n * (n - 1) // 2, "DEDUPE_ONLY": within, "LINK_ONLY": n * (n - 1) // 2 - within}[mode]
