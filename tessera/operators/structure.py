"""Matchers that look beyond a pair of columns: similarity carried along the structure of two schemas, and transport between distributions.

A schema is a graph of edges (source, label, target): a table has columns, a column has a type and may refer to a table.
Pairs of nodes that are joined by edges of one label in both graphs are neighbours, and each pair passes its similarity
on to its neighbours, shared out by label, until nothing changes by more than a tolerance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import settled

POINTS = 33  # of a quantile sketch: its ends and 31 places between
ACCURACY = 100_000


def schema_edges(tables: dict[str, DataFrame], references: DataFrame | None = None) -> DataFrame:
    """(source, label, target) of the tables' columns and types, and of references (column, table)."""
    spark = next(iter(tables.values())).sparkSession
    out = []
    for t, rows in sorted(tables.items()):
        for c, kind in rows.dtypes:
            family = "number" if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else kind
            out += [(t, "column", f"{t}.{c}"), (f"{t}.{c}", "type", f"type:{family}")]
    edges = spark.createDataFrame(out, "source string, label string, target string")
    return edges if references is None else edges.unionByName(references.select(F.col("column").alias("source"), F.lit("refers").alias("label"), F.col("table").alias("target")))


def neighbours(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, share): pairs of nodes and the pairs they pass their similarity to, both ways along an edge; the shares of one label and way sum up to 1.

    A pair is written `left|right`. Edges are metadata; each pair of edges of one label gives two rows.
    """
    both = left.select("label", F.col("source").alias("ls"), F.col("target").alias("lt")).distinct().join(right.select("label", F.col("source").alias("rs"), F.col("target").alias("rt")).distinct(), "label")
    pairs = both.select("label", F.concat("ls", F.lit("|"), "rs").alias("s"), F.concat("lt", F.lit("|"), "rt").alias("t"))
    # a type stands for itself alone
    pairs = pairs.where(~F.col("t").startswith("type:") | (F.substring_index("t", "|", 1) == F.substring_index("t", "|", -1)))
    ways = [pairs.select("label", F.lit(i).alias("way"), F.col(x).alias("a"), F.col(y).alias("b")) for i, (x, y) in enumerate((("s", "t"), ("t", "s")))]
    rows = reduce(DataFrame.unionByName, ways)
    fan = rows.groupBy("label", "way", "a").agg((1 / F.count("*")).alias("share"))
    return rows.join(fan, ["label", "way", "a"]).groupBy("a", "b").agg(F.sum("share").alias("share"))


def flooded(edges: DataFrame, initial: DataFrame, tolerance: float = 1e-4, rounds: int = 64) -> DataFrame:
    """(pair, similarity), the largest 1: initial similarities (pair, start) flow along edges (a, b, share) until they settle, or for so many rounds.

    Each round adds to a pair's start and its last value what its neighbours pass on from theirs.
    """
    edges = settled(edges)
    nodes = edges.select(F.col("a").alias("pair")).union(edges.select("b")).distinct()
    state = settled(nodes.join(initial, "pair", "left").select("pair", F.coalesce("start", F.lit(0.0)).alias("start")).withColumn("now", F.col("start")))
    for _ in range(rounds):
        passed = edges.join(state.select(F.col("pair").alias("a"), (F.col("start") + F.col("now")).alias("has")), "a").groupBy(F.col("b").alias("pair")).agg(F.sum(F.col("has") * F.col("share")).alias("got"))
        grown = settled(state.join(passed, "pair", "left").withColumn("next", F.col("start") + F.col("now") + F.coalesce("got", F.lit(0.0))))
        most = grown.agg(F.max("next")).first()[0] or 1.0
        moved = grown.select(F.max(F.abs(F.col("next") / most - F.col("now")))).first()[0] or 0.0
        state = grown.select("pair", "start", (F.col("next") / most).alias("now"))
        if moved <= tolerance:
            break
    return state.select("pair", F.col("now").alias("similarity"))


def with_structure(pairs: DataFrame, left: DataFrame, right: DataFrame, initial: DataFrame, tolerance: float = 1e-4, rounds: int = 64) -> DataFrame:
    """pairs (left, right) with `structure`; left and right are schema edges, initial has (left, right, start)."""
    start = initial.select(F.concat("left", F.lit("|"), "right").alias("pair"), "start")
    found = flooded(neighbours(left, right), start, tolerance, rounds)
    named = found.select(F.substring_index("pair", "|", 1).alias("left"), F.substring_index("pair", "|", -1).alias("right"), F.col("similarity").alias("structure"))
    return pairs.join(named, ["left", "right"], "left")


def references(inclusions: DataFrame, keys: DataFrame) -> DataFrame:
    """(column, table): columns whose values all stand in a key of one column of another table; inclusions (left, right), keys (right)."""
    return inclusions.join(keys, "right").select(F.col("left").alias("column"), F.substring_index("right", ".", 1).alias("table")).distinct()


def quantile_sketches(table: str, rows: DataFrame, columns: list[str] | None = None, points: int = POINTS, accuracy: int = ACCURACY, ranges: int = 64) -> DataFrame:
    """(column, quantiles) of all numbers of a table: the values at the places ceil(n * k / (points - 1)) of each column's sorted rows.

    Equal numbers are counted first; their running counts are summed over ranges of values, so no task holds a column. The
    places are exact, within rows / accuracy whatever it is. Nulls are left out, and a column without values has no quantiles.
    """
    numbers = columns or [c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    each = [rows.select(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")).where("v IS NOT NULL") for i, c in enumerate(numbers)]
    if not each:
        return rows.sparkSession.createDataFrame([], "column string, quantiles array<double>")
    counts = settled(reduce(DataFrame.union, each).groupBy("i", "v").agg(F.count("*").alias("n")))
    # a bounded number of borders for each column; they only say how the work is dealt
    edges = F.percentile_approx("v", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 1000)
    borders = {r.i: sorted(set(r.b)) for r in counts.groupBy("i").agg(edges.alias("b")).collect()}
    at = F.lit(0)
    for i, own in borders.items():
        at = F.when(F.col("i") == i, F.size(F.filter(F.array(*map(F.lit, own)), lambda b: b < F.col("v")))).otherwise(at)
    placed = counts.withColumn("range", at)
    totals = placed.groupBy("i", "range").agg(F.sum("n").alias("total"))
    own = Window.partitionBy("i").orderBy("range")  # over totals, at most `ranges` a column
    before = totals.select("i", "range", (F.sum("total").over(own) - F.col("total")).alias("before"), F.sum("total").over(Window.partitionBy("i")).alias("size"))
    inside = F.sum("n").over(Window.partitionBy("i", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = placed.withColumn("inside", inside).join(F.broadcast(before), ["i", "range"]).select("i", "v", "n", "size", (F.col("before") + F.col("inside")).alias("upto"))
    places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct(k.alias("k"), F.greatest(F.lit(1), F.floor((F.col("size") * k + points - 2) / (points - 1))).alias("place")))
    hit = F.filter(places, lambda p: (p.place > F.col("upto") - F.col("n")) & (p.place <= F.col("upto")))
    found = upto.select("i", "v", F.explode(F.transform(hit, lambda p: p.k)).alias("k"))
    names = F.array(*[F.lit(f"{table}.{c}") for c in numbers])
    return found.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x.v).alias("quantiles")).select(F.get(names, F.col("i")).alias("column"), "quantiles")


def with_transport(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs with `transport`: 1 less the mean distance that values have to move from one column's quantiles to the other's, as a share of both columns' range.

    Equal distributions give 1. Two columns of one and the same value give 1; pairs without a sketch on both sides give null.
    """
    left = sketches.select(F.col("column").alias("left"), F.col("quantiles").alias("_l"))
    right = sketches.select(F.col("column").alias("right"), F.col("quantiles").alias("_r"))
    far = F.zip_with("_l", "_r", lambda a, b: F.abs(a - b))
    mean = F.aggregate(far, F.lit(0.0), lambda s, x: s + x) / F.size("_l")
    span = F.greatest(F.element_at("_l", -1), F.element_at("_r", -1)) - F.least(F.get("_l", F.lit(0)), F.get("_r", F.lit(0)))
    close = F.when(span > 0, 1 - mean / span).when(span == 0, F.lit(1.0))
    return pairs.join(left, "left", "left").join(right, "right", "left").withColumn("transport", close).drop("_l", "_r")
