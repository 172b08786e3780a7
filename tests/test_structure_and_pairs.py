"""Structural and distribution matchers, tiles of blocks and batch comparisons beside plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import entity_resolution as er
from tessera.operators import structure


def plain_jaro_winkler(a, b):
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == c:
                used.add(j)
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [b[j] for j in sorted(used)]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    base = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return base + start * 0.1 * (1 - base)


@pytest.mark.parametrize("cells", [1, 500, 1 << 22])
def test_batch_jaro_winkler_equals_pairs_one_by_one(cells):
    rng = random.Random(1)

    def text():
        return "".join(rng.choice("abcdé😀 ’\0ÿ") for _ in range(rng.choice([0, 1, 2, 3, 7, 15, 40])))

    left = [text() for _ in range(2000)]
    right = [text() if rng.random() < 0.5 else x[: rng.randrange(len(x) + 1)] + text() for x in left]
    got = er.jaro_winkler_batch(left, right, cells)
    assert got.tolist() == pytest.approx([plain_jaro_winkler(a, b) for a, b in zip(left, right, strict=True)], abs=1e-12)


def test_jaro_winkler_of_columns(spark):
    rows = spark.createDataFrame([("martha", "marhta"), ("martha", "marhta"), ("x", None), (None, "x"), ("", "a"), ("same", "same")], "a string, b string")
    got = [r[0] for r in rows.select(er.jaro_winkler_of(F.col("a"), F.col("b"))).collect()]
    assert got[0] == got[1] == pytest.approx(0.961111111) and got[2:] == [None, None, 0.0, None]
    spec = er.Spec((er.Comparison("a", "jaro_winkler"),), (("a",),))
    levels = rows.select(F.col("a").alias("l_a"), F.col("b").alias("r_a"))
    assert [r.v_a for r in er.with_levels(levels, spec).collect()] == [2, 2, None, None, 0, 3]


@pytest.mark.parametrize("mode", ["LINK_ONLY", "DEDUPE_ONLY", "LINK_AND_DEDUPE"])
@pytest.mark.parametrize("tile", [1, 7, 10_000])
def test_tiled_pairs_equal_a_plain_join(spark, mode, tile):
    rng = random.Random(2)
    rows = [(f"r{i:03}", rng.choice("ab"), rng.choice([None, "x", "x", "y", f"k{i % 5}"]), rng.choice([None, 1, 2])) for i in range(80)]
    records = spark.createDataFrame(rows, "record_ref string, source_id string, name string, number int")
    spec = er.Spec((er.Comparison("name"),), (("name",), ("number", "name"), ("number",)), mode=mode, tile=tile)
    got = er.candidate_pairs(records, spec)
    want = {
        (a[0], b[0])
        for a in rows
        for b in rows
        if a[0] < b[0] and (mode == "LINK_AND_DEDUPE" or (a[1] == b[1]) == (mode == "DEDUPE_ONLY")) and ((a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3]))
    }
    pairs = [(r.l, r.r) for r in got.collect()]
    assert len(pairs) == len(want) and set(pairs) == want
    by_ref = {r[0]: r for r in rows}
    assert all((r.ls, r.l_name, r.rs, r.r_number) == (by_ref[r.l][1], by_ref[r.l][2], by_ref[r.r][1], by_ref[r.r][3]) for r in got.collect())


def test_a_common_key_is_dealt_in_even_parts(spark):
    """One key has half of the rows; the pairs of its tiles are within twice their mean."""
    keyed = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "common").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), F.struct(F.col("id").cast("string").alias("ref")).alias("cells"))
    left, right = er.tiled(keyed, 200)
    sizes = left.groupBy("key", "low", "high").count().join(right.groupBy("key", "low", "high").agg(F.count("*").alias("other")), ["key", "low", "high"]).where("key = 'common'")
    work = [r["count"] * r.other for r in sizes.collect()]
    assert len(work) == 55 and max(work) < 2 * sum(work) / len(work)


def plain_flooding(left, right, start, rounds):
    both = [(label, f"{a}|{x}", f"{b}|{y}") for a, label, b in left for x, other, y in right if label == other and (not b.startswith("type:") or b == y)]
    ways = [(label, 0, s, t) for label, s, t in both] + [(label, 1, t, s) for label, s, t in both]
    fan = Counter((label, way, a) for label, way, a, _ in ways)
    now = {p: start.get(p, 0.0) for _, _, a, b in ways for p in (a, b)}
    first = dict(now)
    for _ in range(rounds):
        got = defaultdict(float)
        for label, way, a, b in ways:
            got[b] += (first[a] + now[a]) / fan[label, way, a]
        grown = {p: first[p] + now[p] + got[p] for p in now}
        most = max(grown.values()) or 1.0
        now = {p: v / most for p, v in grown.items()}
    return now


def test_flooding_equals_a_plain_fixpoint_and_settles(spark):
    left = [("t", "column", "t.a"), ("t", "column", "t.b"), ("t.a", "type", "type:number"), ("t.b", "type", "type:string"), ("t.b", "refers", "u"), ("u", "column", "u.c"), ("u.c", "type", "type:string")]
    right = [("x", "column", "x.a"), ("x", "column", "x.d"), ("x.a", "type", "type:number"), ("x.d", "type", "type:string"), ("x.d", "refers", "y"), ("y", "column", "y.c"), ("y.c", "type", "type:string")]
    start = {"t.a|x.a": 1.0, "u.c|y.c": 0.5}
    frames = [spark.createDataFrame(e, "source string, label string, target string") for e in (left, right)]
    edges = structure.neighbours(*frames)
    initial = spark.createDataFrame(list(start.items()), "pair string, start double")
    got = {r.pair: r.similarity for r in structure.flooded(edges, initial, 0.0, 3).collect()}
    assert got == pytest.approx(plain_flooding(left, right, start, 3))
    settled = {r.pair: r.similarity for r in structure.flooded(edges, initial, 1e-3).collect()}
    assert settled == pytest.approx(plain_flooding(left, right, start, 200), abs=5e-3)
    # nothing in the names says so, but both refer to the tables that the others' columns are in
    assert settled["t.b|x.d"] > settled["t.b|x.a"]


def test_transport_of_odd_columns(spark):
    rows = spark.createDataFrame([(1, 5.0, None, 2), (2, 5.0, None, 2), (3, 5.0, None, 7)], "a int, b double, c double, d int")
    found = structure.quantile_sketches("t", rows)
    assert {r.column for r in found.collect()} == {"t.a", "t.b", "t.d"}
    pairs = spark.createDataFrame([("t.a", "t.a"), ("t.b", "t.b"), ("t.a", "t.b"), ("t.a", "t.c")], "left string, right string")
    got = {(r.left, r.right): r.transport for r in structure.with_transport(pairs, found).collect()}
    assert got["t.a", "t.a"] == got["t.b", "t.b"] == 1.0 and got["t.a", "t.c"] is None and 0 < got["t.a", "t.b"] < 0.6
