"""Dependencies by counter-examples and inclusions of several columns, beside plain versions."""

import random
from itertools import combinations, permutations

import numpy as np
import pytest

from tessera.operators import discovery, inclusions
from tessera.operators.discovery import Policy


def random_table(spark, rng, columns, rows, size, derived=True):
    data = []
    for _ in range(rows):
        row = [rng.choice([None] + list(range(size))) if rng.random() < 0.1 else rng.randrange(size) for _ in range(columns)]
        if derived and row[0] is not None and row[1] is not None:
            row[2] = (row[0] * 7 + row[1]) % 5
        data.append(tuple(row))
    return spark.createDataFrame(data, ", ".join(f"c{i} int" for i in range(columns))), data


def plain_dependencies(data, columns, arity):
    rows = [r for r in data if None not in r]
    found = {a: [] for a in range(columns)}
    for n in range(1, arity + 1):
        for x in combinations(range(columns), n):
            for a in range(columns):
                if a in x or any(set(y) <= set(x) for y in found[a]):
                    continue
                seen = {}
                if all(seen.setdefault(tuple(r[c] for c in x), r[a]) == r[a] for r in rows):
                    found[a].append(x)
    return {(",".join(f"c{c}" for c in x), f"c{a}") for a, left in found.items() for x in left}


def plain_keys(data, columns, arity):
    rows = [r for r in data if None not in r]
    found = []
    for n in range(1, arity + 1):
        for x in combinations(range(columns), n):
            if rows and not any(set(y) <= set(x) for y in found) and len({tuple(r[c] for c in x) for r in rows}) == len(rows):
                found.append(x)
    return {",".join(f"c{c}" for c in x) for x in found}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("sample", [6, 5000])
def test_dependencies_and_keys_equal_a_plain_search(spark, seed, sample):
    """With a sample of six rows nearly all counter-examples come from the counts."""
    rng = random.Random(seed)
    columns = 5
    rows, data = random_table(spark, rng, columns, rng.choice([1, 2, 30, 200]), rng.choice([2, 4, 9]))
    policy = Policy(sample=sample, examples=rng.choice([0, 1, 64]))
    found = discovery.discover_dependencies(rows, policy=policy)
    assert {(r.lhs, r.rhs) for r in found.found.collect()} == plain_dependencies(data, columns, 3)
    assert found.state == "COMPLETE"
    keys = discovery.discover_keys(rows, policy=policy)
    assert {r.columns for r in keys.found.collect()} == plain_keys(data, columns, 3)


def test_nulls_as_values(spark):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 1, "b"), (2, 3, "c")], "k int, v int, w string")
    equal = {(r.lhs, r.rhs) for r in discovery.discover_dependencies(rows, policy=Policy(arity=1), nulls="EQUAL").found.collect()}
    assert ("k", "v") in equal and ("k", "w") not in equal and ("w", "k") in equal
    excluded = discovery.discover_dependencies(rows, policy=Policy(arity=1)).found.collect()
    assert len(excluded) == 6  # one complete row: every column decides every other


def test_many_columns_are_searched_without_counting_all_sets(spark):
    """Fifty columns have 1,083,425 sets of up to four; a few hundred are counted."""
    rng = random.Random(5)
    data = []
    for i in range(400):
        base = [rng.randrange(40) for _ in range(46)]
        data.append((i, *base, base[0] * 100 + base[1], (base[2] + base[3]) % 50, base[4] % 7))
    rows = spark.createDataFrame(data, ", ".join(f"c{i} int" for i in range(50)))
    found = discovery.discover_dependencies(rows, policy=Policy(arity=2, found=100_000))
    got = {(r.lhs, r.rhs) for r in found.found.collect()}
    assert {("c1,c2", "c47"), ("c47", "c1"), ("c47", "c2"), ("c3,c4", "c48"), ("c5", "c49"), ("c0", "c33")} <= got
    assert found.state == "COMPLETE" and found.counted < found.lattice / 10


def test_constant_columns_empty_tables_and_columns_of_equal_rows(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5)], "a int, b int")
    assert {(r.lhs, r.rhs) for r in discovery.discover_dependencies(rows).found.collect()} == {("a", "b")}
    empty = rows.where("a > 9")
    assert discovery.discover_keys(empty).found.collect() == []
    twice = spark.createDataFrame([(1, 5), (1, 5)], "a int, b int")
    assert discovery.discover_keys(twice).found.collect() == []


def test_budgets_tell_what_they_cut(spark):
    rng = random.Random(6)
    rows, data = random_table(spark, rng, 6, 60, 5)
    few = discovery.discover_dependencies(rows, policy=Policy(sets=8, sample=6))
    assert few.state == "PARTIAL" and few.truncated[0].startswith("MAX_SETS") and few.counted <= 8
    assert {(r.lhs, r.rhs) for r in few.found.collect()} <= plain_dependencies(data, 6, 3)
    assert discovery.discover_keys(rows, policy=Policy(columns=3)).truncated[0].startswith("MAX_COLUMNS")
    assert discovery.discover_dependencies(rows, policy=Policy(seconds=0.0)).truncated[0].startswith("MAX_SECONDS")
    one = discovery.discover_dependencies(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), policy=Policy(found=2))
    assert one.found.count() == 2 and one.truncated[0].startswith("MAX_FOUND")


def test_hitting_sets_equal_a_plain_search():
    rng = random.Random(7)
    for _ in range(50):
        n = rng.randrange(1, 8)
        must = [rng.randrange(1, 1 << n) for _ in range(rng.randrange(6))]
        found = []
        for k in range(1, 4):
            for x in combinations(range(n), k):
                mask = discovery.bits(x)
                if all(mask & m for m in must) and not any(f & mask == f for f in found):
                    found.append(mask)
        assert sorted(discovery.hitting_sets(np.array(must, np.uint64), list(range(n)), 3)) == sorted(found)


def plain_inclusions(tables, arity, least):
    found = {}
    for n in range(1, arity + 1):
        for t, (lc, lrows) in tables.items():
            for u, (rc, rrows) in tables.items():
                if t == u:
                    continue
                for x in combinations(range(len(lc)), n):
                    left = {tuple(r[i] for i in x) for r in lrows if None not in [r[i] for i in x]}
                    for y in permutations(range(len(rc)), n):
                        right = {tuple(r[i] for i in y) for r in rrows if None not in [r[i] for i in y]}
                        parts = n == 1 or all((t, tuple(x[:i] + x[i + 1 :]), u, tuple(y[:i] + y[i + 1 :])) in found for i in range(n))
                        if parts and left and len(left & right) >= least * len(left):
                            found[t, x, u, y] = (len(left), len(right), len(left & right))
    return {(f"{t}({','.join(tables[t][0][i] for i in x)})", f"{u}({','.join(tables[u][0][i] for i in y)})", *v) for (t, x, u, y), v in found.items()}


@pytest.mark.parametrize("least", [1.0, 0.7])
def test_inclusions_equal_a_plain_search(spark, least):
    rng = random.Random(8)
    big = [tuple(rng.choice([None, *range(6)]) for _ in range(3)) for _ in range(80)]
    part = [(r[2], r[0], r[1]) for r in rng.sample(big, 12)] + [(5, 5, None)]
    tables = {"big": (["a", "b", "c"], big), "part": (["p", "q", "r"], part), "none": (["z"], [(None,)])}
    frames = {t: spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns)) for t, (columns, rows) in tables.items()}
    got = inclusions.search_inclusions(frames, 3, least)
    assert {tuple(r[c] for c in ("left", "right", "left_distinct", "right_distinct", "matched")) for r in got.found.collect()} == plain_inclusions(tables, 3, least)
    assert got.state == "COMPLETE"


def test_inclusions_of_families_and_budgets(spark):
    a = spark.createDataFrame([(1, "1", 1.0)], "i int, s string, d double")
    b = spark.createDataFrame([(1, "1", 1.0)], "i bigint, s string, d float")
    found = {(r.left, r.right) for r in inclusions.search_inclusions({"a": a, "b": b}, 1).found.collect()}
    assert found == {("a(i)", "b(i)"), ("b(i)", "a(i)"), ("a(s)", "b(s)"), ("b(s)", "a(s)")}
    cut = inclusions.search_inclusions({"a": a, "b": b, "c": a}, 2, budget=inclusions.Budget(tables=2, columns=2, candidates=3, seconds=0.0))
    assert [x.split(":")[0] for x in cut.truncated] == ["MAX_TABLES", "MAX_COLUMNS", "MAX_COLUMNS", "MAX_CANDIDATES", "MAX_SECONDS"]
    assert cut.candidates == (3,) and cut.state == "PARTIAL"
