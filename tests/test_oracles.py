"""Every query of the engine beside its SQL, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from tessera.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(float(value), 9) if isinstance(value, (decimal.Decimal, float)) else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    found = QUERIES[name](spark, FOLDER)
    names = sorted(found.columns)
    got = ordered(tuple(plain(r[c]) for c in names) for r in found.collect())
    answer = db.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == names
    want = ordered(tuple(plain(r[columns.index(c)]) for c in names) for r in answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).take(1)


def test_star_query_reads_few_columns(spark):
    plan = QUERIES["semantic_segment_year"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "l_comment" not in plan and "l_tax" not in plan


def test_components_of_all_orders(spark, db):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in db.execute("SELECT o_custkey, -1 - (o_orderkey % 97) FROM orders").fetchall():
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in QUERIES["graph_all_components"](spark, FOLDER).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_all_inclusions_of_all_columns(spark, db):
    values = {}
    for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier"):
        for c, kind, *_ in db.execute(f"DESCRIBE {t}").fetchall():
            tag = "integer" if kind in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT") else kind
            values[f"{t}.{c}"] = (tag, {v for (v,) in db.execute(f'SELECT DISTINCT "{c}" FROM {t} WHERE "{c}" IS NOT NULL').fetchall()})
    want = {(a, b) for a, (ka, va) in values.items() for b, (kb, vb) in values.items() if a != b and ka == kb and va and va <= vb}
    assert {(r.left, r.right) for r in QUERIES["deps_all_inclusions"](spark, FOLDER).collect()} == want
