"""The queries that SQL can express, beside their SQL."""

import glob
import os

import duckdb
import pytest

from tessera.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = queries()[name](spark, FOLDER)
    names = sorted(found.columns)
    answer = con.execute(oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == names
    want = sorted(repr([r[columns.index(c)] for c in names]) for r in answer.fetchall())
    assert sorted(repr([r[c] for c in names]) for r in found.collect()) == want


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in sorted(queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
