"""Footers, changes around a read, staged parts, the guard of statements, and hypotheses with their refusals."""

import datetime
import glob
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators import hypotheses
from tessera.plans import statements
from tessera.sources import watch
from tessera.sources.files import SourceError

# --- footers --------------------------------------------------------------------------------------------------------


def test_footers_give_counts_and_bounds_of_all_files(spark, tmp_path):
    for i, values in enumerate([[3, None, 7], [-2, 5, None], [None, None, None]]):
        t = pa.table({"n": pa.array(values, pa.int64()), "d": pa.array([v and v / 2 for v in values], pa.float64()), "s": pa.array([v and str(v) for v in values], pa.string()), "day": pa.array([v and datetime.date(2024, 1, 1 + abs(v)) for v in values], pa.date32()), "l": pa.array([[1]] * 3)})
        pq.write_table(t, f"{tmp_path}/{i}.parquet")
    got = {r.column: tuple(r)[1:] for r in watch.footer_statistics(spark, str(tmp_path)).collect()}
    assert got == {"n": (9, 4, 5, "-2", "7"), "d": (9, 4, 5, "-1.0", "3.5"), "s": (9, 4, 5, None, None), "day": (9, 4, 5, "2024-01-03", "2024-01-08"), "l": (9, None, None, None, None)}
    with pytest.raises(SourceError, match="UNKNOWN_COLUMN"):
        watch.footer_statistics(spark, str(tmp_path), ["x"])


def test_footers_read_no_data(spark):
    plan = watch.footer_rows(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_tax", "l_shipdate"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan and "MAX(l_tax)" in plan and "ReadSchema: struct<count(*):bigint" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


# --- change around a read --------------------------------------------------------------------------------------------


def written(spark, path, n=20):
    spark.range(n).repartition(2).write.mode("overwrite").parquet(path)
    return sorted(glob.glob(f"{path}/part-*.parquet"))


def test_a_read_of_unchanged_files(spark, tmp_path):
    path = str(tmp_path / "t")
    written(spark, path)
    with watch.unchanged(spark, path, digests=True) as rows:
        assert rows.count() == 20


@pytest.mark.parametrize("what", ["rewrite", "remove", "add", "touch"])
def test_a_change_in_between_is_an_error(spark, tmp_path, what):
    path = str(tmp_path / "t")
    files = written(spark, path)
    with pytest.raises(SourceError, match="SNAPSHOT_INVALID.*while"):
        with watch.unchanged(spark, path) as rows:
            rows.count()
            if what == "rewrite":
                pq.write_table(pa.table({"id": list(range(50))}), files[0])
            elif what == "remove":
                os.remove(files[0])
            elif what == "add":
                pq.write_table(pa.table({"id": [1]}), f"{path}/part-new.parquet")
            else:
                os.utime(files[0], (1, 1))


def test_digests_show_what_sizes_and_times_do_not(spark, tmp_path):
    path, file = str(tmp_path), f"{tmp_path}/one.parquet"
    pq.write_table(pa.table({"id": [1, 2]}), file)
    at, data = os.stat(file).st_mtime_ns, bytearray(open(file, "rb").read())

    def same_size_and_time():
        data[8] ^= 1
        open(file, "wb").write(data)
        os.utime(file, ns=(at, at))

    with watch.unchanged(spark, path):
        same_size_and_time()
    with pytest.raises(SourceError, match="CHANGED"):
        with watch.unchanged(spark, path, digests=True):
            same_size_and_time()


# --- parts ---------------------------------------------------------------------------------------------------------


def test_a_lost_part_is_staged_again_and_a_repeated_one_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = spark.range(300).selectExpr("id", "cast(id % 7 as string) as s", "array(id) as l", "if(id % 3 = 0, null, id / 2) as d")
    assert watch.stage_parts(rows, folder, ["id"], 5) == {"written": 5, "in_place": 0, "restaged": 0}
    assert watch.stage_parts(rows.repartition(3), folder, ["id"], 5) == {"written": 0, "in_place": 5, "restaged": 0}
    want = sorted(map(str, rows.collect()))
    assert sorted(map(str, watch.read_parts(spark, folder).select(*rows.columns).collect())) == want
    lost = json.load(open(f"{folder}/manifest/part-000003.json"))["folder"]
    for f in glob.glob(f"{lost.removeprefix('file:')}/*.parquet"):
        os.remove(f)
    with pytest.raises(SourceError, match=r"parts \[3\]"):
        watch.read_parts(spark, folder)
    assert watch.stage_parts(rows, folder, ["id"], 5) == {"written": 0, "in_place": 4, "restaged": 1}
    assert sorted(map(str, watch.read_parts(spark, folder).select(*rows.columns).collect())) == want


def test_a_changed_part_and_other_content_are_refused(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = spark.range(100).selectExpr("id", "id * 2 as v")
    watch.stage_parts(rows, folder, ["id"], 3)
    with pytest.raises(SourceError, match="PART_COLLISION"):
        watch.stage_parts(rows.selectExpr("id", "v + 1 as v"), folder, ["id"], 3)
    with pytest.raises(SourceError, match="PART_COLLISION"):
        watch.stage_parts(rows, folder, ["id"], 4)
    file = glob.glob(f"{json.load(open(f'{folder}/manifest/part-000001.json'))['folder'].removeprefix('file:')}/*.parquet")[0]
    pq.write_table(pa.table({"id": [1], "v": [5]}), file)
    with pytest.raises(SourceError, match=r"parts \[1\]"):
        watch.read_parts(spark, folder)
    assert watch.stage_parts(rows, folder, ["id"], 3)["restaged"] == 1
    assert watch.read_parts(spark, folder).count() == 100


def test_a_stage_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    rows = spark.range(100).toDF("id")
    real = watch.Store.register

    def fails_after_two(self, entry):
        if len(self.entries()) == 2:
            raise OSError("driver lost")
        real(self, entry)

    monkeypatch.setattr(watch.Store, "register", fails_after_two)
    with pytest.raises(OSError):
        watch.stage_parts(rows, folder, ["id"], 4)
    monkeypatch.setattr(watch.Store, "register", real)
    assert watch.stage_parts(rows, folder, ["id"], 4) == {"written": 2, "in_place": 2, "restaged": 0}
    assert sorted(r.id for r in watch.read_parts(spark, folder).collect()) == list(range(100))
    with pytest.raises(SourceError, match="has no parts"):
        watch.read_parts(spark, str(tmp_path / "none"))


# --- guard ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,kind",
    [
        ("SELECT parent_id FROM parent", "READ_QUERY"),
        ("PRAGMA table_info(parent)", "METADATA_QUERY"),
        ("BEGIN", "TRANSACTION_CONTROL_ALLOWED"),
        ("UPDATE parent SET parent_code='x'", "WRITE_DML"),
        ("CREATE TABLE x(a int)", "DDL"),
        ("CALL dangerous_proc()", "PROCEDURE_EXECUTION"),
        ("SELECT * FROM parent INTO OUTFILE 'x'", "FILESYSTEM_EXPORT"),
        ("SELECT 1; SELECT 2", "MULTI_STATEMENT"),
        ("nonsense source command", "UNKNOWN"),
        ("ATTACH DATABASE ':memory:' AS other", "DDL"),
        ("PRAGMA writable_schema = ON", "DDL"),
        ("VACUUM INTO 'export.db'", "DDL"),
        ("/* safe */ SELECT 1; -- second statement\n SELECT 2", "MULTI_STATEMENT"),
        ("", "MULTI_STATEMENT"),
        (None, "MULTI_STATEMENT"),
        ("SELECT 1;", "MULTI_STATEMENT"),
        ("  -- only a comment", "MULTI_STATEMENT"),
        ("SELECT 'a;b' -- ; \n", "READ_QUERY"),
        ("SELECT /* /* DROP */ ; */ 1", "READ_QUERY"),
        ("SELECT /* /* */ 1", "UNKNOWN"),
        ("SELECT 'open", "UNKNOWN"),
        ('SELECT "delete" FROM t', "READ_QUERY"),
        ("SELECT [update] FROM t", "READ_QUERY"),
        ("SELECT `drop` FROM t", "READ_QUERY"),
        ("SELECT $a$ ; DROP TABLE x $a$", "READ_QUERY"),
        ("SELECT update_date, deleted FROM t", "READ_QUERY"),
        ("SELECT (1", "UNKNOWN"),
        ("SELECT 1)", "UNKNOWN"),
        ("WITH a AS (SELECT 1), b AS (UPDATE t SET x = 1 RETURNING x) SELECT * FROM b", "WRITE_DML"),
        ("WITH a AS (SELECT 1) DELETE FROM t", "WRITE_DML"),
        ("WITH a AS (SELECT replace(x, 'a', 'b') FROM t) SELECT * FROM a", "READ_QUERY"),
        ("EXPLAIN SELECT 1", "METADATA_QUERY"),
        ("(SELECT 1) UNION (SELECT 2)", "READ_QUERY"),
        ("INSERT INTO t SELECT 1", "WRITE_DML"),
        ("COPY t TO 'x.csv'", "FILESYSTEM_EXPORT"),
        ("SELECT load_extension('x')", "PROCEDURE_EXECUTION"),
        ("GRANT ALL ON t TO u", "DDL"),
        ("SELECT name FROM sqlite_master", "METADATA_QUERY"),
    ],
)
def test_kinds_of_statements(text, kind):
    found = statements.classify(text)
    assert found.kind == kind
    assert found.allowed == (kind in ("READ_QUERY", "METADATA_QUERY", "TRANSACTION_CONTROL_ALLOWED"))
    assert found.fingerprint.startswith("sha256:") and (not text or text not in repr(found))


def test_a_column_of_statements(spark):
    rows = spark.createDataFrame([("SELECT 1",), (None,), ("DROP TABLE x",)], "s string")
    assert [r[0] for r in rows.select(statements.classified(rows.s)).collect()] == ["READ_QUERY", "MULTI_STATEMENT", "DDL"]


# --- hypotheses ------------------------------------------------------------------------------------------------------

DECISIONS = [("d1", "MAPPING", "REVIEW_REQUIRED", "f1", "s"), ("d2", "RELATIONSHIP", "INCOMPLETE_REQUIRED_EVIDENCE", "f2", "s"), ("d3", "MAPPING", "REVIEW_REQUIRED", "f3", "s"), ("d3", "MAPPING", "REVIEW_REQUIRED", "f4", "s"), ("d5", "MAPPING", "REVIEW_REQUIRED", "f5", "t"), ("d6", "MAPPING", "REVIEW_REQUIRED", "f6", "s")]
REVIEWS = [
    ("r1", "REVIEW_EVIDENCE_DECISIONS", "d1", "ACCEPTED", False, "f1", "s"),
    ("r2", "REVIEW_EVIDENCE_DECISIONS", "d2", "SKIPPED", None, "f2", "s"),
    ("r3", "REVIEW_EVIDENCE_DECISIONS", "d1", "REJECTED", False, "f1", "s"),
    ("r4", "REVIEW_ANALYTICAL_PLAN", "d1", "ACCEPTED", True, "old", "t"),
    ("r5", "REVIEW_EVIDENCE_DECISIONS", "d5", "ACCEPTED", False, "f5", "t"),
    ("r6", "REVIEW_EVIDENCE_DECISIONS", "d6", "ACCEPTED", False, "f6", "s"),
    ("r7", "REVIEW_EVIDENCE_DECISIONS", "d6", "ACCEPTED", False, "f6", "s"),
    ("r8", "REVIEW_EVIDENCE_DECISIONS", "d3", "ACCEPTED", False, "f3", "s"),
    ("r8", "REVIEW_EVIDENCE_DECISIONS", "d3", "REJECTED", False, "f3", "s"),
]


def judged(spark, bindings, reverse=False):
    def frame(rows, schema):
        return spark.createDataFrame(rows[::-1] if reverse else rows, schema)

    return hypotheses.judged(
        frame(bindings, "binding string, kind string, decision string, review string, source string"),
        frame(DECISIONS, "decision string, kind string, state string, fingerprint string, snapshot string"),
        frame(REVIEWS, "review string, checkpoint string, decision string, verdict string, superseded boolean, fingerprint string, snapshot string"),
        frame([("a", "s"), ("b", "s"), ("b", "t")], "source string, snapshot string"),
    )


GOOD = [("b1", "MAPPING", "d1", "r1", "a"), ("b2", "RELATIONSHIP", "d2", "r2", "a")]


def test_refusals_name_all_reasons(spark):
    bad = [
        ("x1", "MAPPING", None, None, "a"),
        ("x2", "RELATIONSHIP", "d1", "r3", "a"),
        ("x3", "MAPPING", "d1", "r4", "a"),
        ("x4", "MAPPING", "d1", "r2", "c"),
        ("x5", "MAPPING", "d5", "r5", "a"),
        ("x6", "MAPPING", "d6", "r6", "a"),
        ("x7", "MAPPING", "d3", "r8", "b"),
        ("x8", "MAPPING", "d1", "nobody", "a"),
    ]
    got = {r.binding: [x.reason for x in r.refusals] for r in judged(spark, GOOD + bad).collect()}
    assert got == {
        "b1": [],
        "b2": [],
        "x1": ["DECISION_UNKNOWN", "REVIEW_MISSING"],
        "x2": ["DECISION_OF_ANOTHER_KIND", "REVIEW_NOT_ACCEPTED"],
        "x3": ["REVIEW_OF_ANOTHER_CHECKPOINT", "REVIEW_SUPERSEDED", "REVIEW_OF_OTHER_EVIDENCE", "REVIEW_OF_ANOTHER_SNAPSHOT"],
        "x4": ["REVIEW_OF_ANOTHER_DECISION", "REVIEW_OF_OTHER_EVIDENCE", "SOURCE_OUTSIDE"],
        "x5": ["DECISION_OF_ANOTHER_SNAPSHOT", "REVIEW_OF_ANOTHER_SNAPSHOT"],
        "x6": ["REVIEWED_TWICE"],
        "x7": ["DECISION_REPEATED", "REVIEW_REPEATED", "SOURCE_OF_SEVERAL_SNAPSHOTS"],
        "x8": ["REVIEW_UNKNOWN"],
    }


def test_a_hypothesis_needs_all_and_does_not_depend_on_order(spark):
    one = {tuple(r) for r in hypotheses.hypothesis(judged(spark, GOOD)).collect()}
    assert one == {tuple(r) for r in hypotheses.hypothesis(judged(spark, GOOD, reverse=True)).collect()}
    assert {r[1:] for r in one} == {("MAPPING", 1, 1, 1), ("RELATIONSHIP", 1, 1, 1)}
    with pytest.raises(ValueError, match="INCOMPLETE_REVIEW/REVIEW_MISSING: 1, first x"):
        hypotheses.hypothesis(judged(spark, [*GOOD, ("x", "MAPPING", "d1", None, "a")]))
    families = spark.createDataFrame([("customer", "ER_REQUIRED"), ("order", "ER_NOT_REQUIRED"), ("part", "ER_REQUIRED")], "family string, requirement string")
    lacking = hypotheses.missing_requirements(families, spark.createDataFrame([("part",)], "family string"))
    assert [tuple(r) for r in lacking.collect()] == [("customer", "MISSING_REQUIRED_ER", "NO_SPEC")]
    with pytest.raises(ValueError, match="MISSING_REQUIRED_ER"):
        hypotheses.hypothesis(judged(spark, GOOD), lacking)
    assert hypotheses.missing_references(domain=["a"], evidence=[], provenance=["b"]) == [("model", "PROVENANCE_INCOMPLETE", "NO_EVIDENCE_REFERENCES")]
