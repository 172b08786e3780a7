"""Exact values on small fixtures: the rules' edges, refusals with their codes, and empty inputs."""

import datetime
import hashlib
import hmac
import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import expressions as ex
from tessera.operators import canonical, dependencies, entity_resolution, evaluation, fusion, graph, matching, privacy, profiling, quality, scale, star, validation
from tessera.plans import semantic
from tessera.sources import files, sqlite
from tessera.streaming import rules as streams


def one(df):
    return df.collect()[0]


# --- expressions -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["ord-1001", 'a"b\\c', "tab\tnew\nline", "سلام", "🙂", "\x1f\x0b\x0e", "\\u001F", "", "\\\x1f"])
def test_surrogate_key_is_the_hash_of_the_canonical_json(spark, text):
    payload = json.dumps({"canonical_reference": text, "namespace": "customer"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    want = int(hashlib.sha256(payload.encode()).hexdigest()[:16], 16) & 0x7FFFFFFFFFFFFFFF or 1
    assert one(spark.createDataFrame([(text,)], "t string").select(ex.surrogate_key("customer", F.col("t")).alias("k"))).k == want


def test_bucket_hmac_and_weekday(spark):
    row = one(spark.range(1).select(ex.bucket(7, F.lit("customer-3"), 11).alias("b"), ex.hmac_sha256(b"k" * 80, F.lit("s:1:ü")).alias("h"), ex.iso_weekday(F.lit("2026-01-04").cast("date")).alias("w")))
    assert row.b == int(hashlib.sha256(b"7:customer-3").hexdigest()[:16], 16) % 11
    assert row.h == hmac.new(b"k" * 80, "s:1:ü".encode(), hashlib.sha256).hexdigest()
    assert row.w == 7


@pytest.mark.parametrize(
    ("pattern", "good", "bad"),
    [
        ("EMAIL_LIKE", "a@b.example", "a@b"),
        ("PHONE_LIKE", "+1 (555) 010-101", "12-34"),
        ("UUID_LIKE", "123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-72d3-a456-426614174000"),
        ("INTEGER_STRING", "-٣", "1.0"),
        ("DECIMAL_STRING", "+1.50", "1."),
        ("DATE_STRING", "2026-01-02T10", "2026-1-2"),
        ("URL_LIKE", "HTTPS://x", "ftp://x"),
    ],
)
def test_patterns_match_whole_values(spark, pattern, good, bad):
    rows = spark.createDataFrame([(good,), (bad,), (good + "\n",)], "v string").select(ex.matches(F.col("v"), pattern).alias("m")).collect()
    assert [r.m for r in rows[:2]] == [True, False]
    assert rows[2].m is (pattern == "PHONE_LIKE")


def test_identity_form(spark):
    rows = spark.createDataFrame([("  Straße  A ",), ("N/A",), ("0000",), (None,), ("Ａｂ",)], "v string").select(ex.identity_form(F.col("v")).alias("n")).collect()
    assert [r.n for r in rows] == ["strasse a", None, None, None, "ab"]


# --- sources -----------------------------------------------------------------------------------------------------


def test_csv_is_text_and_strict(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿id,description,empty,null_marker\n1,"a, b","",NULL\n1,"a, b",,NULL\n', encoding="utf-8")
    rows = [tuple(r) for r in files.read_table(spark, str(path)).collect()]
    assert rows == [("1", "a, b", "", "NULL")] * 2
    (tmp_path / "b.csv").write_text("id,id\n1,2\n")
    with pytest.raises(files.SourceError, match="INVALID_HEADER"):
        files.read_table(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text('id,x\n1,"open\n')
    with pytest.raises(files.SourceError, match="PARSE_FAILED"):
        files.read_table(spark, str(tmp_path / "c.csv"))
    (tmp_path / "d.csv").write_text("id,x\n1\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_table(spark, str(tmp_path / "d.csv")).collect()
    with pytest.raises(files.SourceError, match="UNSUPPORTED_SOURCE"):
        files.read_table(spark, "x.xlsx")


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "s.db")
    con = sqlite3.connect(path)
    con.executescript("""CREATE TABLE parent(parent_id INTEGER PRIMARY KEY, parent_code TEXT NOT NULL UNIQUE);
    CREATE TABLE child(parent_id INT NOT NULL REFERENCES parent(parent_id), child_seq INT NOT NULL, label TEXT, PRIMARY KEY(parent_id, child_seq));
    CREATE TABLE "odd table"("odd column" TEXT, value INT); CREATE VIEW child_view AS SELECT label FROM child;
    INSERT INTO parent VALUES (1, 'P-001'), (2, 'P-002'); INSERT INTO child VALUES (1, 1, 'first'), (1, 2, 'second'), (2, 1, 'third'); INSERT INTO "odd table" VALUES ('quoted', 7);""")
    con.commit()
    con.close()
    found = sqlite.catalog(spark, path)
    assert {(r.name, r.kind) for r in found["tables"].collect()} == {("parent", "table"), ("child", "table"), ("odd table", "table"), ("child_view", "view")}
    kinds = {(r.table, r.kind, tuple(r["columns"]), r.referenced_table) for r in found["constraints"].collect()}
    assert {("parent", "PRIMARY_KEY", ("parent_id",), None), ("parent", "UNIQUE", ("parent_code",), None), ("child", "PRIMARY_KEY", ("parent_id", "child_seq"), None), ("child", "FOREIGN_KEY", ("parent_id",), "parent")} == kinds
    assert sorted(map(tuple, sqlite.read_sqlite(spark, path, "child").collect())) == [(1, 1, "first"), (1, 2, "second"), (2, 1, "third")]
    assert [tuple(r) for r in sqlite.read_sqlite(spark, path, "odd table", ["value"]).collect()] == [(7,)]
    assert sqlite.read_sqlite(spark, path, "child_view").count() == 3
    with pytest.raises(sqlite3.DatabaseError):
        sqlite.connect(path).execute("DELETE FROM child")
    with pytest.raises(files.SourceError, match="CAPABILITY_UNAVAILABLE"):
        sqlite.read_xlsx(spark, "x.xlsx", "s")


def test_staging_detects_changes(spark, tmp_path):
    rows = spark.range(20).withColumn("x", F.col("id") * 2)
    manifest = files.stage(rows, str(tmp_path / "s"))
    assert files.read_staged(spark, manifest, ["x"]).count() == 20
    with pytest.raises(files.SourceError, match="SNAPSHOT_INVALID"):
        files.read_staged(spark, manifest | {"rows": 19})
    with pytest.raises(files.SourceError, match="ROW_ACCOUNTING"):
        files.accounting(3, 1, 1)


def test_bounds_and_selection(spark):
    rows = spark.range(5)
    assert files.bounded(rows, 5, ["id"])[1] == "FULLY_OBSERVED" and files.bounded(rows, 4, ["id"])[1] == "PARTIALLY_OBSERVED" and files.bounded(rows, 0, ["id"])[1] == "NOT_OBSERVED"
    picked = files.Selection(include=("a",), columns={"a": ["id"]}).apply({"a": rows, "b": rows})
    assert list(picked) == ["a"]
    assert [files.declared_sql_type(t) for t in ("INTEGER", "VARCHAR(3)", "BLOB", "DOUBLE", "DECIMAL", "POINT")] == ["integer", "text", "blob", "real", "numeric", "integer"]


# --- profiling and quality -------------------------------------------------------------------------------------------


def test_profile_edges(spark):
    rows = spark.createDataFrame([(1.0, "x"), (float("nan"), "NULL"), (None, "")], "n double, s string")
    got = {(r.column, r.metric): r.value for r in profiling.profile(rows, markers=("NULL",)).collect()}
    assert got["n", "number_count"] == 1 and got["n", "number_variance"] == 0.0
    assert got["s", "marker_count"] == 1 and got["s", "non_missing"] == 2 and got["s", "empty_strings"] == 1
    empty = {(r.column, r.metric): r.value for r in profiling.profile(rows.limit(0)).collect()}
    assert empty["n", "rows"] == 0 and empty["n", "number_mean"] is None


def test_quantiles_take_the_floor(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert {r.quantile: r.value for r in profiling.quantiles(rows, "v").collect()} == {"p25": 3.0, "p50": 5.0, "p75": 7.0}
    assert profiling.quantiles(rows.limit(0), "v").collect() == []


def test_spread_above_the_limit(spark):
    row = one(profiling.spread(spark.range(10), ["id"], limit=5))
    assert row.distinct_count is None and row.uniqueness == "NOT_COMPUTED_BOUNDED"


ORDERS = [("qa-1", "c1", "2"), ("qa-2", "c1", "1"), ("qa-2", None, "x"), (" qa-3", "c9", "")]


def orders(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ORDERS)], "ref int, order_id string, customer string, qty string")


def hits(df):
    return sorted(r[0] for r in df.where("affected").collect())


def test_rules(spark):
    rows, q = orders(spark), quality
    customers = spark.createDataFrame([("c1",)], "id string")
    assert hits(q.affected(rows, q.Rule("r", "UNIQUE_VALUES", "o", ("order_id",)), "ref")) == [1, 2]
    assert hits(q.affected(rows, q.Rule("r", "REQUIRED_VALUE", "o", ("customer", "qty"), markers=("",)), "ref")) == [2, 3]
    assert hits(q.affected(rows, q.Rule("r", "EXPECTED_PATTERN", "o", ("qty",), pattern="INTEGER_STRING", markers=("",)), "ref")) == [2]
    assert hits(q.affected(rows, q.Rule("r", "NORMALIZATION_OPPORTUNITY", "o", ("order_id",)), "ref")) == [3]
    fk = q.Rule("r", "DECLARED_REFERENTIAL_INTEGRITY", "o", ("customer",), target="c", target_columns=("id",))
    assert hits(q.affected(rows, fk, "ref", {"c": customers})) == [3]
    assert q.affected(rows, fk, "ref", {"c": customers}).count() == 3
    assert q.partial_nulls(rows, q.Rule("r", "DECLARED_REFERENTIAL_INTEGRITY", "o", ("customer", "qty"))) == 1
    assert one(q.evaluate({"o": rows.limit(0)}, [q.Rule("r", "UNIQUE_VALUES", "o", ("order_id",))], "ref")).ratio is None
    with pytest.raises(ValueError, match="UNKNOWN_RULE_TYPE"):
        q.Rule("r", "OTHER", "o")


def test_repairs_are_proposals(spark):
    rows = orders(spark)
    trim = quality.propose(rows, quality.Rule("r", "NORMALIZATION_OPPORTUNITY", "o", ("order_id",), repair="trim_whitespace"), "ref")
    assert trim.kept.where("order_id = 'qa-3'").count() == 1 and rows.where("order_id = 'qa-3'").count() == 0
    split = quality.propose(rows, quality.Rule("r", "UNIQUE_VALUES", "o", ("order_id",), quarantine=True), "ref")
    assert split.kept.count() == split.quarantined.count() == 2
    assert quality.propose(rows, quality.Rule("r", "UNIQUE_VALUES", "o", ("order_id",)), "ref") is None


def test_rules_on_a_stream(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    rules = [quality.Rule("big", "NUMERIC_RANGE", "s", ("id",), maximum=6)]
    kept, _ = streams.parted(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), rules)
    run = kept.writeStream.format("memory").queryName("kept_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("kept_rows").count() == 7


# --- dependencies ----------------------------------------------------------------------------------------------------


def f7(spark):
    o = spark.createDataFrame([("o1", "c1", "north"), ("o2", "c2", "south"), ("o3", "missing", None)], "order_id string, customer_id string, region string")
    c = spark.createDataFrame([("c1", "A", "north"), ("c2", "B", "south"), ("c2", "B2", "south")], "customer_id string, name string, region string")
    return o, c


def test_inclusion_of_the_fixture(spark):
    o, c = f7(spark)
    row = one(dependencies.relationship(dependencies.inclusion_measures(o, ["customer_id"], c, ["customer_id"])))
    assert (row.coverage, row.orphans, row.orphan_ratio, row.target_uniqueness, row.relationship_candidate) == (2 / 3, 1, 1 / 3, 2 / 3, False)
    empty = one(dependencies.inclusion_measures(o.limit(0), ["customer_id"], c, ["customer_id"]))
    assert empty.coverage == 1.0 and empty.orphan_ratio == 0.0


def test_functional_dependencies(spark):
    _, c = f7(spark)
    got = {(r.lhs, r.rhs) for r in dependencies.functional_dependencies(c).collect()}
    assert got == {("name", "customer_id"), ("name", "region"), ("customer_id", "region"), ("region", "customer_id")}
    row = one(dependencies.dependency_error(c, ["customer_id"], "name"))
    assert (row.error, row.violating_groups) == (1 / 3, 1)
    assert one(dependencies.dependency_error(c.limit(0), ["customer_id"], "name")).error == 0.0
    assert [r.columns for r in dependencies.unique_combinations(c).collect()] == ["name"]


# --- matching, resolution, fusion, canonical ---------------------------------------------------------------------------


def test_name_matching(spark):
    left = spark.createDataFrame([("crm", "customerCode", "string"), ("crm", "status", "string"), ("crm", "qty", "int")], "table string, column string, native_type string")
    right = spark.createDataFrame([("erp", "client_no", "string"), ("erp", "status", "string"), ("erp", "units", "bigint")], "table string, column string, native_type string")
    best = {r.left: r.right for r in matching.ranked(matching.column_pairs(left, right), ["tokens"], 1).where("score > 0").collect()}
    assert best == {"crm.customerCode": "erp.client_no", "crm.status": "erp.status", "crm.qty": "erp.units"}
    with pytest.raises(ValueError, match="PAIR_BUDGET_EXCEEDED"):
        matching.column_pairs(left, right, 2)


def test_jaro_winkler():
    assert round(entity_resolution.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(entity_resolution.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert entity_resolution.jaro_winkler("", "a") == 0.0


PEOPLE = [("a1", "crm", "alice smith", "alice@x", "1"), ("a2", "erp", "alice smyth", "alice@x", "1"), ("b1", "crm", "bob brown", "bob@x", "2"), ("b2", "erp", "bob brown", "bob@x", "2"), ("h1", "erp", "alice smith", "other@x", "9")]


def test_resolution_keeps_the_hard_negative_apart(spark):
    rows = spark.createDataFrame([*PEOPLE, *[(f"z{i}", "crm" if i % 2 else "erp", f"p{i} q{i}", f"m{i}@x", str(i + 50)) for i in range(30)]], "record_ref string, source_id string, name string, email string, phone string")
    c = entity_resolution.Comparison
    spec = entity_resolution.Spec((c("name", "jaro_winkler", (0.95, 0.85)), c("email"), c("phone")), (("email", "phone"), ("name",)))
    edges, groups = entity_resolution.resolve(rows, spec)
    assert sorted(r.members for r in groups.collect()) == [["a1", "a2"], ["b1", "b2"]]
    assert edges.where("l = 'a1' AND r = 'h1' AND band = 'STRONG_LINK_EVIDENCE'").count() == 0
    assert entity_resolution.pair_universe(rows, "LINK_AND_DEDUPE") == 35 * 34 // 2


def test_rare_values_weigh_more(spark):
    rows = spark.createDataFrame([(f"r{i}", "x", "common" if i < 30 else f"rare{i // 2}") for i in range(60)], "record_ref string, source_id string, name string")
    spec = entity_resolution.Spec((entity_resolution.Comparison("name", term_frequency=True),), (("name",),), mode="DEDUPE_ONLY", independent=1)
    edges, _ = entity_resolution.resolve(rows, spec)
    weights = {r.l_name: r.weight for r in edges.collect()}
    assert weights["rare20"] - weights["common"] == pytest.approx(math.log2(30 / 2))


def test_components_and_neighbourhood(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "left long, right long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43
    near = {r.node: r.depth for r in graph.neighbourhood(edges, spark.range(5, 6), 2, "upstream").collect()}
    assert near == {5: 0, 4: 1, 3: 2}


def test_fusion(spark):
    rows = [("s1", "inclusion_coverage", 1.0, "SUPPORTS"), ("s1", "target_uniqueness", 1.0, "SUPPORTS"), ("s1", "type_compatibility", 1.0, "SUPPORTS"), ("s2", "orphan_ratio", 0.25, "CONTRADICTS"), ("s2", "target_uniqueness", 0.5, "CONTRADICTS"), ("s2", "declared_foreign_key", 1.0, "SUPPORTS"), ("s3", "inclusion_coverage", 7.0, "SUPPORTS")]
    signals = spark.createDataFrame([(*r, f"e{i}", "FULL") for i, r in enumerate(rows)], "subject string, metric string, value double, direction string, evidence_id string, scope string")
    got = {r.subject: r for r in fusion.scores(signals, conflicts=fusion.find_conflicts(signals)).collect()}
    assert (got["s1"].score, got["s1"].band) == (1.0, "HIGH")
    assert got["s2"].score == round((0.75 - 0.5 + 1.0) / 3.75, 12) and got["s2"].band == "CONFLICTED" and got["s2"].missing == "type_compatibility"
    assert (got["s3"].score, got["s3"].band) == (None, "INSUFFICIENT")


def test_survivorship(spark):
    day = datetime.datetime
    rows = spark.createDataFrame([("e", "a", "v2", "erp", "x", day(2026, 1, 2)), ("e", "a", "v1", "crm", None, day(2026, 1, 1)), ("e", "a", "v3", "crm", "y", None)], "canonical_ref string, attribute string, value_ref string, source_id string, value string, observed_at timestamp")
    pick = lambda policy, **k: one(canonical.survivors(rows, policy, **k))
    assert pick("PREFERRED_SOURCE", priority=("erp", "crm")).value == "x"
    assert pick("PREFERRED_SOURCE", priority=("sap",)).conflict == "MISSING_AUTHORITY_CONFLICT"
    assert pick("MOST_RECENT_VALID").conflict == "TEMPORAL_CONFLICT"
    assert (pick("MOST_COMPLETE").value_ref, pick("MOST_COMPLETE").state) == ("v2", "RESOLVED_BY_POLICY")
    assert pick("CONSENSUS").state == "REVIEW_REQUIRED"


# --- star, semantic layer, validation ------------------------------------------------------------------------------------


def test_star_policies(spark):
    dim = star.build_dimension(spark.createDataFrame([("c1", "A")], "id string, name string"), "customer", F.col("id"), {"name": F.col("name")}, ("name",), unknown_member=True)
    facts = spark.createDataFrame([(1, "c1"), (2, "zz"), (None, "c1"), (3, None)], "k int, c string")
    good, bad = star.build_fact(facts, ["k"], [star.ForeignKey(F.col("c"), dim)])
    assert [r.k for r in good.collect()] == [1] and {(r.k, r.reason) for r in bad.collect()} == {(2, "ORPHAN:customer_key"), (None, "NULL_GRAIN:k"), (3, "ORPHAN:customer_key")}
    known, none = star.build_fact(facts.where("k IS NOT NULL"), ["k"], [star.ForeignKey(F.col("c"), dim, "EXPLICIT_UNKNOWN_MEMBER")], lineage="k")
    assert known.count() == 3 and none.count() == 0 and known.where("source_record_refs LIKE '%policy:unknown%'").count() == 2
    open_key, _ = star.build_fact(facts.where("k = 2"), ["k"], [star.ForeignKey(F.col("c"), dim, "NULLABLE_FK", required=False)])
    assert one(open_key).customer_key is None
    with pytest.raises(star.StarError, match="REQUIRED_KEY_CANNOT_BE_NULLABLE"):
        star.build_fact(facts, ["k"], [star.ForeignKey(F.col("c"), dim, "NULLABLE_FK")])
    with pytest.raises(star.StarError, match="DUPLICATE_CANONICAL_REFERENCE"):
        star.build_dimension(spark.createDataFrame([("c1",), ("c1",)], "id string"), "customer", F.col("id"), {})
    with pytest.raises(star.StarError, match="DUPLICATE_GRAIN"):
        star.check_grain(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    with pytest.raises(star.StarError, match="MEASURE_TYPE_MISMATCH"):
        star.coerced(spark.createDataFrame([("x",)], "m string"), {"m": "decimal(38,9)"})


def test_publish_needs_its_manifest(spark, tmp_path):
    counts = star.publish({"dim": spark.range(3), "fact": spark.range(5)}, str(tmp_path / "p"))
    assert counts == {"dim": 3, "fact": 5} and star.read_published(spark, str(tmp_path / "p"), "fact").count() == 5
    with pytest.raises(Exception):  # noqa: B017
        star.read_published(spark, str(tmp_path / "other"), "fact")


def test_sources_by_alias(spark):
    a, b = spark.createDataFrame([("1", "x")], "order_id string, Full_Name string"), spark.createDataFrame([("2", "y")], "order_id string, customer_name string")
    rows = star.union_of_sources({"a": a, "b": b}, {"order_id": [], "customer_name": ["full_name"]})
    assert {(r.source_id, r.customer_name) for r in rows.collect()} == {("a", "x"), ("b", "y")}
    with pytest.raises(star.StarError, match="COLUMN_NOT_RESOLVED"):
        star.resolve_aliases(["x"], {"y": []})


A = semantic.Attribute
TELEMETRY = semantic.Model(
    (semantic.DimensionModel("location", "dim_location", "k", (A("location.name", "name", nullable=False),)), semantic.DimensionModel("date", "dim_date", "date_key", (A("date.day", "full_date", "DATE"),))),
    (
        semantic.FactModel(
            "reading",
            "fact",
            (semantic.Metric("temperature", "t", semantic.SEMI_ADDITIVE, ("MAX",)), semantic.Metric("readings", None, operations=("COUNT",)), semantic.Metric("ratio", None, kind="DERIVED")),
            (semantic.Relationship("location", "lk"), semantic.Relationship("date", "dk", time_role="observed")),
        ),
    ),
)


def test_semi_additive_needs_a_time_scope(spark):
    days = star.build_date_dimension(spark, start="2026-02-01", end="2026-02-02").rows
    key = {str(r.full_date): r.date_key for r in days.collect()}
    fact = spark.createDataFrame([(1, key["2026-02-01"], 10.5), (1, key["2026-02-02"], 11.0), (2, key["2026-02-01"], 9.5)], "lk int, dk long, t double")
    tables = {"fact": fact, "dim_location": spark.createDataFrame([(1, "location-1"), (2, "location-2")], "k int, name string"), "dim_date": days}
    day = datetime.date(2026, 2, 1)
    scope = (semantic.Filter("date.day", "DATE_RANGE", (day, datetime.date(2026, 2, 2))),)
    rows = semantic.query(TELEMETRY, tables, semantic.Request(("temperature",), group_by=("location.name",), filters=scope, time_role="observed", sort=(("location.name", False),))).collect()
    assert [tuple(r) for r in rows] == [("location-1", 11.0), ("location-2", 9.5)]
    with pytest.raises(semantic.SemanticError, match="SEMI_ADDITIVE_TIME_SCOPE_REQUIRED"):
        semantic.plan(TELEMETRY, semantic.Request(("temperature",)))


@pytest.mark.parametrize(
    ("request_", "code"),
    [
        (semantic.Request(()), "EMPTY_SEMANTIC_SELECT"),
        (semantic.Request(("nope",)), "UNKNOWN_METRIC"),
        (semantic.Request(("ratio",)), "DERIVED_METRIC_NOT_EXECUTABLE_V1"),
        (semantic.Request(("readings",), group_by=("x",)), "UNKNOWN_ATTRIBUTE"),
        (semantic.Request(("readings",), limit=0), "INVALID_LIMIT"),
        (semantic.Request(("readings",), filters=(semantic.Filter("location.name", "EQUALS", (3,)),)), "FILTER_TYPE_MISMATCH"),
        (semantic.Request(("readings",), filters=(semantic.Filter("location.name", "EQUALS", (None,)),)), "NULL_FILTER_ON_NON_NULLABLE_ATTRIBUTE"),
        (semantic.Request(("readings",), operations={"readings": "SUM"}), "UNSUPPORTED_AGGREGATION"),
        (semantic.Request(("readings",), sort=(("location.name", False),)), "UNKNOWN_SORT_FIELD"),
        (semantic.Request(("readings",), time_role="other"), "INCOMPATIBLE_TIME_ROLE"),
        (semantic.Request(("readings",), group_by=("location.name", "location.name")), "DUPLICATE_GROUP_ATTRIBUTE"),
    ],
)
def test_refusals(request_, code):
    with pytest.raises(semantic.SemanticError) as error:
        semantic.plan(TELEMETRY, request_)
    assert error.value.code == code


def test_additivity_rules():
    assert semantic.operations_of("ADDITIVE", "SUM(quantity)") == ("SUM",) and semantic.operations_of("ADDITIVE", "count") == ()
    assert semantic.operations_of("SEMI_ADDITIVE", "LAST(x) or MAX(x)") == ("LAST",)


def test_validation(spark):
    a = spark.createDataFrame([(1, "1.50"), (2, "x"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "1.5"), (2, " x "), (3, "y")], "k int, v string")
    assert one(validation.values(a, b, ["k"], ["v"])).discrepancies == 1
    assert one(validation.foreign_keys(spark.createDataFrame([(1,), (None,)], "f int"), "f", a, "k")).discrepancies == 1
    groups = spark.createDataFrame([("g", "a"), ("g", "b")], "group string, member string")
    assert one(validation.membership(groups, groups.withColumn("group", F.lit("h")))).status == "PASS"
    assert one(validation.verdict(validation.gate([validation.unique(a, ["k"]), validation.values(a, b, ["k"], ["v"])]))).status == "FAIL"


# --- scale, evaluation, privacy --------------------------------------------------------------------------------------


def test_scale_kernel(spark):
    n = 64
    rows = spark.createDataFrame([(f"row-{i:04d}", f"customer-{i % 5}", i + 1, f"fd-{i % 2}", "left" if i < n // 2 else "right", [f"b{i % 8}"]) for i in range(n)], "ref string, key string, measure int, lhs string, rhs string, blocks array<string>")
    for count in (1, 4, 9):
        routed = rows.withColumn("partition", scale.route("HASH", F.col("key"), count, 3))
        whole = one(scale.merged(scale.partial(routed, "measure")))
        assert (whole.rows, int(whole.total)) == (n, n * (n + 1) // 2)
    assert scale.fd_violations(rows, "lhs", "rhs").count() == 2
    assert scale.block_pairs(rows, "ref", "blocks", 100).count() == 8 * 28
    with pytest.raises(scale.ScaleError, match="LARGE_JOIN_FANOUT"):
        scale.block_pairs(rows, "ref", "blocks", 10)
    assert one(scale.skew(rows.withColumn("partition", F.lit(0)), 4)).status == "SKEWED"
    assert one(scale.skew(rows.limit(0).withColumn("partition", F.lit(0)), 4)).status == "EMPTY"
    assert scale.hash_sample(rows, "ref", 1.0, 5).count() == 5


def test_metrics(spark):
    rows = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "b", 0, 0.8), ("q", "c", 1, 0.7), ("lone", "d", 1, 0.1), ("none", "e", 0, 0.3), ("none", "f", 0, 0.2)], "query string, item string, label int, score double")
    r = one(evaluation.ranking(rows, (1, 3)))
    assert (r.eligible, r.mrr, r.recall_1, r.recall_3) == (1, 1.0, 0.5, 1.0) and 0.9 < r.ndcg_3 < 0.95
    ap = {x.query: x.average_precision for x in evaluation.average_precision(rows).collect()}
    assert ap["q"] == (1 + 2 / 3) / 2 and ap["none"] is None
    c = one(evaluation.classification(spark.createDataFrame([(0, 0)], "truth int, predicted int")))
    assert (c.tn, c.precision, c.recall, c.f1) == (1, None, None, None)
    assert evaluation.group_bootstrap({"a": 1.0}, 1)["status"] == "INSUFFICIENT_GROUPS_FOR_INTERVAL"
    assert evaluation.grouped_split(rows, "query").select("split").distinct().count() == 3


def test_privacy(spark):
    v = spark.createDataFrame([("a@b.example",), ("+1 555 010 101",), ("plain",), (None,)], "v string")
    rows = v.select(privacy.category(F.col("v")).alias("c"), privacy.state(F.col("v")).alias("s"), privacy.masked(F.col("v"), privacy.category(F.col("v"))).alias("m")).collect()
    assert [r.c for r in rows] == ["EMAIL", "PHONE", None, None] and rows[2].s == "UNKNOWN" and [r.m for r in rows] == ["<REDACTED_EMAIL>", "<REDACTED_PHONE>", "<REDACTED>", None]
    with pytest.raises(ValueError, match="KEY_UNAVAILABLE"):
        privacy.pseudonym(F.col("v"), None, "s")
    log = one(spark.range(1).select(privacy.sanitized(F.lit("x password=abc y")).alias("l"))).l
    assert log == "x <REDACTED_SECRET> y"
    assert one(spark.range(1).select(privacy.exposure(F.lit("UNKNOWN"), "EXTERNAL_PROCESSING").alias("e"))).e == "BLOCK"


# --- budgets, reviews, reads ----------------------------------------------------------------------------------------


def test_bootstrap_intervals(spark):
    rows = spark.createDataFrame([(g, float(g % 7) + d) for g in range(60) for d in (0.0, 1.0)] + [(None, 9.0)], "g int, v double")
    got, again = (one(evaluation.mean_interval(rows.repartition(n), "g", "v", 3, 300)) for n in (2, 7))
    want = sum(g % 7 + 0.5 for g in range(60)) / 60
    assert abs(got.point - want) < 1e-9 and got.groups == 60 and (got.lower, got.upper) == (again.lower, again.upper)
    spread = 1.96 * (sum((g % 7 + 0.5 - want) ** 2 for g in range(60)) / 60 / 60) ** 0.5
    assert got.lower < want < got.upper and 0.7 < (got.upper - got.lower) / (2 * spread) < 1.3
    assert one(evaluation.mean_interval(rows.limit(0), "g", "v")).status == "INSUFFICIENT_GROUPS_FOR_INTERVAL"


def test_searches_tell_what_their_budget_cut_off(spark):
    rows = spark.createDataFrame([(i, i % 4, i // 4, i % 2, None if i == 3 else i) for i in range(16)], "a int, b int, c int, d int, e int")
    whole = dependencies.search_unique(rows.drop("e"))
    assert {r.columns for r in whole.found.collect()} == {"a", "b,c"} and whole.state == "COMPLETE" and whole.implied > 0
    cut = dependencies.search_unique(rows.drop("e"), budget=dependencies.Budget(columns=3, sets=3, candidates=1))
    assert cut.state == "PARTIAL" and [t.split(":")[0] for t in cut.truncated] == ["MAX_COLUMNS", "MAX_SETS"] and cut.counted == 3
    keys = dependencies.identity_candidates(rows, "s", "t", dependencies.search_unique(rows, budget=dependencies.Budget(arity=1))).collect()
    assert [(r.columns, r.nulls, r.state) for r in keys] == [("a", 0, "REVIEW_REQUIRED"), ("e", 1, "INCOMPLETE_NULL_KEYS")]


def test_records_and_pairs_have_bounds(spark):
    rows = spark.createDataFrame([("r1", "s", "x"), ("r1", "s", "x"), ("r2", "t", "x"), ("r3", "t", "x")], "record_ref string, source_id string, name string")
    assert entity_resolution.load(rows).count() == 3
    for bad, code in ((("r1", "s", "y"), "RECORD_REFERENCE_COLLISION"), ((None, "s", "y"), "RECORD_WITHOUT_REFERENCE")):
        with pytest.raises(ValueError, match=code):
            entity_resolution.load(rows.unionByName(spark.createDataFrame([bad], rows.schema)))
    spec = entity_resolution.Spec((entity_resolution.Comparison("name"),), (("name",),), max_pairs=2)
    with pytest.raises(ValueError, match="PAIR_BUDGET_EXCEEDED"):
        entity_resolution.resolve(rows, spec)


def test_reviews_are_of_their_evidence(spark):
    schema = "subject string, metric string, value double, direction string, evidence_id string, scope string, family string"
    rows = spark.createDataFrame([("s", "inclusion_coverage", 1.0, "SUPPORTS", "e1", "FULL", "DEPENDENCY"), ("s", "target_uniqueness", 0.5, "CONTRADICTS", "e2", "FULL", "DEPENDENCY"), ("s", "declared_foreign_key", 1.0, "SUPPORTS", "e3", "FULL", "DECLARED")], schema)
    before, after = one(fusion.decisions(rows)), one(fusion.decisions(rows.where("evidence_id <> 'e3'")))
    assert (before.state, before.missing, before.conflicts) == ("INCOMPLETE_REQUIRED_EVIDENCE", ["dimension:type_compatibility"], ["DECLARED_DATA_CONFLICT"]) and before.band == "CONFLICTED"
    assert before.contradicts == ["e2 value=0.500000 dimension=target_uniqueness"] and before.fingerprint != after.fingerprint
    reviews = spark.createDataFrame([("s", before.fingerprint, "ACCEPTED"), ("gone", "x", "REJECTED")], "subject string, fingerprint string, decision string")
    assert {r.subject: r.state for r in fusion.stale_reviews(reviews, fusion.decisions(rows)).collect()} == {"s": "CURRENT", "gone": "SUBJECT_GONE"}
    assert {r.subject: r.state for r in fusion.stale_reviews(reviews, fusion.decisions(rows.where("evidence_id <> 'e3'"))).collect()}["s"] == "STALE"
    with pytest.raises(ValueError, match="EVIDENCE_COLLISION"):
        fusion.deduplicated(rows.unionByName(rows.where("evidence_id = 'e1'").withColumn("value", F.lit(0.5))))
    with pytest.raises(ValueError, match="UNKNOWN_EVIDENCE_FAMILY"):
        fusion.signals_of(rows, "RUMOUR", F.col("metric"), F.col("value"))


def test_large_clusters_have_no_entity(spark):
    clusters = spark.createDataFrame([(1, f"r{i}", "CANDIDATE_CLUSTER") for i in range(6)] + [(2, "x", "CANDIDATE_CLUSTER")], "cluster int, record_ref string, decision string")
    edges = spark.createDataFrame([(f"r{i}", f"r{i + 1}") for i in range(5)], "l string, r string")
    got = canonical.memberships(clusters, edges, "k", 5).collect()
    assert {(r.cluster, r.state, r.canonical_ref is None) for r in got} == {(1, "REVIEW_REQUIRED", True), (2, "PROPOSED", False)}
    kept = canonical.memberships(clusters, edges, "k").collect()
    assert len({r.canonical_ref for r in kept if r.cluster == 1}) == 1 and all(r.state == "PROPOSED" for r in kept)


def test_published_tables_know_their_source(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    rows.write.parquet(str(tmp_path / "source"))
    mark = files.source_mark(spark, str(tmp_path / "source"))
    star.publish({"t": rows}, str(tmp_path / "star"), mark)
    assert star.read_published(spark, str(tmp_path / "star"), "t", mark).count() == 1 and files.source_mark(spark, str(tmp_path / "source")) == mark
    rows.write.mode("append").parquet(str(tmp_path / "source"))
    with pytest.raises(star.StarError, match="STALE_TARGET"):
        star.read_published(spark, str(tmp_path / "star"), "t", files.source_mark(spark, str(tmp_path / "source")))
    read = files.explained(spark.read.parquet(str(tmp_path / "source")).where("k = 1").select("k"), 5)
    assert read["columns"] == read["read"] == ["k"] and any("EqualTo(k,1)" in f for f in read["filters"]) and not read["representative"]


def test_models_follow_from_stars(spark):
    dims = {"date": spark.createDataFrame([], "date_key long, canonical_ref string, full_date date, year int"), "shop": spark.createDataFrame([], "shop_key long, canonical_ref string, name string")}
    build = lambda **k: semantic.build_model(dims, "f", "fact_f", {"shop_key": "shop"}, {"sold": "sold_key"}, {"units": ("units", semantic.ADDITIVE, "SUM(units)"), "level": ("level", semantic.SEMI_ADDITIVE, "MAX(level)"), "ratio": ("ratio", semantic.NON_ADDITIVE, "AT GRAIN"), "rows": (None, semantic.ADDITIVE, "")}, **k)
    model = build(hierarchies={"date": ("year", "full_date")})
    assert [(m.id, m.operations) for m in model.facts[0].metrics] == [("units", ("SUM",)), ("level", ("MAX",)), ("rows", ("COUNT",))]
    assert [(a.id, a.type, a.exposed) for a in model.dimensions[0].attributes] == [("date.canonical_ref", "STRING", False), ("date.full_date", "DATE", True), ("date.year", "INTEGER", True)]
    with pytest.raises(semantic.SemanticError, match="UNKNOWN_HIERARCHY_LEVEL"):
        build(hierarchies={"date": ("week",)})


def test_one_sided_rows_are_discrepancies(spark):
    a, b = (spark.createDataFrame([(k, 1.0) for k in ks], "k int, v double") for ks in ((1, 2, 3), (2, 3, 4, 5)))
    assert one(validation.values(a, b, ["k"], ["v"])).discrepancies == 3 and one(validation.fact_count(a, b)).discrepancies == 1
    assert validation.monetary_status(["units", "gmv"], ["gmv", "revenue"]) == ("NOT_VALIDATED", ["gmv"]) and validation.monetary_status(["units"], ["gmv"]) == ("VALIDATED", [])
