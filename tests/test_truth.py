"""Truth from staged text, checks of canonical events, guards, the mapping policy and histories."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import fusion, reviews, star, truth, validation

SUBJECT = truth.Subject("order", ("k",), "v", "d")


def told(spark, rows):
    return truth.records(spark.createDataFrame(rows, "k string, v string, d string"), SUBJECT, "s", "s1")


def test_records_say_what_they_cannot_read(spark):
    rows = [("1", "2.50", "1995-01-02"), (" 2 ", " +3 ", "1995-01-02 00:00:00"), (None, "1", "1995-01-02"), ("  ", "1", "1995-01-02"), ("3", "x", "1995-01-02"), ("4", None, "1995-01-02"),
            ("5", "1", "1995-02-30"), ("6", "1", None), ("7", "1", "1995-01-03"), ("7", "1", "1995-01-03"), ("8", "1e2", "1995-01-04"), ("9", "NaN", "1995-01-04"), ("7", "bad", "1995-01-03")]
    got = sorted((r.k or "", r.reason or "", r.disposition) for r in told(spark, rows).collect())
    want = [("", "NO_GRAIN:k"), ("", "NO_GRAIN:k"), ("1", ""), ("2", ""), ("3", "UNREADABLE:v"), ("4", "UNREADABLE:v"), ("5", "UNREADABLE:d"), ("6", "UNREADABLE:d"), ("7", "REPEATED_GRAIN"), ("7", "REPEATED_GRAIN"), ("7", "UNREADABLE:v"), ("8", ""), ("9", "UNREADABLE:v")]
    assert got == sorted((k, r, "UNRESOLVED" if r else truth.DIRECT) for k, r in want)
    sums = {r.slice: float(r.value) for r in truth.expectations(told(spark, rows), SUBJECT).collect()}
    assert sums == {"global": 105.5, "1995-01-02": 5.5, "1995-01-04": 100.0}
    books = truth.accounting(told(spark, rows))
    assert books.where("boundary = 'CANONICAL_TO_ANALYTICAL'").count() == 3 and books.where("output IS NULL").count() == 10
    first = {r.output for r in books.where("boundary = 'SOURCE_TO_CANONICAL' AND output IS NOT NULL").collect()}
    assert first == {r.input for r in books.where("boundary = 'CANONICAL_TO_ANALYTICAL'").collect()}


def test_truth_of_nothing(spark):
    none = told(spark, [])
    assert [(r.slice, r.value) for r in truth.expectations(none, SUBJECT).collect()] == [("global", None)]
    observed = spark.createDataFrame([], "k string, v decimal(18,2), d date")
    assert {r.status for r in truth.checks(none, SUBJECT, observed).collect()} == {"PASS"}
    one = spark.createDataFrame([("1", "1", "1995-01-01")], "k string, v string, d string").select("k", F.col("v").cast("decimal(18,2)"), F.col("d").cast("date"))
    found = {r.check: r.discrepancies for r in truth.checks(none, SUBJECT, one).collect()}
    assert found == {"fact_count": 1, "grain:missing": 0, "grain:extra": 1, "values": 1, "truth:sum": 1, "truth:sum_by_day": 1}


def test_snapshot_universe(spark):
    records = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], "source string, snapshot string")
    pin = lambda *rows: spark.createDataFrame(list(rows), "source string, snapshot string, schema string")
    bad = lambda r, p: validation.snapshot_universe(r, p).first().discrepancies
    fine = (("a", "1", "x"), ("b", "1", "y"))
    assert bad(records, pin(*fine)) == 0
    assert bad(records, pin(fine[0])) == 1 and bad(records, pin(*fine, ("c", "1", "z"))) == 1
    assert bad(records, pin(fine[0], ("b", "1", None))) == 1 and bad(records, pin(*fine, ("b", "2", "y"))) == 1
    assert bad(records.unionByName(spark.createDataFrame([("a", None), ("b", "2")], records.schema)), pin(*fine)) == 2


def test_events_and_relationships(spark):
    events = spark.createDataFrame([(i, f"e{i}", "order") for i in range(6)], "record_ref long, entity string, type string")
    maps = spark.createDataFrame([(0, "e0", "order"), (1, "e9", "order"), (2, "e2", "quote"), (3, "e3", "order"), (4, "e4", "order")], events.schema)
    instances = spark.createDataFrame([("e0", "EVENT"), ("e1", "EVENT"), ("e2", "EVENT"), ("e3", "ENTITY"), ("e5", "EVENT")], "entity string, kind string")
    got = {r.record_ref: r.reason for r in validation.event_errors(events, maps, instances).collect()}
    assert got == {1: "ANOTHER_ENTITY", 2: "ANOTHER_TYPE", 3: "NOT_AN_EVENT", 4: "NO_INSTANCE", 5: "NO_MAP"}
    needed, declared = (spark.createDataFrame(rows, "relationship string") for rows in ([("r",), ("r",), ("q",)], [("q",), ("z",)]))
    assert validation.event_relationships(events, maps, instances, needed, declared).first().discrepancies == 6
    nothing = validation.event_relationships(events.limit(0), maps, instances, declared.limit(0), declared).first()
    assert (nothing.status, nothing.discrepancies) == ("NOT_EVALUATED", 0)


def test_merges_and_counts(spark):
    groups = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", 4), ("z", 5), ("z", 6)], "entity string, record_ref long")
    maps = spark.createDataFrame([(1, "x", "CONSOLIDATED"), (2, "x", "CONSOLIDATED"), (3, "y", "CONSOLIDATED"), (4, "w", "CONSOLIDATED"), (5, "z", "EMITTED_DIRECT"), (6, "z", "CONSOLIDATED"), (7, "z", "CONSOLIDATED"), (8, "w", "CONSOLIDATED")], "record_ref long, entity string, disposition string")
    got = {(r.entity, r.reason) for r in validation.unexplained_merges(groups, maps).collect()}
    assert got == {("y", "MEMBER_ELSEWHERE"), ("z", "MEMBER_NOT_CONSOLIDATED"), ("z", "MEMBER_TOO_MANY")}
    a = spark.createDataFrame([("t", 1), ("t", 2), ("u", 1), ("v", 1)], "type string, entity long")
    b = spark.createDataFrame([("t", 1), ("t", 1), ("u", 5), ("w", 1)], "type string, entity long")
    assert {tuple(r) for r in validation.entity_counts(a, b).collect()} == {("t", 2, 1), ("v", 1, 0), ("w", 0, 1)}


def guard_rows(spark, **changes):
    base = {"checkpoint": "REVIEW_ANALYTICAL_PLAN", **dict.fromkeys(reviews.FIELDS, "1"), "schemas": {"a": "1", "b": "2"}, "assertions": ["x", "y"], "skip_authorization": None, "verdict": "ACCEPTED", "superseded": False, "invalidation_reason": None}
    types = {c: "string" for c in base} | {"schemas": "map<string,string>", "assertions": "array<string>", "superseded": "boolean"}
    row = base | changes
    given = spark.createDataFrame([("r", *[row[c] for c in reviews.GIVEN])], ", ".join(["review string", *[f"{c} {types[c]}" for c in reviews.GIVEN]]))
    asked = spark.createDataFrame([("g", "r", *[base[c] for c in reviews.SCOPE])], ", ".join(["guard string", "review string", *[f"{c} {types[c]}" for c in reviews.SCOPE]]))
    return asked, given


@pytest.mark.parametrize(
    ("changes", "reasons"),
    [
        ({}, []),
        ({"assertions": ["y", "x"], "schemas": {"b": "2", "a": "1"}}, []),
        ({"checkpoint": "REVIEW_EVIDENCE_DECISIONS", "model_version": None}, ["WRONG_REVIEW_CHECKPOINT", "MISMATCH_MODEL_VERSION"]),
        ({"schemas": {"a": "1"}, "assertions": None}, ["MISMATCH_SOURCE_SCHEMA_FINGERPRINTS", "MISMATCH_DOMAIN_ASSERTION_SCOPE"]),
        ({"verdict": "SKIPPED", "skip_authorization": "p"}, ["SKIP_POLICY_NOT_AUTHORIZED"]),
        ({"verdict": None, "superseded": None}, ["DECISION_NOT_SATISFYING_GUARD"]),
        ({"superseded": True}, ["DECISION_INVALIDATED_OR_SUPERSEDED"]),
        ({"invalidation_reason": "new data"}, ["DECISION_INVALIDATED_OR_SUPERSEDED"]),
    ],
)
def test_guards(spark, changes, reasons):
    asked, given = guard_rows(spark, **changes)
    assert reviews.held(asked, given).first().reasons == reasons


def test_guards_without_one_review(spark):
    asked, given = guard_rows(spark)
    assert [r.reason for r in reviews.refusals(asked, given.limit(0)).collect()] == ["REVIEW_MISSING"]
    assert [r.reason for r in reviews.refusals(asked, given.unionByName(given)).collect()] == ["REVIEW_REPEATED"]
    why = spark.createDataFrame([("r", "stale")], "review string, reason string")
    closed = reviews.held(asked, reviews.invalidated(given, why)).first().reasons
    assert closed == [reviews.SUPERSEDED] and reviews.invalidated(given, why).columns == given.columns
    with pytest.raises(ValueError, match="INVALIDATION_WITHOUT_REASON"):
        reviews.invalidated(given, why.withColumn("reason", F.lit(" ")))


def test_mapping_needs_a_matcher(spark):
    pairs = spark.createDataFrame([("m",)], "subject string")
    types = fusion.signals_of(pairs, "SCHEMA_MATCHING", F.lit("type_compatibility"), F.lit(1.0))
    rank = fusion.signals_of(pairs, "SCHEMA_MATCHING", F.lit("matcher_rank:cupid"), F.lit(1.0))
    decide = lambda s: fusion.decisions(s, fusion.MAPPING, one_of=fusion.MAPPING_MATCHERS).first()
    assert decide(types).missing == ["dimension:matcher:coma:rank|matcher:cupid:rank"]
    found = decide(types.unionByName(rank))
    assert found.missing == [] and abs(found.score - (0.5 + 0.75) / 1.75) < 1e-9


def test_histories_are_refused(spark):
    rows = spark.createDataFrame([("1",)], "k string")
    assert star.build_dimension(rows, "k", F.col("k"), {}).rows.count() == 1
    for mode, args, code in (("TYPE2_PREPARED", {}, "HISTORY_COLUMNS_MISSING"), ("TYPE2_PREPARED", {"columns": ("a", "b", "c")}, "HISTORY_NOT_SUPPORTED"), ("TYPE1_SNAPSHOT", {"overwrite": False}, "SNAPSHOT_MUST_OVERWRITE"), ("TYPE3", {}, "UNKNOWN_HISTORY_MODE")):
        with pytest.raises(star.StarError, match=code):
            star.history_mode(mode, **args)
    with pytest.raises(star.StarError, match="HISTORY_COLUMNS_MISSING"):
        star.build_dimension(rows, "k", F.col("k"), {}, history="TYPE2_PREPARED")
