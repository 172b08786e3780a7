"""What only large tables show: limits that cut results, and work that grows faster than its rows."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import expressions as ex
from tessera.operators import dependencies, entity_resolution, hypotheses, inclusions, star, structure, validation
from tessera.queries import ORACLES, QUERIES
from tessera.queries_discovery import side_edges


@pytest.mark.parametrize("name", ["fusion_decisions", "fusion_families"])
def test_evidence_of_a_profile_with_many_distinct_values(spark, tmp_path, name):
    """Over 100,000 customers have orders; the profile of their keys is evidence all the same."""
    n = 100_500
    spark.range(n).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).select(F.col("id").alias("l_orderkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(25).select(F.col("id").alias("s_suppkey"), F.col("id").cast("int").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    answer = con.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    want = sorted(answer.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want


def shuffled_rows(frames):
    """The plans' exchanges as text, with what they carry."""
    return [df._jdf.queryExecution().executedPlan().toString() for df in frames]


def test_distinct_counts_shuffle_values_and_no_digests(spark, monkeypatch):
    seen = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (seen.append(self), collect(self))[1])
    rows = spark.createDataFrame([(1, 2, "a"), (1, 3, "a"), (2, 3, None), (2, 3, None)], "a long, b long, c string")
    assert dependencies.distinct_counts(rows, [("a",), ("a", "b"), ("b", "c"), ("c",)], together=3) == {("a",): 2, ("a", "b"): 3, ("b", "c"): 3, ("c",): 2}
    assert all("sha2" not in p and "Generate explode" not in p for p in shuffled_rows(seen))


def test_inclusions_shuffle_bits_and_no_sets(spark, monkeypatch):
    seen = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (seen.append(self), collect(self))[1])
    # more sequences than one number has bits
    wide = spark.createDataFrame([tuple(i + j for j in range(40)) for i in range(30)], ", ".join(f"a{j} int" for j in range(40)))
    other = spark.createDataFrame([tuple(i + j for j in range(40)) for i in range(60)], ", ".join(f"b{j} bigint" for j in range(40)))
    found = inclusions.search_inclusions({"wide": wide, "other": other}, 1).found.collect()
    assert {(r.left, r.right) for r in found} == {(f"wide(a{i})", f"other(b{j})") for i in range(40) for j in range(40) if j <= i <= j + 30}
    assert all("collect_set" not in p and "sha2" not in p for p in shuffled_rows(seen))
    pairs = dependencies.inclusion_candidates({"wide": wide, "other": other})
    assert {(r.left, r.right) for r in pairs.collect()} == {(f"wide.a{i}", f"other.b{j}") for i in range(40) for j in range(40) if j <= i <= j + 30}


def test_copies_of_a_common_keys_records_are_bounded(spark):
    """A tile of one record would send each of 300 records to 301 tiles."""
    keyed = spark.range(300).select(F.lit("common").alias("key"), F.struct("id").withField("ref", F.col("id")).alias("cells"))
    left, right = entity_resolution.tiled(keyed, 1)
    assert left.count() + right.count() <= 300 * (entity_resolution.GROUPS + 1)
    spec = entity_resolution.Spec((entity_resolution.Comparison("key"),), (("key",),), mode="LINK_AND_DEDUPE", tile=1)
    records = keyed.select("key", F.col("cells.ref").alias("record_ref"), F.lit("s").alias("source_id"))
    pairs = entity_resolution.candidate_pairs(records, spec)
    assert pairs.count() == pairs.select("l", "r").distinct().where("l < r").count() == 300 * 299 // 2


def test_distances_beyond_the_last_limit_are_not_worked_out(spark):
    c = entity_resolution.Comparison("n", "levenshtein", (1, 2))
    rows = spark.createDataFrame([("abcdef", x) for x in ("abcdef", "abcdex", "abcdxy", "abcxyz", "", None)], "l_n string, r_n string")
    found = rows.select(entity_resolution.level(c).alias("v"))
    assert [r.v for r in found.collect()] == [3, 2, 1, 0, 0, None]
    assert "levenshtein(l_n" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and ", Some(2)" in plan


@pytest.mark.parametrize("ranges", [2, 64])
def test_quantiles_are_exact_and_no_task_holds_a_column(spark, ranges):
    rng = random.Random(3)
    data = [(rng.choice([None, rng.gauss(0, 1)]), rng.randrange(7) ** 3, None) for _ in range(2000)]
    rows = spark.createDataFrame(data, "a double, b int, c double")
    found = structure.quantile_sketches("t", rows, ranges=ranges)
    got = {r.column: r.quantiles for r in found.collect()}
    for i, name in enumerate("ab"):
        values = sorted(r[i] for r in data if r[i] is not None)
        assert got[f"t.{name}"] == [values[max(1, -(-len(values) * k // 32)) - 1] for k in range(33)]
    assert set(got) == {"t.a", "t.b"} and "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_facts_find_their_keys_without_a_shuffle(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        people = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id long, name string")
        dim = star.build_dimension(people, "customer", F.col("id"), {"name": F.col("name")}, check=False)
        facts = spark.createDataFrame([(i, i % 50) for i in range(200)], "k int, c int")
        good, bad = star.build_fact(facts, ["k"], [star.ForeignKey(F.col("c"), dim)], lineage="k")
        plan = good._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and good.count() == 200 and bad.count() == 0
        assert good.select("customer_key").exceptAll(facts.join(dim.rows, F.col("c").cast("string") == F.col("canonical_ref")).select("customer_key")).count() == 0
        # references that have no member, null ones, and members that stand twice, with and without the look-up
        odd = facts.unionByName(spark.createDataFrame([(201, 77), (202, None), (203, -1)], "k int, c int"))
        twice = star.build_dimension(people.unionByName(people.where("id = 7")), "customer", F.col("id"), {"name": F.col("name")}, check=False)
        for d in (dim, twice):
            for key in (star.ForeignKey(F.col("c"), d), star.ForeignKey(F.col("c"), d, required=False), star.ForeignKey(F.col("c"), d, "EXPLICIT_UNKNOWN_MEMBER"), star.ForeignKey(F.col("c"), d, "NULLABLE_FK", required=False)):
                got = [sorted(map(str, rows.collect())) for rows in star.build_fact(odd, ["k"], [key], lineage="k")]
                joined = star.ForeignKey(key.column, star.Dimension(d.name, d.key, d.rows), key.policy, key.required)
                assert got == [sorted(map(str, rows.collect())) for rows in star.build_fact(odd, ["k"], [joined], lineage="k")]
                assert len(got[0]) + len(got[1]) == (203 if d is dim else 207)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keys_of_plain_references_are_those_of_canonical_json(spark):
    rows = spark.createDataFrame([(0,), (-12,), (2**62,), (None,)], "n long").withColumn("d", F.date_add(F.lit("1999-12-30").cast("date"), F.coalesce(F.col("n") % 7, F.lit(0)).cast("int")))
    for c in ("n", "d"):
        text = F.col(c).cast("string")
        keys = rows.select(ex.surrogate_key("customer", text, plain=True).alias("a"), ex.surrogate_key("customer", text).alias("b")).collect()
        assert [r.a for r in keys] == [r.b for r in keys] and (c == "d" or keys[3].a is None)


def test_bindings_are_shuffled_once_for_their_decision(spark):
    bindings = spark.createDataFrame([("b1", "MAPPING", "d1", "r1", "a"), ("b2", "MAPPING", "d2", "r2", "a")], "binding string, kind string, decision string, review string, source string")
    decisions = spark.createDataFrame([("d1", "MAPPING", "REVIEW_REQUIRED", "f", "s")], "decision string, kind string, state string, fingerprint string, snapshot string")
    told = [("r1", "d1"), ("r2", "d2"), ("r3", "d2")]
    reviews = spark.createDataFrame([(r, hypotheses.CHECKPOINT, d, "ACCEPTED", False, "f", "s") for r, d in told], "review string, checkpoint string, decision string, verdict string, superseded boolean, fingerprint string, snapshot string")
    snapshots = spark.createDataFrame([("a", "s")], "source string, snapshot string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = hypotheses.judged(bindings, decisions, reviews, snapshots)
        plan = found._jdf.queryExecution().executedPlan().toString()
        own = re.search(r"\[binding#\d+,kind#\d+,(decision#\d+)", plan)[1]
        assert plan.count(f"Exchange hashpartitioning({own},") == 1
        # reviews of a decision that isn't known count, too
        assert {r.binding: [x.reason for x in r.refusals] for r in found.collect()} == {"b1": [], "b2": ["DECISION_UNKNOWN", "REVIEWED_TWICE"]}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_measures_of_the_same_slices_are_checked_in_one_pass(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key long, canonical_ref string")
    fact = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, None), (9, 1, 1)], "k long, q int, p int")
    expected = spark.createDataFrame([("a", 11, 7, 3), ("b", 7, 6, None), ("c", 1, 1, 1), ("<orphan>", 1, 1, 1)], "slice string, s int, m int, p int")
    slices, wanted = [("k", dim, "key")], [("s", "q", "sum"), ("m", "q", "max"), ("p", "p", "sum")]
    found = validation.aggregates_together(expected, fact, slices, wanted)
    assert [tuple(r) for r in found.collect()] == [("aggregate:sum:q", "FAIL", 1, "BLOCKING"), ("aggregate:max:q", "FAIL", 3, "BLOCKING"), ("aggregate:sum:p", "FAIL", 2, "BLOCKING")]
    for value, measure, operation in wanted:
        alone = validation.aggregates(expected.select("slice", F.col(value).alias("value")), fact, slices, measure, operation)
        assert alone.exceptAll(found).count() == 0 and alone.count() == 1


def test_the_sliced_query_reads_each_side_once(spark):
    plan = QUERIES["validate_sliced_aggregates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # the lines and the published facts
    assert plan.count("Join FullOuter") == 1 and plan.count("Relation [l_orderkey") == 2


def structure_tables(spark, folder, customers):
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(10, 1, 5.0, "F"), (11, 2, 6.0, "O"), (12, 2, 7.0, "O")], "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, "s1", 3, 0.0), (2, "s2", 4, 8.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(10, 1, -0.0, "F"), (11, 2, 8.0, "O")], "l_orderkey long, l_suppkey long, l_extendedprice double, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("key", [2, 3])
def test_references_are_to_columns_with_a_value_for_each_row(spark, tmp_path, key):
    """A customer's key that stands twice is none, though one of its rows lacks a balance; 0.0 and -0.0 are one value."""
    con = structure_tables(spark, tmp_path, [(1, "c1", 1, 1.0, "A"), (2, "c2", 1, 2.0, "A"), (key, "c3", 2, None, "B")])
    want = {(a, b): x for a, b, x in con.execute(ORACLES["match_structure"]).fetchall()}
    got = {(r.left, r.right): r.structure for r in QUERIES["match_structure"](spark, str(tmp_path)).collect()}
    assert got == want


def test_structure_shuffles_values_once(spark, tmp_path):
    def written():
        return spark._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    n = 20_000
    numbers = spark.range(n, numPartitions=4).select(F.xxhash64("id").alias("k"), F.xxhash64("id", F.lit(1)).cast("double").alias("v"))
    tables = {"a": numbers.select("k", "v"), "b": numbers.select(F.col("k").alias("k2"), F.col("v").alias("v2")).limit(10)}
    files = {}
    for t, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{t}")
        files[t] = spark.read.parquet(f"{tmp_path}/{t}")
    before = written()
    edges = side_edges(files).where("label = 'refers'").collect()
    assert {(r.source, r.target) for r in edges} == {("b.k2", "a"), ("b.v2", "a")}
    # two columns of 20,000 values of eight bytes with their bits, once
    assert written() - before < 2 * n * 18


@pytest.mark.parametrize("mode", ["LINK_ONLY", "DEDUPE_ONLY", "LINK_AND_DEDUPE"])
@pytest.mark.parametrize("together", ["true", "false"])
def test_partners_are_those_of_the_candidate_pairs(spark, mode, together):
    rng = random.Random(5)
    rows = [(rng.randrange(90), rng.choice(["a", "b", None]), rng.choice([None, "x", "x", "x", "y"]), rng.choice([None, 1, 2]), rng.choice("pq")) for _ in range(150)]
    rows += rows[:20] + [(None, "a", "x", 1, "p")]
    records = spark.createDataFrame(rows, "record_ref long, source_id string, name string, number int, other string")
    spec = entity_resolution.Spec((entity_resolution.Comparison("name"),), (("name",), ("number", "other"), ("other", "name")), mode=mode)

    def paired(a, b):
        known = mode == "LINK_AND_DEDUPE" or (a[1] and b[1] and (a[1] == b[1]) == (mode == "DEDUPE_ONLY"))
        return a[0] is not None and b[0] is not None and known and ((a[2] and a[2] == b[2]) or (a[3] and a[3:] == b[3:]))

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", together)
    try:
        got = {tuple(r)[:5]: (r.n, r.before, r.after) for r in entity_resolution.partners(records, spec).collect()}
        pairs = entity_resolution.candidate_pairs(records, spec).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for a in set(rows):
        want = (rows.count(a), sum(bool(paired(a, b) and b[0] < a[0]) for b in rows), sum(bool(paired(a, b) and b[0] > a[0]) for b in rows))
        assert got.get(a, (rows.count(a), 0, 0)) == want
    assert sum(n * after for n, _, after in got.values()) == sum(n * before for n, before, _ in got.values()) == pairs


def test_sums_over_the_pairs_of_a_common_block_make_no_pair(spark, tmp_path, monkeypatch):
    """Four fifths of the records are one block, of 51 billion pairs."""
    monkeypatch.setattr(entity_resolution, "tiled", lambda *_: pytest.fail("pairs are made"))
    n = 400_000
    spark.range(n).select((F.col("id") * 2 + (F.col("id") % 5 == 0).cast("int")).alias("c_custkey"), F.concat(F.lit("S"), F.col("id") % 5).alias("c_mktsegment"), (F.col("id") % 7).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.block: (r.pairs, r.mark) for r in QUERIES["er_tiles"](spark, str(tmp_path)).collect()}
    blocks = {}
    for i in range(n):
        k = i * 2 + (i % 5 == 0)
        blocks.setdefault("common" if k % 2 == 0 else f"S{i % 5}{i % 7}", []).append(k)
    assert len(blocks["common"]) > n // 2
    assert got == {b: (len(ks) * (len(ks) - 1) // 2, sum(k * (31 * (len(ks) - 1 - i) + i) for i, k in enumerate(ks))) for b, ks in blocks.items()}


@pytest.mark.parametrize(("rules", "longest", "tile"), [((("nation", "segment"), ("name",)), 40, 1 << 15), ((("name", "nation"), ("segment",), ("nation",)), 40, 8), ((("nation",), ("name",), ("segment", "nation")), 5, 8)])
def test_vectors_are_counted_as_those_of_the_pairs(spark, monkeypatch, rules, longest, tile):
    rng = random.Random(9)
    name = lambda: rng.choice([None, "", "ab😀", *["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(9)]])
    rows = [(f"r{i:03}", rng.choice(["a", "b", "b", "c", None]), name(), rng.choice([None, "s", "t"]), rng.choice([None, 1, 2]), rng.choice([0.0, float("nan"), None])) for i in range(240)]
    records = spark.createDataFrame(rows, "record_ref string, source_id string, name string, segment string, nation int, rate double")
    c = entity_resolution.Comparison
    spec = entity_resolution.Spec((c("segment"), c("name", "levenshtein", (1, 2)), c("nation"), c("rate")), rules)
    monkeypatch.setattr(entity_resolution.edits, "LONGEST", longest)
    monkeypatch.setattr(entity_resolution, "NEAR", tile)
    got = entity_resolution.vector_counts(records, spec)
    pairs = entity_resolution.with_levels(entity_resolution.candidate_pairs(records, spec), spec)
    names = ["v_segment", "v_name", "v_nation", "v_rate"]
    want = pairs.groupBy(*names).agg(F.count("*").alias("pairs"), F.min("l").alias("first_left"), F.max("r").alias("last_right"))
    assert got.columns == want.columns and {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and want.count() > 20
    # no text by edits, or one that isn't compared across sources: the pairs are made
    for other in (entity_resolution.Spec((c("segment"), c("nation")), (("segment",),)), entity_resolution.Spec(spec.comparisons, rules, mode="DEDUPE_ONLY")):
        some = entity_resolution.vector_counts(records.limit(60), other)
        assert some.agg(F.sum("pairs")).first()[0] == entity_resolution.candidate_pairs(records.limit(60), other).count()


def test_near_texts_are_those_of_a_plain_comparison(monkeypatch):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            fresh = [i]
            for j, y in enumerate(b, 1):
                fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
            row = fresh
        return row[-1]

    rng = random.Random(1)
    for most, step, letters in ((0, 300, "ab"), (1, 300, "abcdé😀"), (2, 300, "aab"), (2, 1 << 22, "0123456789"), (2, 300, "a")):
        monkeypatch.setattr(entity_resolution.edits, "STEP", step)
        left, right = (["".join(rng.choice(letters) for _ in range(rng.randrange(9))) for _ in range(n)] for n in (80, 60))
        tiles = [np.array([rng.randrange(2) for _ in texts]) for texts in (left, right)]
        got = [tuple(map(int, p)) for part in entity_resolution.edits.near(left, tiles[0], right, tiles[1], most) for p in zip(*part, strict=True)]
        want = {(i, j, distance(x, y)) for i, x in enumerate(left) for j, y in enumerate(right) if tiles[0][i] == tiles[1][j] and distance(x, y) <= most}
        assert len(got) == len(set(got)) and set(got) == want


def test_scores_of_a_common_block_make_few_pairs(spark, tmp_path, monkeypatch):
    """A block of 2000 and 1000 records: its two million pairs are counted by their scores, and few are made."""
    n = 2000
    spark.range(n).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", F.col("id") * 7).alias("c_name"), F.lit("S").alias("c_mktsegment"), F.lit(1).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    made = []
    pairs = entity_resolution.candidate_pairs
    monkeypatch.setattr(entity_resolution, "candidate_pairs", lambda *a, **k: (made.append(pairs(*a, **k)), made[-1])[1])
    got = {r.band: r for r in QUERIES["er_scored"](spark, str(tmp_path)).collect()}
    assert sum(df.count() for df in made) <= 2 * n
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(ORACLES["er_scored"]).fetchall()
    assert sum(r[1] for r in want) == n * n // 2 and len(want) == len(got)
    for band, count, weight, first, last in want:
        r = got[band]
        assert (r.pairs, r.first_left, r.last_right) == (count, first, last) and r.weight == pytest.approx(weight, abs=0.01)
