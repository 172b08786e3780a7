"""Queries that hold a star, reviews and evidence against what the sources say. tessera.queries loads them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fusion, matching, profiling, reviews, star, truth, validation
from tessera.operators.graph import shared_folder
from tessera.queries import dim_date, order_fact, query, relationship_evidence, table
from tessera.sources import files

ORDER = truth.Subject("order", ("o_orderkey",), "o_totalprice", "o_orderdate")
LINE = truth.Subject("line", ("l_orderkey", "l_linenumber"), "l_quantity", "l_shipdate")


def staged_text(rows: DataFrame) -> DataFrame:
    """All columns as staged text, held against their manifest."""
    manifest = files.stage(rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]), f"{shared_folder(rows.sparkSession)}/text-{uuid.uuid4().hex}")
    return files.read_staged(rows.sparkSession, manifest)


def order_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.records(staged_text(table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderdate"])), ORDER, "orders", "s1")


def published_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_orderstatus, o_totalprice, o_orderdate) of the facts in a star that is published for this."""
    folder = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    star.publish({"fact_order": order_fact(spark, sf_dir), "dim_date": dim_date(spark, sf_dir).rows}, folder)
    days = star.read_published(spark, folder, "dim_date").select("date_key", F.col("full_date").alias("o_orderdate"))
    facts = star.read_published(spark, folder, "fact_order").join(days, F.col("order_date_key") == F.col("date_key"), "left")
    return facts.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus", F.col("total").alias("o_totalprice"), "o_orderdate")


@query("""WITH e AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS slice, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1 UNION ALL SELECT 'global', sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders),
o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS slice, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT 'global', sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT slice, CAST(e.v AS DOUBLE) AS expected, CAST(o.v AS DOUBLE) AS observed, e.v IS NOT DISTINCT FROM o.v AS same FROM e FULL JOIN o USING (slice)""")
def truth_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of all orders and of each day, from staged text and from a published star."""
    found = truth.by_day(order_truth(spark, sf_dir), ORDER, published_orders(spark, sf_dir).select(F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("measure")))
    return found.withColumns({c: F.col(c).cast("double") for c in ("expected", "observed")})


@query("""WITH l AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey % 7 = 3 AS gone, o_orderstatus = 'F' AS r, CAST(o_totalprice AS DECIMAL(18,2)) AS q FROM orders),
days AS (SELECT d, sum(q) AS e, sum(q + r::INT) FILTER (WHERE NOT gone) AS o FROM l GROUP BY d),
n(name, v) AS (SELECT 'fact_count', count(*) FILTER (WHERE gone) FROM l UNION ALL SELECT 'grain:missing', count(*) FILTER (WHERE gone) FROM l UNION ALL SELECT 'grain:extra', 0 UNION ALL SELECT 'values', count(*) FILTER (WHERE gone OR r) FROM l
UNION ALL SELECT 'truth:sum', CAST(sum(e) IS DISTINCT FROM sum(o) AS BIGINT) FROM days UNION ALL SELECT 'truth:sum_by_day', count(*) FILTER (WHERE e IS DISTINCT FROM o) FROM days)
SELECT name AS "check", CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(v AS BIGINT) AS discrepancies FROM n""")
def truth_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star that lacks every seventh order and has one more in each filled order, against the truth."""
    broken = published_orders(spark, sf_dir).where("CAST(o_orderkey AS BIGINT) % 7 <> 3")
    broken = broken.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return truth.checks(order_truth(spark, sf_dir), ORDER, broken.drop("o_orderstatus")).select("check", "status", "discrepancies")


DAMAGED = """(SELECT l_orderkey, CASE WHEN l_linenumber <> 6 THEN l_linenumber END AS n, l_tax > 0.07 AS q, l_returnflag = 'A' AND l_linenumber = 1 AS d, 1 + (l_suppkey % 10 = 0)::INT AS copies FROM lineitem),
r AS (SELECT *, CASE WHEN n IS NULL THEN 'NO_GRAIN:l_linenumber' WHEN q THEN 'UNREADABLE:l_quantity' WHEN d THEN 'UNREADABLE:l_shipdate' WHEN sum(copies) FILTER (WHERE NOT q AND NOT d) OVER (PARTITION BY l_orderkey, n) > 1 THEN 'REPEATED_GRAIN' END AS reason FROM l)"""


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_tax", "l_returnflag", "l_suppkey"])
    rows = rows.unionByName(rows.where("l_suppkey % 10 = 0"))
    number = F.when(F.col("l_linenumber") != 6, F.col("l_linenumber"))
    quantity = F.when(F.col("l_tax") > 0.07, "n/a").otherwise(F.col("l_quantity").cast("string"))
    day = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), "1995-02-30").otherwise(F.col("l_shipdate").cast("string"))
    return staged_text(rows.select("l_orderkey", number.alias("l_linenumber"), quantity.alias("l_quantity"), day.alias("l_shipdate")))


@query(f"""WITH l AS {DAMAGED} SELECT CASE WHEN reason IS NULL THEN 'EMITTED_DIRECT' ELSE 'UNRESOLVED' END AS disposition, coalesce(reason, '') AS reason, CAST(sum(copies) AS BIGINT) AS records FROM r GROUP BY ALL""")
def truth_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of staged lines of which some can't be read, some lack their grain, and some stand twice."""
    told = truth.records(damaged_lines(spark, sf_dir), LINE, "lines", "s1")
    return told.groupBy("disposition", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("records"))


@query(f"""WITH l AS {DAMAGED} SELECT 'SOURCE_TO_CANONICAL' AS boundary, CASE WHEN reason IS NULL THEN 'EMITTED_DIRECT' ELSE 'UNRESOLVED' END AS disposition, CAST(sum(copies) AS BIGINT) AS inputs, CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS outputs FROM r GROUP BY ALL
UNION ALL SELECT 'CANONICAL_TO_ANALYTICAL', 'EMITTED_DIRECT', count(*), count(*) FROM r WHERE reason IS NULL""")
def truth_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and distinct outputs at both boundaries."""
    told = truth.accounting(truth.records(damaged_lines(spark, sf_dir), LINE, "lines", "s1"))
    return told.groupBy("boundary", "disposition").agg(F.count("*").alias("inputs"), F.countDistinct("output").alias("outputs"))


# --- checks of canonical events --------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT l_returnflag AS source, bool_and(NOT (l_returnflag = 'R' AND l_tax = 0)) AS one FROM lineitem GROUP BY 1), p(source, schema) AS (VALUES ('A', 'x'), ('R', 'x'), ('N', ' '), ('Z', 'x'))
SELECT 'snapshot_universe' AS "check", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS discrepancies FROM f FULL JOIN p USING (source) WHERE one IS NOT TRUE OR coalesce(trim(schema), '') = ''""")
def validate_snapshot_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three faults: records of another snapshot, a source without a schema, and one without records."""
    rows = table(spark, sf_dir, "lineitem", ["l_returnflag", "l_tax"])
    found = rows.select(F.col("l_returnflag").alias("source"), F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0), "s2").otherwise("s1").alias("snapshot"))
    pinned = spark.createDataFrame([("A", "s1", "x"), ("R", "s1", "x"), ("N", "s1", " "), ("Z", "s1", "x")], "source string, snapshot string, schema string")
    return validation.snapshot_universe(found, pinned).select("check", "status", "discrepancies")


EVENTS = """SELECT CASE WHEN o_orderstatus = 'P' THEN 'NO_MAP' WHEN o_orderkey % 11 = 0 THEN 'NO_INSTANCE' WHEN o_custkey % 10 = 0 THEN 'NOT_AN_EVENT' WHEN o_orderpriority = '5-LOW' THEN 'ANOTHER_ENTITY' WHEN o_orderpriority = '2-HIGH' THEN 'ANOTHER_TYPE' END AS reason, o_orderkey FROM orders"""


def order_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    ref, entity = F.col("o_orderkey").alias("record_ref"), F.concat(F.lit("order_"), "o_orderkey")
    other = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(entity, F.lit("x"))).otherwise(entity)
    kind = F.when(F.col("o_orderpriority") == "2-HIGH", "quote").otherwise("order")
    maps = o.where("o_orderstatus <> 'P'").select(ref, other.alias("entity"), kind.alias("type"))
    instances = o.where("o_orderkey % 11 <> 0").select(entity.alias("entity"), F.when(F.col("o_custkey") % 10 == 0, "ENTITY").otherwise("EVENT").alias("kind"))
    return o.select(ref, entity.alias("entity"), F.lit("order").alias("type")), maps, instances


@query(f"WITH e AS ({EVENTS}) SELECT reason, count(*) AS records, min(o_orderkey) AS first FROM e WHERE reason IS NOT NULL GROUP BY reason")
def validate_event_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why orders aren't the events that they should be."""
    return validation.event_errors(*order_events(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("records"), F.min("record_ref").alias("first"))


@query(f"""WITH e AS ({EVENTS}), m AS (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderkey < 200))
SELECT 'event_relationships' AS "check", CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n AS discrepancies FROM (SELECT (SELECT count(*) FROM e WHERE reason IS NOT NULL) + (SELECT count(*) FROM m) AS n)""")
def validate_event_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and relationships together: priorities stand for relationships, of which some are declared."""
    needed = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"]).withColumnRenamed("o_orderpriority", "relationship")
    declared = needed.where("o_orderstatus = 'P' AND o_orderkey < 200")
    return validation.event_relationships(*order_events(spark, sf_dir), needed, declared).select("check", "status", "discrepancies")


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS g, o_custkey + (o_orderpriority = '5-LOW')::INT AS m, o_orderstatus = 'P' AS lone FROM orders),
x AS (SELECT g AS entity, CASE WHEN m <> g THEN 'MEMBER_ELSEWHERE' WHEN lone THEN 'MEMBER_NOT_CONSOLIDATED' END AS reason FROM o WHERE g % 2 = 0 UNION ALL SELECT m, 'MEMBER_TOO_MANY' FROM o WHERE g % 2 = 1 AND m <> g AND m IN (SELECT g FROM o))
SELECT reason, count(DISTINCT entity) AS entities FROM x WHERE reason IS NOT NULL GROUP BY reason""")
def validate_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as consolidations that their maps don't all show."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    groups = o.where("o_custkey % 2 = 0").select(F.col("o_custkey").cast("long").alias("entity"), F.col("o_orderkey").alias("record_ref"))
    mapped = (F.col("o_custkey") + (F.col("o_orderpriority") == "5-LOW").cast("int")).cast("long")
    maps = o.select(F.col("o_orderkey").alias("record_ref"), mapped.alias("entity"), F.when(F.col("o_orderstatus") == "P", truth.DIRECT).otherwise("CONSOLIDATED").alias("disposition"))
    return validation.unexplained_merges(groups, maps).groupBy("reason").agg(F.countDistinct("entity").alias("entities"))


@query("""WITH e AS (SELECT p_type AS type, count(DISTINCT p_partkey) AS expected FROM part GROUP BY 1), o AS (SELECT p_type AS type, count(DISTINCT p_partkey) AS observed FROM part WHERE p_size > 3 OR p_type <> 'PROMO' GROUP BY 1)
SELECT type, expected, coalesce(observed, 0) AS observed FROM e LEFT JOIN o USING (type) WHERE expected <> coalesce(observed, 0)""")
def validate_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size"])
    observed = p.where("p_size > 3 OR p_type <> 'PROMO'")
    return validation.entity_counts(p.select(F.col("p_type").alias("type"), F.col("p_partkey").alias("entity")), observed.select(F.col("p_type").alias("type"), F.col("p_partkey").alias("entity")))


# --- reviews ---------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_orderkey AS review, CASE WHEN o_orderpriority = '5-LOW' THEN 'REVIEW_ANALYTICAL_PLAN' ELSE 'REVIEW_EVIDENCE_DECISIONS' END AS c, o_custkey % 20 AS h, CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'SKIPPED' ELSE 'REJECTED' END AS v, o_orderkey % 7 = 0 AS s FROM orders WHERE o_orderkey % 13 <> 0),
g AS (SELECT l_orderkey || '-' || l_linenumber AS guard, l_orderkey AS review, l_suppkey % 20 AS h, l_returnflag AS f, l_linestatus AS st FROM lineitem), j AS (SELECT g.guard, g.h AS gh, g.f, g.st, r.* FROM g LEFT JOIN r USING (review)),
x AS (SELECT guard, 'REVIEW_MISSING' AS reason FROM j WHERE review IS NULL OR c IS NULL UNION ALL SELECT guard, 'WRONG_REVIEW_CHECKPOINT' FROM j WHERE c <> 'REVIEW_EVIDENCE_DECISIONS' UNION ALL SELECT guard, 'MISMATCH_SUBJECT_CONTENT_HASH' FROM j WHERE h <> gh
UNION ALL SELECT guard, 'MISMATCH_SOURCE_SCHEMA_FINGERPRINTS' FROM j WHERE c IS NOT NULL AND f = 'N' UNION ALL SELECT guard, 'MISMATCH_DOMAIN_ASSERTION_SCOPE' FROM j WHERE c IS NOT NULL AND st = 'O' UNION ALL SELECT guard, 'DECISION_NOT_SATISFYING_GUARD' FROM j WHERE v = 'REJECTED'
UNION ALL SELECT guard, 'SKIP_POLICY_NOT_AUTHORIZED' FROM j WHERE v = 'SKIPPED' AND f <> 'R' UNION ALL SELECT guard, 'DECISION_INVALIDATED_OR_SUPERSEDED' FROM j WHERE s)
SELECT reason, count(*) AS guards, min(guard) AS first FROM x GROUP BY reason""")
def review_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why guards stay closed: lines as guards that present their order as a review."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"]).where("o_orderkey % 13 <> 0")
    same = {f: F.lit("1") for f in reviews.FIELDS if f != "subject_content_hash"}
    schemas = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    given = same | {
        "checkpoint": F.when(F.col("o_orderpriority") == "5-LOW", "REVIEW_ANALYTICAL_PLAN").otherwise("REVIEW_EVIDENCE_DECISIONS"),
        "subject_content_hash": F.sha2((F.col("o_custkey") % 20).cast("string"), 256),
        "schemas": schemas,
        "assertions": F.array(F.lit("x"), F.lit("y")),
        "skip_authorization": F.lit("skip-1"),
        "verdict": F.when(F.col("o_orderstatus") == "F", "ACCEPTED").when(F.col("o_orderstatus") == "O", "SKIPPED").otherwise("REJECTED"),
        "superseded": F.col("o_orderkey") % 7 == 0,
        "invalidation_reason": F.lit(None).cast("string"),
    }
    decisions = o.select(F.col("o_orderkey").alias("review"), *[given[c].alias(c) for c in reviews.GIVEN])
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus"])
    asked = same | {
        "checkpoint": F.lit("REVIEW_EVIDENCE_DECISIONS"),
        "subject_content_hash": F.sha2((F.col("l_suppkey") % 20).cast("string"), 256),
        "schemas": F.when(F.col("l_returnflag") == "N", F.create_map(F.lit("a"), F.lit("1"))).otherwise(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))),
        "assertions": F.when(F.col("l_linestatus") == "O", F.array(F.lit("x"))).otherwise(F.array(F.lit("y"), F.lit("x"))),
        "skip_authorization": F.when(F.col("l_returnflag") == "R", "skip-1"),
    }
    guards = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("guard"), F.col("l_orderkey").alias("review"), *[asked[c].alias(c) for c in reviews.SCOPE])
    return reviews.refusals(guards, decisions).groupBy("reason").agg(F.count("*").alias("guards"), F.min("guard").alias("first"))


# --- evidence of all families ----------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT 'rel:orders.o_custkey->customer.c_custkey' AS subject, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))::DOUBLE / (SELECT count(DISTINCT o_custkey) FROM orders) AS c, (SELECT count(DISTINCT c_custkey)::DOUBLE / count(*) FROM customer) AS u, 6 AS families
UNION ALL SELECT 'rel:lineitem.l_orderkey->orders.o_orderkey', (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem), (SELECT count(DISTINCT o_orderkey)::DOUBLE / count(*) FROM orders), 2
UNION ALL SELECT 'rel:customer.c_nationkey->supplier.s_nationkey', (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier))::DOUBLE / (SELECT count(DISTINCT c_nationkey) FROM customer), (SELECT count(DISTINCT s_nationkey)::DOUBLE / count(*) FROM supplier), 4),
s AS (SELECT *, subject NOT LIKE 'rel:line%' AS declared, families > 2 AS hypothesis, c < 1 OR u < 1 AS against FROM m), t AS (SELECT *, concat_ws(',', CASE WHEN declared AND against THEN 'DECLARED_DATA_CONFLICT' END, CASE WHEN hypothesis AND against THEN 'SEMANTIC_STRUCTURAL_CONFLICT' END) AS conflicts,
round((round(c, 12) + round(CASE WHEN u < 1 THEN -u ELSE u END, 12) + 0.75 + declared::INT) / (2.75 + declared::INT), 9) AS score FROM s)
SELECT subject, score, CASE WHEN conflicts <> '' THEN 'CONFLICTED' WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS band, CASE WHEN families = 6 THEN 'REVIEW_REQUIRED' ELSE 'INCOMPLETE_REQUIRED_EVIDENCE' END AS state,
CASE families WHEN 6 THEN '' ELSE 'producer:profile,producer:quality' END AS missing, conflicts, CAST(CASE families WHEN 6 THEN 4 WHEN 4 THEN 2 ELSE 0 END AS INTEGER) AS silent FROM t""")
def fusion_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on three relationships from dependency, declared, profile, quality, learned, semantic and asserted evidence."""
    o, c = table(spark, sf_dir, "orders", ["o_custkey"]), table(spark, sf_dir, "customer", ["c_custkey"])
    first, third = "rel:orders.o_custkey->customer.c_custkey", "rel:customer.c_nationkey->supplier.s_nationkey"
    spread = profiling.spread(o, ["o_custkey"], limit=None).withColumn("subject", F.lit(first))
    valid = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").agg((F.count("c_custkey") / F.count("*")).alias("ratio")).withColumn("subject", F.lit(first))
    declared = spark.createDataFrame([(first, 1.0), (third, 1.0)], "subject string, value double")
    told = [
        fusion.signals_of(declared, "DECLARED", F.lit("declared_foreign_key"), F.col("value")),
        fusion.signals_of(spread, "PROFILE", F.lit("distinct_ratio"), F.col("distinct_ratio")),
        fusion.signals_of(valid, "QUALITY", F.lit("quality_ratio"), F.col("ratio")),
        fusion.signals_of(spread, "ML", F.lit("ranker_score"), F.col("distinct_ratio") / 2),
        fusion.signals_of(declared, "SEMANTIC", F.lit("semantic_hypothesis"), F.col("value")),
        fusion.signals_of(declared.where(F.col("subject") == third), "ASSERTION", F.lit("domain_assertion"), F.col("value")),
    ]
    signals = relationship_evidence(spark, sf_dir)
    for one in told:
        signals = signals.unionByName(one)
    found = fusion.decisions(fusion.deduplicated(signals), required=("DEPENDENCY", "PROFILE", "QUALITY"))
    silent = F.size(F.filter("limitations", lambda x: x.endswith(": doesn't score")))
    return found.select("subject", F.round("score", 9).alias("score"), "band", "state", F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", "conflicts").alias("conflicts"), silent.alias("silent"))


@query("""WITH c AS (SELECT p_brand AS b, p_type AS t, count(*) AS n, max(p_size) AS top FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, t) AS rn, row_number() OVER (PARTITION BY b ORDER BY top DESC, t) AS rt FROM c),
d AS (SELECT b || '->' || t AS subject, CASE WHEN rn <= 2 THEN 1 / (1.0 + rn) END::DOUBLE AS coma, CASE WHEN rt <= 2 THEN 1 / (1.0 + rt) END::DOUBLE AS cupid, CASE WHEN t = 'PROMO' THEN -1.0 ELSE 1.0 END::DOUBLE AS fit, t = 'PROMO' AS against, n, top FROM k),
s AS (SELECT *, round((coalesce(round(coma, 12), 0) + coalesce(round(cupid, 12), 0) + 0.75 * fit) / (0.75 + (coma IS NOT NULL)::INT + (cupid IS NOT NULL)::INT), 9) AS score, coma IS NULL AND cupid IS NULL AS unranked, n < 4 AS unseen FROM d)
SELECT subject, score, CASE WHEN against THEN 'CONFLICTED' WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS band, CASE WHEN unranked OR unseen THEN 'INCOMPLETE_REQUIRED_EVIDENCE' ELSE 'REVIEW_REQUIRED' END AS state,
concat_ws(',', CASE WHEN unranked THEN 'dimension:matcher:coma:rank|matcher:cupid:rank' END, CASE WHEN unseen THEN 'producer:profile' END) AS missing FROM s""")
def fusion_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of brands to types under the mapping policy: ranks of two matchers, types, and three producers."""
    counts = table(spark, sf_dir, "part", ["p_brand", "p_type", "p_size"]).groupBy(F.col("p_brand").alias("left"), F.col("p_type").alias("right")).agg(F.count("*").alias("coma"), F.max("p_size").alias("cupid"))
    subject = F.concat("left", F.lit("->"), "right").alias("subject")
    ranks = matching.ranked(counts, ["coma", "cupid"], 2).select(subject, "matcher", "rank")
    pairs = counts.select(subject, "right", F.col("coma").alias("n"), F.col("cupid").alias("top"))
    fits = F.when(F.col("right") == "PROMO", 0.0).otherwise(1.0)
    told = [
        fusion.signals_of(pairs, "SCHEMA_MATCHING", F.lit("type_compatibility"), fits, F.when(fits < 0.5, "CONTRADICTS").otherwise("SUPPORTS")),
        fusion.signals_of(pairs.where("n >= 4"), "PROFILE", F.lit("distinct_ratio"), 1 / F.col("n")),
        fusion.signals_of(pairs, "QUALITY", F.lit("quality_ratio"), F.col("top") / 50),
        fusion.signals_of(pairs, "DEPENDENCY", F.lit("co_occurrences"), F.lit(1.0)),
        fusion.signals_of(pairs, "SEMANTIC", F.lit("semantic_hypothesis"), F.lit(1.0)),
    ]
    signals = fusion.signals_of(ranks, "SCHEMA_MATCHING", F.concat(F.lit("matcher_rank:"), "matcher"), F.col("rank"))
    for one in told:
        signals = signals.unionByName(one)
    found = fusion.decisions(fusion.deduplicated(signals), fusion.MAPPING, fusion.MAPPING_FAMILIES, one_of=fusion.MAPPING_MATCHERS)
    return found.select("subject", F.round("score", 9).alias("score"), "band", "state", F.concat_ws(",", "missing").alias("missing"))
