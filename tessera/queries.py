"""The engine's queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expressions as ex
from tessera.operators import canonical, dependencies, entity_resolution, evaluation, fusion, graph, matching, privacy, profiling, quality, ranking, scale, star, validation, views
from tessera.plans import semantic
from tessera.sources import files
from tessera.streaming import rules as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return files.read_table(spark, f"{sf_dir}/{name}.parquet", columns)


def money(column: str):
    return F.col(column).cast("decimal(18,2)")


def key_sql(namespace: str, reference: str) -> str:
    """A surrogate key in SQL: the first 63 bits of the hash of the canonical JSON."""
    return f"""CAST(('0x' || substr(sha256('{{"canonical_reference":"' || {reference} || '","namespace":"{namespace}"}}'), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT)"""


# --- the star schema ---------------------------------------------------------------------------------------------


def dim_customer(spark: SparkSession, sf_dir: str, unknown: bool = False, check: bool = False) -> star.Dimension:
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    attributes = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "nation": F.col("n_name"), "region": F.col("r_name")}
    return star.build_dimension(rows, "customer", F.col("c_custkey"), attributes, ("name",), unknown, check)


def dim_part(spark: SparkSession, sf_dir: str) -> star.Dimension:
    rows = table(spark, sf_dir, "part")
    return star.build_dimension(rows, "part", F.col("p_partkey"), {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size")}, check=False)


def dim_supplier(spark: SparkSession, sf_dir: str) -> star.Dimension:
    return star.build_dimension(table(spark, sf_dir, "supplier"), "supplier", F.col("s_suppkey"), {"name": F.col("s_name")}, check=False)


def dim_date(spark: SparkSession, sf_dir: str) -> star.Dimension:
    days = table(spark, sf_dir, "orders", ["o_orderdate"]).unionByName(table(spark, sf_dir, "lineitem", ["l_shipdate"]).withColumnRenamed("l_shipdate", "o_orderdate"))
    return star.build_date_dimension(spark, days)


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def line_fact(spark: SparkSession, sf_dir: str, customers: star.Dimension | None = None, policy: str = "QUARANTINE_FACT") -> tuple[DataFrame, DataFrame]:
    orders, lines = table(spark, sf_dir, "orders", ["o_custkey"]), table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"])
    keys = [star.ForeignKey(F.col("o_custkey"), customers or dim_customer(spark, sf_dir), policy, source=orders), star.ForeignKey(F.col("l_partkey"), dim_part(spark, sf_dir), source=lines), star.ForeignKey(F.col("l_suppkey"), dim_supplier(spark, sf_dir), source=lines)]
    rows = line_rows(spark, sf_dir)
    measures = {"quantity": money("l_quantity"), "price": money("l_extendedprice"), "discount": money("l_discount")}
    return star.build_fact(rows, ["l_orderkey", "l_linenumber"], keys, {"order_date": F.col("o_orderdate"), "ship_date": F.col("l_shipdate")}, measures, ["l_returnflag", "l_linestatus"], "l_orderkey")


def order_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [star.ForeignKey(F.col("o_custkey"), dim_customer(spark, sf_dir))]
    return star.build_fact(table(spark, sf_dir, "orders"), ["o_orderkey"], keys, {"order_date": F.col("o_orderdate")}, {"total": money("o_totalprice")}, ["o_orderstatus"], "o_orderkey")[0]


A = semantic.Attribute
MODEL = semantic.Model(
    (
        semantic.DimensionModel("customer", "dim_customer", "customer_key", (A("customer.segment", "segment"), A("customer.nation", "nation"), A("customer.region", "region"), A("customer.ref", "canonical_ref", exposed=False)), ("customer.region", "customer.nation")),
        semantic.DimensionModel("part", "dim_part", "part_key", (A("part.brand", "brand"), A("part.type", "type"), A("part.size", "size", "INTEGER"))),
        semantic.DimensionModel("supplier", "dim_supplier", "supplier_key", (A("supplier.name", "name"),)),
        semantic.DimensionModel("date", "dim_date", "date_key", (A("date.year", "year", "INTEGER"), A("date.quarter", "quarter", "INTEGER"), A("date.month", "month", "INTEGER"), A("date.day", "full_date", "DATE", nullable=False)), ("date.year", "date.quarter", "date.month", "date.day")),
    ),
    (
        semantic.FactModel(
            "line",
            "fact_line",
            (
                semantic.Metric("quantity", "quantity", operations=("SUM", "MAX", "MIN", "COUNT")),
                semantic.Metric("price", "price"),
                semantic.Metric("lines", None, operations=("COUNT",)),
                semantic.Metric("top_discount", "discount", semantic.SEMI_ADDITIVE, ("MAX",)),
                semantic.Metric("revenue_share", None, kind="DERIVED"),
            ),
            (
                semantic.Relationship("customer", "customer_key"),
                semantic.Relationship("part", "part_key"),
                semantic.Relationship("supplier", "supplier_key"),
                semantic.Relationship("date", "order_date_key", time_role="ordered"),
                semantic.Relationship("date", "ship_date_key", time_role="shipped"),
            ),
        ),
    ),
)


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "fact_line": line_fact(spark, sf_dir)[0],
        "dim_customer": dim_customer(spark, sf_dir).rows,
        "dim_part": dim_part(spark, sf_dir).rows,
        "dim_supplier": dim_supplier(spark, sf_dir).rows,
        "dim_date": dim_date(spark, sf_dir).rows,
    }


PUBLISHED: dict[tuple[str, str], str] = {}


def published_star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star's tables as published in the shared folder, once for each session and state of the sources."""
    mark = files.source_mark(spark, sf_dir)
    at = (spark.sparkContext.applicationId, f"{sf_dir}|{mark}")
    if at not in PUBLISHED:
        folder = f"{graph.shared_folder(spark)}/star-{uuid.uuid4().hex}"
        star.publish(star_tables(spark, sf_dir), folder, mark)
        PUBLISHED[at] = folder
    return {name: star.read_published(spark, PUBLISHED[at], name, mark) for name in ("fact_line", "dim_customer", "dim_part", "dim_supplier", "dim_date")}


def ask(spark: SparkSession, sf_dir: str, names: dict[str, str], doubles: tuple[str, ...] = (), **request) -> DataFrame:
    """A request's result under plain column names; sums as doubles, as SQL engines differ in decimal widths."""
    out = semantic.query(MODEL, published_star(spark, sf_dir), semantic.Request(**request))
    return out.select(*[F.col(f"`{a}`").cast("double").alias(b) if b in doubles else F.col(f"`{a}`").alias(b) for a, b in names.items()])


LINES = "FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey JOIN part p ON l_partkey = p_partkey JOIN supplier s ON l_suppkey = s_suppkey"


@query(f"""SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity {LINES}
WHERE o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' GROUP BY ALL ORDER BY quantity DESC, segment, year LIMIT 10""")
def semantic_segment_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = datetime.date
    return ask(spark, sf_dir, {"customer.segment": "segment", "date.year": "year", "quantity": "quantity"}, ("quantity",), metrics=("quantity",), group_by=("customer.segment", "date.year"),
               filters=(semantic.Filter("date.day", "DATE_RANGE", (day(1995, 1, 1), day(1997, 12, 31))),), sort=(("quantity", True), ("customer.segment", False), ("date.year", False)), limit=10, time_role="ordered")


@query(f"SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, count(*) AS lines {LINES}")
def semantic_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, sf_dir, {"quantity": "quantity", "price": "price", "lines": "lines"}, ("quantity", "price"), metrics=("quantity", "price", "lines"))


@query(f"SELECT p_brand AS brand, CAST(max(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(*) AS lines {LINES} WHERE r_name IN ('ASIA', 'EUROPE') AND p_type = 'ECONOMY' GROUP BY ALL")
def semantic_filters_in_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = (semantic.Filter("customer.region", "IN", ("ASIA", "EUROPE")), semantic.Filter("part.type", "EQUALS", ("ECONOMY",)))
    return ask(spark, sf_dir, {"part.brand": "brand", "quantity": "quantity", "lines": "lines"}, ("quantity",), metrics=("quantity", "lines"), group_by=("part.brand",), filters=filters, operations={"quantity": "MAX"})


@query(f"SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter, CAST(max(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS top_discount {LINES} GROUP BY ALL")
def semantic_semi_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, sf_dir, {"date.year": "year", "date.quarter": "quarter", "top_discount": "top_discount"}, ("top_discount",), metrics=("top_discount",), group_by=("date.year", "date.quarter"), time_role="shipped")


@query(f"SELECT r_name AS region, n_name AS nation, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price {LINES} GROUP BY ALL ORDER BY region, nation LIMIT 1000")
def semantic_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, sf_dir, {"customer.region": "region", "customer.nation": "nation", "price": "price"}, ("price",), metrics=("price",), group_by=("customer.region", "customer.nation"), sort=(("customer.region", False), ("customer.nation", False)))


@query(f"SELECT p_brand AS brand, count(*) AS lines {LINES} GROUP BY ALL")
def semantic_implicit_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, sf_dir, {"part.brand": "brand", "lines": "lines"}, metrics=("lines",), dimensions=("part",))


@query(f"SELECT {key_sql('customer', 'CAST(c_custkey AS VARCHAR)')} AS customer_key, CAST(c_custkey AS VARCHAR) AS canonical_ref, c_name AS name, c_mktsegment AS segment, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey "
       f"UNION ALL SELECT {key_sql('customer', chr(39) + '__UNKNOWN__:customer' + chr(39))}, '__UNKNOWN__:customer', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN'")
def star_dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_customer(spark, sf_dir, unknown=True, check=True).rows


@query(f"SELECT {key_sql('date', 'strftime(d, ' + chr(39) + '%Y-%m-%d' + chr(39) + ')')} AS date_key, strftime(d, '%Y-%m-%d') AS canonical_ref, d AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(isodow(d) AS INTEGER) AS weekday "
       "FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def star_dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_date(spark, sf_dir).rows


@query(f"SELECT l_orderkey, l_linenumber, {key_sql('customer', 'CAST(o_custkey AS VARCHAR)')} AS customer_key, {key_sql('date', 'strftime(l_shipdate, ' + chr(39) + '%Y-%m-%d' + chr(39) + ')')} AS ship_date_key, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) AS quantity, '[\"' || CAST(l_orderkey AS VARCHAR) || '\"]' AS source_record_refs {LINES}")
def star_fact_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, _ = line_fact(spark, sf_dir)
    return fact.select("l_orderkey", "l_linenumber", "customer_key", "ship_date_key", F.col("quantity").cast("double").alias("quantity"), "source_record_refs")


def some_customers(spark: SparkSession, sf_dir: str, unknown: bool) -> star.Dimension:
    whole = dim_customer(spark, sf_dir, unknown)
    return star.Dimension(whole.name, whole.key, whole.rows.where("segment != 'BUILDING'"))


@query(f"SELECT l_orderkey, l_linenumber, 'ORPHAN:customer_key' AS reason {LINES} WHERE c_mktsegment = 'BUILDING'")
def star_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_fact(spark, sf_dir, some_customers(spark, sf_dir, False))[1]


@query(f"SELECT {key_sql('customer', chr(39) + '__UNKNOWN__:customer' + chr(39))} AS customer_key, count(*) AS facts {LINES} WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def star_unknown_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, _ = line_fact(spark, sf_dir, some_customers(spark, sf_dir, True), "EXPLICIT_UNKNOWN_MEMBER")
    return fact.where(F.col("source_record_refs").contains("policy:unknown-member")).groupBy("customer_key").agg(F.count("*").alias("facts"))


@query("""SELECT o_orderstatus AS source_id, count(*) AS input, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS emitted, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS quarantined, CAST(0 AS BIGINT) AS unresolved
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def star_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    facts, lost = star.build_fact(orders, ["o_orderkey"], [star.ForeignKey(F.col("o_custkey"), some_customers(spark, sf_dir, False))], degenerate=["o_orderstatus"])
    statuses = orders.select("o_orderkey", F.col("o_orderstatus").alias("source_id"))
    return star.accounting_by_source(statuses, facts.withColumnRenamed("o_orderstatus", "source_id"), lost.join(statuses, "o_orderkey"))


# --- validation --------------------------------------------------------------------------------------------------


@query("""SELECT 'fk:o_custkey' AS "check", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS discrepancies, 'BLOCKING' AS severity FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) OR o_custkey IS NULL""")
def validate_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.foreign_keys(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


@query("""SELECT 'grain:l_orderkey,l_linenumber' AS "check", CASE WHEN count(*) - count(DISTINCT (l_orderkey, l_linenumber)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS discrepancies, 'BLOCKING' AS severity FROM lineitem""")
def validate_duplicate_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.duplicate_grain(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH missing AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)), extra AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
SELECT 'grain:missing' AS "check", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS discrepancies, 'BLOCKING' AS severity FROM missing UNION ALL SELECT 'grain:extra', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*), 'BLOCKING' FROM extra""")
def validate_grain_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, observed = table(spark, sf_dir, "orders", ["o_orderkey"]), table(spark, sf_dir, "lineitem", ["l_orderkey"]).withColumnRenamed("l_orderkey", "o_orderkey")
    return validation.grain_sets(expected, observed, ["o_orderkey"])


@query(f"""WITH g AS (SELECT o_custkey, l_suppkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS s, max(CAST(l_quantity AS DECIMAL(18,2))) AS m, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS p {LINES} GROUP BY 1, 2),
w AS (SELECT o_custkey, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
n AS (SELECT 'aggregate:sum:quantity' AS "check", count(*) AS d FROM g WHERE s <> s + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END UNION ALL SELECT 'aggregate:max:quantity', count(*) FROM g WHERE m <> CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE m END
UNION ALL SELECT 'aggregate:sum:price', count(*) FROM g FULL JOIN w USING (o_custkey, l_suppkey) WHERE g.p IS DISTINCT FROM w.p)
SELECT "check", CASE WHEN d = 0 THEN 'PASS' ELSE 'FAIL' END AS status, d AS discrepancies, 'BLOCKING' AS severity FROM n""")
def validate_sliced_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two expectations with wrong slices, which have to be found, and one that holds."""
    tables = published_star(spark, sf_dir)
    rows = line_rows(spark, sf_dir).select("o_custkey", "l_suppkey", money("l_quantity").alias("q"), money("l_extendedprice").alias("p"))
    each = rows.groupBy("o_custkey", "l_suppkey").agg(F.sum("q").alias("s"), F.max("q").alias("m"), F.sum("p").alias("p"))
    slice_ = F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("l_suppkey").cast("string")).alias("slice")
    sums = F.col("s") + F.when(F.col("l_suppkey") % 5 == 0, 1).otherwise(0)
    most = F.when(F.col("o_custkey") % 7 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("m"))
    expected = each.select(slice_, sums.alias("sums"), most.alias("most"), F.col("p").alias("price"))
    slices = [("customer_key", tables["dim_customer"], "customer_key"), ("supplier_key", tables["dim_supplier"], "supplier_key")]
    return validation.aggregates_together(expected, tables["fact_line"].select("customer_key", "supplier_key", "quantity", "price"), slices, [("sums", "quantity", "sum"), ("most", "quantity", "max"), ("price", "price", "sum")])


@query("""SELECT 'dates' AS "check", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS discrepancies, 'BLOCKING' AS severity FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) d FROM lineitem) WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def validate_date_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.date_coverage(table(spark, sf_dir, "lineitem"), "l_shipdate", star.build_date_dimension(spark, table(spark, sf_dir, "orders", ["o_orderdate"])).rows)


@query("""SELECT 'lineage:missing' AS "check", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS discrepancies, 'BLOCKING' AS severity FROM (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) UNION ALL SELECT 'lineage:unknown', 'PASS', CAST(0 AS BIGINT), 'BLOCKING'""")
def validate_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.lineage(table(spark, sf_dir, "orders"), "o_orderkey", line_fact(spark, sf_dir)[0])


@query("""SELECT 'values' AS "check", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS discrepancies, 'BLOCKING' AS severity FROM orders WHERE o_orderstatus = 'P'""")
def validate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.concat(F.lit(" "), F.col("o_orderstatus"))).alias("o_orderstatus"), F.col("o_totalprice").cast("decimal(20,4)").alias("total"))
    return validation.values(expected, order_fact(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "total"])


@query("""SELECT CASE WHEN bool_or(f > 0) THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS checks, count(*) FILTER (WHERE f > 0) AS failed FROM (
SELECT count(*) - count(DISTINCT o_orderkey) AS f FROM orders UNION ALL SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT CAST(count(*) > count(DISTINCT c_name) AS INT) FROM customer)""")
def validate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return validation.verdict(validation.gate([validation.unique(orders, ["o_orderkey"]), validation.foreign_keys(orders, "o_custkey", customers, "c_custkey"), validation.unique(customers, ["c_name"])]))


# --- quality -----------------------------------------------------------------------------------------------------


def with_ref(rows: DataFrame, key: list[str], scope: str) -> DataFrame:
    return files.with_references(rows, scope, key)


R = quality.Rule
ORDER_RULES = [
    R("required-priority", "REQUIRED_VALUE", "orders", ("o_orderpriority",)),
    R("unique-order", "UNIQUE_VALUES", "orders", ("o_orderkey",), severity="HIGH"),
    R("unique-customer", "UNIQUE_VALUES", "orders", ("o_custkey",)),
    R("status-domain", "ALLOWED_DOMAIN", "orders", ("o_orderstatus",), allowed=("F", "O")),
    R("total-range", "NUMERIC_RANGE", "orders", ("o_totalprice",), minimum=1000.0, maximum=400000.0),
    R("priority-pattern", "EXPECTED_PATTERN", "orders", ("o_orderpriority",), pattern="INTEGER_STRING"),
    R("total-type", "EXPECTED_PRIMITIVE_TYPE", "orders", ("o_totalprice",), expected_type="real"),
    R("date-type", "EXPECTED_PRIMITIVE_TYPE", "orders", ("o_orderdate",), expected_type="datetime"),
    R("customer-exists", "DECLARED_REFERENTIAL_INTEGRITY", "orders", ("o_custkey",), target="customer", target_columns=("c_custkey",)),
]


@query("""WITH o AS (SELECT count(*) n FROM orders) SELECT * FROM (
SELECT 'required-priority' rule_id, 'orders' "table", 'completeness' dimension, 'REQUIRED_VALUE_MISSING' issue_type, count(*) evaluated, count(*) FILTER (WHERE o_orderpriority IS NULL) affected FROM orders
UNION ALL SELECT 'unique-order', 'orders', 'uniqueness', 'UNIQUE_VALUES_VIOLATION', sum(c)::BIGINT, coalesce(sum(c) FILTER (WHERE c > 1), 0)::BIGINT FROM (SELECT count(*) c FROM orders GROUP BY o_orderkey)
UNION ALL SELECT 'unique-customer', 'orders', 'uniqueness', 'UNIQUE_VALUES_VIOLATION', sum(c)::BIGINT, coalesce(sum(c) FILTER (WHERE c > 1), 0)::BIGINT FROM (SELECT count(*) c FROM orders GROUP BY o_custkey)
UNION ALL SELECT 'status-domain', 'orders', 'validity', 'ALLOWED_DOMAIN_VIOLATION', count(*), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL SELECT 'total-range', 'orders', 'validity', 'NUMERIC_RANGE_VIOLATION', count(*), count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) FROM orders
UNION ALL SELECT 'priority-pattern', 'orders', 'validity', 'EXPECTED_PATTERN_MISMATCH', count(*), count(*) FROM orders
UNION ALL SELECT 'total-type', 'orders', 'validity', 'EXPECTED_PRIMITIVE_TYPE_MISMATCH', count(*), CAST(0 AS BIGINT) FROM orders
UNION ALL SELECT 'date-type', 'orders', 'validity', 'EXPECTED_PRIMITIVE_TYPE_MISMATCH', count(*), count(*) FROM orders
UNION ALL SELECT 'customer-exists', 'orders', 'referential_integrity', 'DECLARED_REFERENTIAL_INTEGRITY_VIOLATION', count(*), count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders)""")
def quality_order_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"orders": with_ref(table(spark, sf_dir, "orders"), ["o_orderkey"], "orders"), "customer": table(spark, sf_dir, "customer")}
    return quality.evaluate(tables, ORDER_RULES).select("rule_id", "table", "dimension", "issue_type", "evaluated", "affected")


@query("SELECT event_id, 'EXPECTED_DOMAIN' AS kind FROM events WHERE event_type NOT IN ('click', 'view')")
def quality_issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = R("types", "ALLOWED_DOMAIN", "events", ("event_type",), allowed=("click", "view"))
    found = quality.affected(table(spark, sf_dir, "events"), rule, "event_id").where("affected")
    return found.select("event_id", F.lit("EXPECTED_DOMAIN").alias("kind"))


@query("SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text, lang) n FROM documents) WHERE n > 1")
def quality_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = R("copies", "EXACT_ROW_DUPLICATION", "documents")
    return quality.affected(table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]), rule, "doc_id").where("affected").select("doc_id")


@query("""SELECT dimension, count(*) AS rules, sum(a)::BIGINT AS affected, CASE WHEN min(e) = max(e) THEN max(e) ELSE 0 END AS evaluated FROM (
SELECT 'validity' dimension, count(*) e, count(*) FILTER (WHERE value < 0 OR value > 100) a FROM events UNION ALL SELECT 'validity', count(*), count(*) FILTER (WHERE event_type <> 'click') FROM events UNION ALL SELECT 'completeness', count(*), count(*) FILTER (WHERE props IS NULL) FROM events) GROUP BY 1""")
def quality_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [R("v", "NUMERIC_RANGE", "events", ("value",), minimum=0.0, maximum=100.0), R("t", "ALLOWED_DOMAIN", "events", ("event_type",), allowed=("click",)), R("p", "REQUIRED_VALUE", "events", ("props",))]
    return quality.dimension_summary(quality.evaluate({"events": table(spark, sf_dir, "events")}, rules, "event_id")).select("dimension", "rules", "affected", "evaluated")


@query("SELECT event_id FROM events WHERE value >= 0 AND value <= 150")
def quality_quarantine_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = R("v", "NUMERIC_RANGE", "events", ("value",), minimum=0.0, maximum=150.0, quarantine=True)
    return quality.propose(table(spark, sf_dir, "events"), rule, "event_id").kept.select("event_id")


@query("SELECT event_id, CASE WHEN value > 100 THEN 'v' END AS v, CASE WHEN event_type NOT IN ('click') THEN 't' END AS t FROM events")
def quality_row_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [R("v", "NUMERIC_RANGE", "events", ("value",), maximum=100.0), R("t", "ALLOWED_DOMAIN", "events", ("event_type",), allowed=("click",))]
    rows = streams.marked(table(spark, sf_dir, "events"), rules)
    return rows.select("event_id", *[F.when(F.array_contains("failed_rules", r), r).alias(r) for r in ("v", "t")])


# --- profiling ---------------------------------------------------------------------------------------------------


@query("""SELECT 'c_acctbal' AS "column", metric, value FROM (UNPIVOT (SELECT count(*)::DOUBLE AS rows, count(*) FILTER (WHERE c_acctbal IS NULL)::DOUBLE AS physical_nulls, count(c_acctbal)::DOUBLE AS non_missing, min(c_acctbal) AS number_min, max(c_acctbal) AS number_max, count(*) FILTER (WHERE c_acctbal = 0)::DOUBLE AS number_zeros, count(*) FILTER (WHERE c_acctbal < 0)::DOUBLE AS number_negatives FROM customer) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def profile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["rows", "physical_nulls", "non_missing", "number_min", "number_max", "number_zeros", "number_negatives"]
    return profiling.profile(table(spark, sf_dir, "customer"), ["c_acctbal"]).where(F.col("metric").isin(wanted))


@query("SELECT round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events")
def profile_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiling.profile(table(spark, sf_dir, "events"), ["value"])
    return found.agg(F.round(F.max(F.when(F.col("metric") == "number_mean", F.col("value"))), 6).alias("mean"), F.round(F.max(F.when(F.col("metric") == "number_variance", F.col("value"))), 4).alias("variance"))


@query("""SELECT 'role' AS "column", metric, value FROM (UNPIVOT (SELECT count(*)::DOUBLE AS rows, count(*) FILTER (WHERE role = 'user')::DOUBLE AS marker_count, count(*) FILTER (WHERE role <> 'user')::DOUBLE AS non_missing, min(length(role)) FILTER (WHERE role <> 'user')::DOUBLE AS length_min, max(length(role)) FILTER (WHERE role <> 'user')::DOUBLE AS length_max FROM conversations) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def profile_texts_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["rows", "marker_count", "non_missing", "length_min", "length_max"]
    return profiling.profile(table(spark, sf_dir, "conversations"), ["role"], ("user",)).where(F.col("metric").isin(wanted))


@query("""SELECT metric, value FROM (UNPIVOT (SELECT count(*) FILTER (WHERE regexp_full_match(p_name, '[+-]?[0-9]+'))::DOUBLE AS pattern_integer_string, count(*) FILTER (WHERE regexp_full_match(p_name, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+'))::DOUBLE AS pattern_email_like FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN 'a' || p_size || '@b.example' ELSE p_name END AS p_name FROM part)) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def profile_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    rows = table(spark, sf_dir, "part").select(F.when(k == 0, size).when(k == 1, F.concat(F.lit("a"), size, F.lit("@b.example"))).otherwise(F.col("p_name")).alias("p_name"))
    return profiling.profile(rows, ["p_name"]).where(F.col("metric").isin("pattern_integer_string", "pattern_email_like")).select("metric", "value")


@query("""SELECT 'c_mktsegment' AS "column", count(*) AS non_missing, count(DISTINCT c_mktsegment) AS distinct_count, round((SELECT 1 - sum((n * 1.0 / t) * (n * 1.0 / t)) FROM (SELECT count(*)::DOUBLE n FROM customer GROUP BY c_mktsegment), (SELECT count(*)::DOUBLE t FROM customer)), 9) AS gini FROM customer
UNION ALL SELECT 'c_nationkey', count(*), count(DISTINCT c_nationkey), round((SELECT 1 - sum((n * 1.0 / t) * (n * 1.0 / t)) FROM (SELECT count(*)::DOUBLE n FROM customer GROUP BY c_nationkey), (SELECT count(*)::DOUBLE t FROM customer)), 9) FROM customer""")
def profile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.spread(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"]).select("column", "non_missing", "distinct_count", F.round("gini", 9).alias("gini"))


@query("""WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT q AS quantile, value FROM v, (VALUES ('p25', 0.25), ('p50', 0.5), ('p75', 0.75)) AS f(q, p) WHERE i = floor(p * (n - 1))""")
def profile_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.quantiles(table(spark, sf_dir, "events"), "value")


@query("SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM events)) AS duplicate_rows FROM events")
def profile_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.duplicate_rows(table(spark, sf_dir, "events", ["event_type", "user_id"]))


@query("SELECT count(*) AS observed, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS parsed FROM orders")
def profile_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 4 == 0, "not a day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return profiling.datetimes(table(spark, sf_dir, "orders").select(text.alias("t")), "t").select("observed", "parsed")


@query("""SELECT 'value' AS "column", metric, b AS before, a AS after, a - b AS delta, 'COMPARABLE' AS state FROM (SELECT 'rows' AS metric, count(*)::DOUBLE AS b, count(*) FILTER (WHERE event_type = 'click')::DOUBLE AS a FROM events UNION ALL SELECT 'number_max', max(value), max(value) FILTER (WHERE event_type = 'click') FROM events)""")
def profile_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return profiling.profile_diff(profiling.profile(rows, ["value"]), profiling.profile(rows.where("event_type = 'click'"), ["value"])).where(F.col("metric").isin("rows", "number_max"))


# --- dependencies ------------------------------------------------------------------------------------------------


@query("SELECT 'c_custkey' AS columns, count(*) AS eligible, count(DISTINCT c_custkey) AS distinct_count FROM customer UNION ALL SELECT 'c_name', count(*), count(DISTINCT c_name) FROM customer")
def deps_unique_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return dependencies.unique_combinations(rows, max_arity=2).select("columns", "eligible", "distinct_count")


def functional_sql(name: str, columns: list[str], arity: int = 2) -> str:
    """Minimal dependencies by comparing distinct counts of every column set with and without each other column."""
    parts = []
    for n in range(1, arity + 1):
        for x in combinations(columns, n):
            for a in columns:
                if a not in x:
                    parts.append(f"SELECT '{','.join(x)}' AS lhs, '{a}' AS rhs, {n} AS n WHERE (SELECT count(DISTINCT ({', '.join(x)})) FROM {name}) = (SELECT count(DISTINCT ({', '.join((*x, a))})) FROM {name})")
    return f"WITH d AS ({' UNION ALL '.join(parts)}) SELECT lhs, rhs FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS s WHERE s.rhs = d.rhs AND s.n < d.n AND list_has_all(string_split(d.lhs, ','), string_split(s.lhs, ',')))"


@query(functional_sql("nation", ["n_nationkey", "n_name", "n_regionkey"]))
def deps_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.functional_dependencies(table(spark, sf_dir, "nation"), max_arity=2).select("lhs", "rhs")


@query(functional_sql("part", ["p_partkey", "p_brand", "p_type", "p_size"]))
def deps_functional_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.functional_dependencies(table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size"]), max_arity=2).select("lhs", "rhs")


@query("SELECT sum(n)::BIGINT AS eligible, count(*) FILTER (WHERE d > 1) AS violating_groups, round(sum(d - 1) * 1.0 / sum(n), 9) AS error FROM (SELECT count(DISTINCT p_brand) d, count(*) n FROM part GROUP BY p_type)")
def deps_fd_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.dependency_error(table(spark, sf_dir, "part"), ["p_type"], "p_brand").select("eligible", "violating_groups", F.round("error", 9).alias("error"))


@query("""SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(DISTINCT o_custkey) FROM orders) AS left_distinct, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS matched, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans, (SELECT count(*) FROM customer) AS right_rows, true AS relationship_candidate""")
def deps_inclusion_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dependencies.inclusion_measures(table(spark, sf_dir, "orders"), ["o_custkey"], table(spark, sf_dir, "customer"), ["c_custkey"])
    return dependencies.relationship(found).select("left_rows", "left_distinct", "matched", "orphans", "right_rows", "relationship_candidate")


SEARCHED = {"orders": ["o_custkey", "o_orderstatus"], "customer": ["c_custkey", "c_mktsegment"], "lineitem": ["l_suppkey", "l_returnflag", "l_linestatus"], "supplier": ["s_suppkey", "s_name"], "nation": ["n_regionkey", "n_name"], "region": ["r_regionkey", "r_name"]}


def inclusion_sql(tables: dict[str, list[str]], texts: tuple[str, ...]) -> str:
    """Inclusions of columns of one family by looking for values that the other column lacks, one pair after the other."""
    columns = [(t, c) for t, names in tables.items() for c in names]
    parts = [
        f"SELECT '{t}.{c}' AS \"left\", '{u}.{d}' AS \"right\", (SELECT count(DISTINCT {c}) FROM {t}) AS left_distinct WHERE NOT EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {d} FROM {u} WHERE {d} IS NOT NULL))"
        for t, c in columns
        for u, d in columns
        if (t, c) != (u, d) and (c in texts) == (d in texts)
    ]
    return " UNION ALL ".join(parts)


@query(inclusion_sql(SEARCHED, ("o_orderstatus", "c_mktsegment", "l_returnflag", "l_linestatus", "s_name", "n_name", "r_name")))
def deps_inclusion_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inclusions among the columns, wanted or not."""
    return dependencies.inclusion_candidates({t: table(spark, sf_dir, t, c) for t, c in SEARCHED.items()}).select("left", "right", "left_distinct")


@query()
def deps_all_inclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inclusions of a column in another, of all columns and tables of the star's sources."""
    return dependencies.inclusion_candidates({t: table(spark, sf_dir, t) for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")})


# --- matching, resolution, fusion, canonical entities ----------------------------------------------------------------


@query()
def match_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "supplier")}
    columns = files.catalog_of(tables)
    pairs = matching.column_pairs(columns.where("table = 'customer'"), columns.where("table = 'supplier'"))
    ratios = None
    for t, rows in tables.items():
        one = profiling.spread(rows, rows.columns).select(F.concat(F.lit(f"{t}."), "column").alias("column"), "distinct_ratio")
        ratios = one if ratios is None else ratios.unionByName(one)
    inclusions = dependencies.inclusion_candidates(tables, 0.5).select("left", "right", "coverage")
    full = matching.with_dependencies(matching.with_profiles(pairs, ratios), inclusions)
    return matching.candidates(matching.ranked(full, ["name", "table_name", "tokens", "profile", "dependency"]))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as one source, and as another the even ones with other spellings."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    crm = c.select(F.concat(F.lit("crm-"), "c_custkey").alias("record_ref"), F.lit("crm").alias("source_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "nation")
    other = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("erp-"), "c_custkey").alias("record_ref"), F.lit("erp").alias("source_id"), F.when(F.col("c_custkey") % 4 == 0, F.upper("c_name")).otherwise(F.regexp_replace("c_name", "Customer#", "Custmer #")).alias("name"), F.col("c_mktsegment").alias("segment"), "nation")
    rows = crm.unionByName(other)
    return rows.withColumns({"name": ex.identity_form(F.col("name")), "number": ex.identity_form(F.regexp_replace("name", r"^\D*0*", "n"))})


ER = entity_resolution.Spec(
    (entity_resolution.Comparison("name", "jaro_winkler", (0.95, 0.85)), entity_resolution.Comparison("number"), entity_resolution.Comparison("segment"), entity_resolution.Comparison("nation")),
    (("number", "nation"), ("name",)),
    prior=0.001,
)


@query()
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_resolution.resolve(people(spark, sf_dir), ER)[1].select(F.concat_ws(",", "members").alias("members"), "size", "edges", "decision")


@query("""SELECT 'crm-' || c_custkey AS l, 'erp-' || c_custkey AS r FROM customer WHERE c_custkey % 2 = 0""")
def er_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = entity_resolution.Spec(ER.comparisons, (("number", "nation"),))
    return entity_resolution.candidate_pairs(people(spark, sf_dir), spec).select("l", "r")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, -1 - (o_orderkey % 97) AS b FROM orders), bi AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(node, seen) AS (SELECT a, a FROM bi UNION SELECT walk.node, bi.b FROM walk JOIN bi ON walk.seen = bi.a) SELECT node, min(seen) AS component FROM walk GROUP BY node""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("left"), (-1 - F.col("o_orderkey") % 97).alias("right"))
    return graph.connected_components(edges)


@query()
def graph_all_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_components under the name that the test against union-find has."""
    return graph_components(spark, sf_dir)


@query("""WITH h1 AS (SELECT o_orderkey + 1000000000 AS n FROM orders WHERE o_custkey = 1), h2 AS (SELECT DISTINCT l_suppkey + 2000000000 AS n FROM lineitem WHERE l_orderkey + 1000000000 IN (SELECT n FROM h1))
SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2""")
def graph_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("left"), (F.col("o_orderkey") + 1000000000).alias("right"))
    b = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1000000000).alias("left"), (F.col("l_suppkey") + 2000000000).alias("right"))
    return graph.neighbourhood(a.unionByName(b), spark.range(1, 2), 2, "downstream")


def relationship_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for l, lc, r, rc in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "supplier", "s_nationkey")):
        one = dependencies.inclusion_measures(table(spark, sf_dir, l), [lc], table(spark, sf_dir, r), [rc]).withColumn("subject", F.lit(f"rel:{l}.{lc}->{r}.{rc}"))
        found = one if found is None else found.unionByName(one)
    signals = fusion.dependency_signals(found)
    types = found.select("subject", F.lit("type_compatibility").alias("metric"), F.lit(1.0).alias("value"), F.lit("SUPPORTS").alias("direction"), F.concat("subject", F.lit("#type")).alias("evidence_id"), F.lit("FULL").alias("scope"), F.lit("DEPENDENCY").alias("family"))
    return signals.unionByName(types)


@query("""WITH m AS (SELECT 'rel:orders.o_custkey->customer.c_custkey' AS subject, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))::DOUBLE / (SELECT count(DISTINCT o_custkey) FROM orders) AS c, (SELECT count(DISTINCT c_custkey)::DOUBLE / count(*) FROM customer) AS u
UNION ALL SELECT 'rel:lineitem.l_orderkey->orders.o_orderkey', (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem), (SELECT count(DISTINCT o_orderkey)::DOUBLE / count(*) FROM orders)
UNION ALL SELECT 'rel:customer.c_nationkey->supplier.s_nationkey', (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier))::DOUBLE / (SELECT count(DISTINCT c_nationkey) FROM customer), (SELECT count(DISTINCT s_nationkey)::DOUBLE / count(*) FROM supplier)),
s AS (SELECT subject, round((round(c, 12) + round(CASE WHEN u < 1 THEN -u ELSE u END, 12) + 0.75) / 2.75, 9) AS score FROM m) SELECT subject, score, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM s""")
def fusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.scores(relationship_evidence(spark, sf_dir)).select("subject", F.round("score", 9).alias("score"), "band")


@query("""WITH v AS (SELECT CAST(o_custkey AS VARCHAR) AS canonical_ref, o_orderkey, o_orderpriority, o_orderdate FROM orders) SELECT canonical_ref, first(o_orderpriority ORDER BY o_orderdate DESC, printf('%012d', o_orderkey)) AS value, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'RESOLVED_BY_POLICY' ELSE 'NO_CONFLICT' END AS state FROM v GROUP BY 1""")
def canonical_most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    values = o.select(F.col("o_custkey").cast("string").alias("canonical_ref"), F.lit("priority").alias("attribute"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("value_ref"), F.col("o_orderstatus").alias("source_id"), F.col("o_orderpriority").alias("value"), F.col("o_orderdate").alias("observed_at"))
    return canonical.survivors(values, "MOST_RECENT_VALID").select("canonical_ref", "value", "state")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS canonical_ref, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS value, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 'NO_CONFLICT' ELSE 'REVIEW_REQUIRED' END AS state FROM orders GROUP BY 1""")
def canonical_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    values = o.select(F.col("o_custkey").cast("string").alias("canonical_ref"), F.lit("status").alias("attribute"), F.col("o_orderkey").cast("string").alias("value_ref"), F.lit("x").alias("source_id"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("observed_at"))
    return canonical.survivors(values, "CONSENSUS").select("canonical_ref", "value", "state")


@query()
def canonical_record_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = people(spark, sf_dir)
    return canonical.record_map(records, entity_resolution.resolve(records, ER)[1], "customer")


# --- scale, evaluation, privacy, sources ------------------------------------------------------------------------------


@query("""SELECT CAST(('0x' || substr(sha256('7:' || user_id), 1, 16))::UBIGINT % 8 AS INTEGER) AS partition, count(*) AS rows, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1""")
def scale_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("partition", scale.route("HASH", F.col("user_id"), 8, 7)).withColumn("value", money("value"))
    return scale.partial(rows, "value").select("partition", "rows", F.col("total").cast("double").alias("total"))


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS nulls, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem")
def scale_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("partition", scale.route("HASH", F.col("l_orderkey"), 16)).withColumn("q", money("l_quantity"))
    return scale.merged(scale.partial(rows, "q")).select("rows", "nulls", F.col("total").cast("double").alias("total"))


@query("SELECT 4 AS partitions, min(n) AS least, max(n) AS most, round(max(n) * 4.0 / sum(n), 9) AS ratio FROM (SELECT least((l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 45)::INT, 3) AS p, count(*) AS n FROM lineitem GROUP BY 1)")
def scale_range_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(scale.route("RANGE", F.col("l_quantity"), 4, boundaries=(10, 20, 45)).alias("partition"))
    return scale.skew(rows, 4).select("partitions", "least", "most", F.round("ratio", 9).alias("ratio"))


@query("SELECT p_type, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def scale_fd_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.fd_violations(table(spark, sf_dir, "part"), "p_type", "p_brand")


@query("SELECT event_id FROM events ORDER BY sha256('3:' || event_id), event_id LIMIT 50")
def source_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.hash_sample(table(spark, sf_dir, "events"), "event_id", 50, 3).select("event_id")


@query("""SELECT sha256('orders:["' || o_orderkey || '"]') AS ref FROM orders""")
def source_record_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_references(table(spark, sf_dir, "orders", ["o_orderkey"]), "orders", ["o_orderkey"]).select(F.col("_record_ref").alias("ref"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def source_bounded_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.bounded(table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]), 100, ["o_orderkey"])[0]


@query("""WITH s AS (SELECT doc_id, quality AS truth, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)) SELECT tp, fp, fn, tn, round(tp * 1.0 / (tp + fp), 9) AS precision, round(tp * 1.0 / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM
(SELECT count(*) FILTER (WHERE truth = 1 AND p = 1) tp, count(*) FILTER (WHERE truth = 0 AND p = 1) fp, count(*) FILTER (WHERE truth = 1 AND p = 0) fn, count(*) FILTER (WHERE truth = 0 AND p = 0) tn FROM s)""")
def evaluate_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents", ["doc_id", "n_chars"]), "doc_id")
    out = evaluation.classification(rows.select(F.col("quality").alias("truth"), (F.col("n_chars") > 300).cast("int").alias("predicted")))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def ranking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents", ["doc_id", "source", "n_chars"]), "doc_id")
    return rows.select(F.col("source").alias("query"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("item"), (1 - F.col("quality")).alias("label"), F.col("n_chars").cast("double").alias("score"))


RANKED = "WITH r AS (SELECT source AS query, printf('%012d', doc_id) AS item, 1 - quality AS label, n_chars AS score FROM labels JOIN documents USING (doc_id)), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS i FROM r)"


@query(RANKED + ", h AS (SELECT *, sum(label) OVER (PARTITION BY query ORDER BY i) AS hits FROM p) SELECT query, round(sum(CASE WHEN label = 1 THEN hits * 1.0 / i END) / nullif(sum(label), 0), 9) AS average_precision FROM h GROUP BY query")
def evaluate_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.average_precision(ranking_rows(spark, sf_dir)).select("query", F.round("average_precision", 9).alias("average_precision"))


@query(RANKED + ", q AS (SELECT query, count(*) n, sum(label) pos, min(CASE WHEN label = 1 THEN i END) AS f, count(*) FILTER (WHERE label = 1 AND i <= 3) AS h3 FROM p GROUP BY query HAVING sum(label) > 0 AND count(*) >= 2) SELECT count(*) AS eligible, round(avg(1.0 / f), 9) AS mrr, round(avg(h3 * 1.0 / pos), 9) AS recall_3 FROM q")
def evaluate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ranking(ranking_rows(spark, sf_dir)).select("eligible", F.round("mrr", 9).alias("mrr"), F.round("recall_3", 9).alias("recall_3"))


@query("""SELECT split, count(*) AS rows FROM (SELECT CASE WHEN b < 60 THEN 'DEVELOPMENT' WHEN b < 80 THEN 'CALIBRATION' ELSE 'TEST' END AS split FROM (SELECT CAST(('0x' || substr(sha256('18:' || user_id), 1, 8))::UBIGINT % 100 AS INTEGER) AS b FROM events)) GROUP BY 1""")
def evaluate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.split(table(spark, sf_dir, "events"), "user_id", 18).groupBy("split").agg(F.count("*").alias("rows"))


@query("""WITH s AS (SELECT quality AS label, least(n_chars / 3000.0, 1) AS score FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold) SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS selected, round(count(*) FILTER (WHERE score >= threshold AND label = 1) * 1.0 / nullif(count(*) FILTER (WHERE score >= threshold), 0), 9) AS precision FROM s, t GROUP BY threshold""")
def evaluate_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents", ["doc_id", "n_chars"]), "doc_id")
    out = evaluation.threshold_frontier(rows.select(F.col("quality").alias("label"), F.least(F.col("n_chars") / 3000.0, F.lit(1.0)).alias("score")))
    return out.select("threshold", "selected", F.round("precision", 9).alias("precision"))


@query("""WITH b AS (SELECT o_orderkey % 100 AS cluster, o_custkey % 30 AS entity, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT sum(n) s FROM b GROUP BY cluster), e AS (SELECT sum(n) s FROM b GROUP BY entity)
SELECT (SELECT sum(n * (n - 1) / 2) FROM b)::BIGINT AS tp, ((SELECT sum(s * (s - 1) / 2) FROM c) - (SELECT sum(n * (n - 1) / 2) FROM b))::BIGINT AS fp, ((SELECT sum(s * (s - 1) / 2) FROM e) - (SELECT sum(n * (n - 1) / 2) FROM b))::BIGINT AS fn""")
def evaluate_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return evaluation.entity_metrics(o.select(F.col("o_orderkey").alias("record"), (F.col("o_orderkey") % 100).alias("cluster")), o.select(F.col("o_orderkey").alias("record"), (F.col("o_custkey") % 30).alias("entity"))).select("tp", "fp", "fn")


@query("""SELECT 'c_name' AS "column", count(*) AS scanned, CAST(0 AS BIGINT) AS sensitive, count(*) AS unknown, false AS clean FROM customer UNION ALL SELECT 'phone', count(*), count(*), CAST(0 AS BIGINT), false FROM customer""")
def privacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("phone", F.concat(F.lit("+1 555 "), F.lpad(F.col("c_custkey").cast("string"), 7, "0")))
    return privacy.scan(rows, ["c_name", "phone"])


@query("SELECT c_custkey, '<REDACTED_EMAIL>' AS mail, CASE WHEN c_custkey % 2 = 0 THEN 'user <REDACTED_EMAIL> left' ELSE '<REDACTED_UNKNOWN>' END AS log FROM customer")
def privacy_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@mail.example"))
    log = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("user "), mail, F.lit(" left"))).otherwise("nothing here")
    return table(spark, sf_dir, "customer").select("c_custkey", privacy.masked(mail, privacy.category(mail)).alias("mail"), privacy.sanitized(log).alias("log"))


@query(f"""SELECT c_custkey, 'psn_' || sha256(unhex('{bytes(b ^ 0x5C for b in b"an example key".ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in b"an example key".ljust(64, bytes(1))).hex()}') || encode('customer:1:' || c_name)))) AS pseudonym FROM customer""")
def privacy_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", privacy.pseudonym(F.col("c_name"), b"an example key", "customer").alias("pseudonym"))


@query()
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "n_chars", "lang"]).join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select(F.col("source").alias("query"), F.col("doc_id").cast("string").alias("item"), F.col("quality").cast("double").alias("label"), F.log1p("n_chars").alias("size"), F.when(F.col("lang") == "en", 1.0).alias("english"))
    model = ranking.train(rows, ["size", "english"])
    return ranking.scored(rows, ["size", "english"], model).select("query", "item", F.round("probability", 6).alias("probability"))


# --- views -------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40")
def view_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.page(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 20, 40, o_orderstatus="F").select("o_orderkey", "o_orderstatus")


@query("""WITH c AS (SELECT p_type AS "group", p_brand AS value, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY "group") AS k FROM c) SELECT "group", value, n, CAST(rank AS INTEGER) AS rank, greatest(k - 3, 0) AS hidden FROM r WHERE rank <= 3""")
def view_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.breakdown(table(spark, sf_dir, "part"), "p_type", "p_brand", 3)


@query("""SELECT b AS bin, lo AS low, hi AS high, (SELECT count(*) FROM lineitem WHERE l_quantity >= lo AND (l_quantity < hi OR (b = 2 AND l_quantity <= hi))) AS n FROM (VALUES (0, 0.0::DOUBLE, 10.0::DOUBLE), (1, 10.0, 30.0), (2, 30.0, 50.0)) AS v(b, lo, hi)""")
def view_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.distribution(table(spark, sf_dir, "lineitem"), "l_quantity", [0, 10, 30, 50])


@query("SELECT l_returnflag AS down, l_linestatus AS across, count(*) AS n, round(avg(l_discount), 9) AS mean FROM lineitem GROUP BY ALL")
def view_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.heat_map(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_discount").withColumn("mean", F.round("mean", 9))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def quality_referential_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = R("fk", "DECLARED_REFERENTIAL_INTEGRITY", "orders", ("o_custkey",), target="customer", target_columns=("c_custkey",))
    targets = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return quality.affected(table(spark, sf_dir, "orders"), rule, "o_orderkey", {"customer": targets}).where("affected").select("o_orderkey")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def quality_trim_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\u00a0")).alias("day"))
    fixed = quality.propose(rows, R("t", "NORMALIZATION_OPPORTUNITY", "orders", ("day",), repair="trim_whitespace"), "o_orderkey").kept
    return fixed.select("o_orderkey", F.col("day").cast("date").alias("day"))


@query("SELECT o_custkey, o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL")
def truth_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"))


@query("SELECT (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS narrow, (SELECT sum(n * n)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) AS wide, (SELECT sum(n * n) > 20000 FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) AS refused")
def scale_fanout_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two joins, told before they are made, and one that the guard refuses."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem", ["l_orderkey"])
    narrow = scale.fanout(o.select(F.col("o_orderkey").alias("k")), l.select(F.col("l_orderkey").alias("k")), "k", 1 << 40)
    wide = scale.fanout(o.select("o_custkey"), o.select("o_custkey"), "o_custkey", 1 << 40)
    try:
        scale.fanout(o.select("o_orderstatus"), o.select("o_orderstatus"), "o_orderstatus", 20_000)
        refused = False
    except scale.ScaleError as error:
        refused = error.code == "LARGE_JOIN_FANOUT"
    return spark.createDataFrame([(int(narrow), int(wide), refused)], "narrow long, wide long, refused boolean")


@query("""SELECT a.n_name AS l, b.n_name AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name""")
def scale_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_name", F.array(F.col("n_regionkey").cast("string")).alias("blocks"))
    return scale.block_pairs(rows, "n_name", "blocks", 1000)


@query("SELECT user_id, count(*) AS n, count(DISTINCT CAST(('0x' || substr(sha256('5:' || event_id), 1, 16))::UBIGINT % 4 AS INTEGER)) AS partitions FROM events GROUP BY 1 HAVING count(*) > 1")
def scale_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("partition", scale.route("HASH", F.col("event_id"), 4, 5))
    return scale.cross_partition_duplicates(rows, "user_id")


@query("""WITH s AS (SELECT event_id, ('0x' || substr(sha256('2:' || event_id), 1, 16))::UBIGINT AS h FROM events) SELECT event_id FROM s WHERE h < 1844674407370955264::UBIGINT""")
def scale_ratio_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.hash_sample(table(spark, sf_dir, "events"), "event_id", 0.1, seed=2).select("event_id")


@query("""SELECT lhs, rhs, round(error, 9) AS error FROM (SELECT 'p_type' AS lhs, 'p_brand' AS rhs, (SELECT (count(DISTINCT (p_type, p_brand)) - count(DISTINCT p_type)) * 1.0 / count(*) FROM part) AS error UNION ALL SELECT 'p_brand', 'p_type', (SELECT (count(DISTINCT (p_type, p_brand)) - count(DISTINCT p_brand)) * 1.0 / count(*) FROM part)) WHERE error <= 0.2""")
def deps_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.functional_dependencies(table(spark, sf_dir, "part", ["p_type", "p_brand"]), max_arity=1, max_error=0.2).select("lhs", "rhs", F.round("error", 9).alias("error"))


@query("SELECT p_partkey FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1)")
def deps_violating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.violating_rows(table(spark, sf_dir, "part"), ["p_type"], "p_brand", "p_partkey")


@query("""SELECT 'dispositions' AS "check", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS discrepancies, 'BLOCKING' AS severity FROM orders WHERE o_orderstatus = 'P'""")
def validate_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    expected = o.select(F.col("o_orderkey").alias("record_ref"), F.lit("EMITTED").alias("disposition"))
    observed = o.select(F.col("o_orderkey").alias("record_ref"), F.when(F.col("o_orderstatus") == "P", "QUARANTINED").otherwise("EMITTED").alias("disposition"))
    return validation.dispositions(expected, observed)


@query("""WITH e AS (SELECT o_custkey AS g, list_sort(list(o_orderkey)) AS m FROM orders GROUP BY 1), o AS (SELECT CASE WHEN o_orderkey % 40 = 0 THEN -1 ELSE o_custkey END AS g, list_sort(list(o_orderkey)) AS m FROM orders GROUP BY 1),
d AS (SELECT m FROM e WHERE m NOT IN (SELECT m FROM o) UNION ALL SELECT m FROM o WHERE m NOT IN (SELECT m FROM e))
SELECT 'membership' AS "check", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS discrepancies, 'BLOCKING' AS severity FROM d""")
def validate_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups under other names are the same; those that lost a member to another group aren't."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("group"), F.col("o_orderkey").cast("string").alias("member"))
    moved = F.when(F.col("member").cast("long") % 40 == 0, "other").otherwise(F.concat(F.lit("entity-"), "group"))
    return validation.membership(o, o.withColumn("group", moved))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS canonical_ref, coalesce(min(o_orderpriority) FILTER (WHERE o_orderstatus = 'F' AND r = 1), min(o_orderpriority) FILTER (WHERE o_orderstatus = 'O' AND r = 1)) AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY printf('%012d', o_orderkey)) AS r FROM orders) GROUP BY 1""")
def canonical_preferred_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    values = o.select(F.col("o_custkey").cast("string").alias("canonical_ref"), F.lit("priority").alias("attribute"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("value_ref"), F.col("o_orderstatus").alias("source_id"), F.col("o_orderpriority").alias("value"), F.col("o_orderdate").alias("observed_at"))
    return canonical.survivors(values, "PREFERRED_SOURCE", ("F", "O")).select("canonical_ref", "value")


# --- further evidence, budgets, reviews and checks ------------------------------------------------------------------


@query("""WITH g AS (SELECT source AS g, avg(quality)::DOUBLE AS m FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY 1), r AS (SELECT unnest(range(100)) AS r),
u AS (SELECT r, m, ('0x' || substr(sha256('7:' || g || ':' || r), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u FROM g, r),
w AS (SELECT r, m, (SELECT count(*) FROM (SELECT sum(exp(-1.0::DOUBLE) / factorial(k::INTEGER)::DOUBLE) OVER (ORDER BY k) AS t FROM range(15) AS s(k)) WHERE t <= u) AS w FROM u),
e AS (SELECT r, sum(w * m) / nullif(sum(w), 0) AS mean FROM w GROUP BY r)
SELECT (SELECT round(avg(m), 9) FROM g) AS point, round(quantile_cont(mean, 0.025), 9) AS lower, round(quantile_cont(mean, 0.975), 9) AS upper, (SELECT count(*) FROM g) AS groups, 'OK' AS status FROM e""")
def evaluate_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", ["doc_id", "source"]).join(table(spark, sf_dir, "labels", ["doc_id", "quality"]), "doc_id")
    return evaluation.mean_interval(rows, "source", "quality", 7, 100).withColumns({c: F.round(c, 9) for c in ("point", "lower", "upper")})


@query("""SELECT 'fine' AS rule_id, 'APPLICABLE' AS applicability, NULL::VARCHAR AS reason, count(o_orderstatus) AS evaluated, count(*) FILTER (WHERE o_orderstatus = 'P') AS affected FROM orders
UNION ALL SELECT 'keys', 'APPLICABLE', NULL, count(o_custkey), coalesce((SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 1), 0) FROM orders UNION ALL SELECT 'off', 'NOT_APPLICABLE', 'RULE_DISABLED', NULL, NULL UNION ALL SELECT 'gone', 'INSUFFICIENT_EVIDENCE', 'TABLE_ABSENT: invoices', NULL, NULL
UNION ALL SELECT 'column', 'INSUFFICIENT_EVIDENCE', 'COLUMN_ABSENT: o_colour', NULL, NULL UNION ALL SELECT 'pattern', 'INSUFFICIENT_EVIDENCE', 'DETECTOR_FAILED: KeyError', NULL, NULL""")
def quality_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule with its state and reason, and the figures of those that apply."""
    tables = {"orders": table(spark, sf_dir, "orders")}
    rules = [R("fine", "ALLOWED_DOMAIN", "orders", ("o_orderstatus",), allowed=("F", "O")), R("keys", "UNIQUE_VALUES", "orders", ("o_custkey",)), R("off", "REQUIRED_VALUE", "orders", ("o_orderkey",), enabled=False), R("gone", "REQUIRED_VALUE", "invoices", ("id",)), R("column", "REQUIRED_VALUE", "orders", ("o_colour",)), R("pattern", "EXPECTED_PATTERN", "orders", ("o_orderpriority",), pattern="NO_SUCH_PATTERN")]
    states = quality.applicability_rows(spark, quality.applicability(tables, rules))
    return states.join(quality.evaluate(tables, rules, "o_orderkey").select("rule_id", "evaluated", "affected"), "rule_id", "left")


@query("""SELECT 'v' AS "column", primitive, count(*) AS n FROM (SELECT CASE l_linenumber % 6 WHEN 0 THEN 'integer' WHEN 1 THEN 'real' WHEN 2 THEN 'boolean' WHEN 3 THEN 'datetime' WHEN 4 THEN 'string' END AS primitive FROM lineitem) WHERE primitive IS NOT NULL GROUP BY 2 UNION ALL SELECT 'l_quantity', 'real', count(l_quantity) FROM lineitem""")
def profile_observed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("-12", "1.5e3", "True", "2026-01-02", "x 1", "n/a")))
    rows = table(spark, sf_dir, "lineitem", ["l_linenumber", "l_quantity"]).select(F.element_at(kinds, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("v"), "l_quantity")
    return profiling.observed_types(rows, markers=("n/a",))


@query("""WITH u AS (SELECT 'p_partkey' AS columns WHERE (SELECT count(DISTINCT p_partkey) = count(*) FROM part) UNION ALL SELECT 'p_name' WHERE (SELECT count(DISTINCT p_name) = count(*) FROM part))
SELECT 'identity:erp.part(' || columns || ')' AS identity, columns, (SELECT count(*) FROM part) AS eligible, CAST(0 AS BIGINT) AS nulls, 'REVIEW_REQUIRED' AS state FROM u""")
def deps_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    return dependencies.identity_candidates(rows, "erp", "part", dependencies.search_unique(rows, budget=dependencies.Budget(arity=1))).select("identity", "columns", "eligible", "nulls", "state")


@query("""SELECT 'number,nation' AS rule, count(*) AS keys, count(*) FILTER (WHERE c_custkey % 2 = 0) AS pairs, CAST(2 AS BIGINT) AS most FROM customer UNION ALL SELECT 'name', count(*) + count(*) FILTER (WHERE c_custkey % 4 = 2), count(*) FILTER (WHERE c_custkey % 4 = 0), 2 FROM customer""")
def er_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_resolution.pair_counts(entity_resolution.load(people(spark, sf_dir)), ER)


@query("""WITH a AS (SELECT o_orderstatus AS v, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM orders) AS s FROM orders GROUP BY 1), b AS (SELECT l_linestatus AS v, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM lineitem) AS s FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag AS v, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM lineitem) AS s FROM lineitem GROUP BY 1)
SELECT 'orders.o_orderstatus' AS "left", 'lineitem.l_linestatus' AS "right", round(coalesce((SELECT sum(least(a.s, b.s)) FROM a JOIN b USING (v)), 0), 9) AS distribution UNION ALL SELECT 'orders.o_orderstatus', 'lineitem.l_returnflag', round(coalesce((SELECT sum(least(a.s, c.s)) FROM a JOIN c USING (v)), 0), 9)""")
def match_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [profiling.value_counts(table(spark, sf_dir, t, c), c).withColumn("column", F.concat(F.lit(f"{t}."), "column")) for t, c in (("orders", ["o_orderstatus"]), ("lineitem", ["l_linestatus", "l_returnflag"]))]
    pairs = spark.createDataFrame([("orders.o_orderstatus", "lineitem.l_linestatus"), ("orders.o_orderstatus", "lineitem.l_returnflag")], "left string, right string")
    return matching.with_distributions(pairs, counts[0].unionByName(counts[1])).withColumn("distribution", F.round("distribution", 9))


@query("""WITH c AS (SELECT p_brand AS "left", p_type AS "right", count(*) AS n FROM part GROUP BY ALL), k AS (SELECT "left", "right", row_number() OVER (PARTITION BY "left" ORDER BY n DESC, "right") AS rank FROM c),
t AS (SELECT DISTINCT p_brand AS "left", 'ECONOMY' AS "right" FROM part), h AS (SELECT t."left", k.rank FROM t LEFT JOIN k ON t."left" = k."left" AND t."right" = k."right" AND k.rank <= 3)
SELECT 'count' AS matcher, count(*) AS truths, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr, round(avg(coalesce((rank <= 1)::INT, 0)), 9) AS recall_1, round(avg(coalesce((rank <= 3)::INT, 0)), 9) AS recall_3 FROM h""")
def match_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("left"), F.col("p_type").alias("right")).agg(F.count("*").alias("count"))
    truth = counts.select("left", F.lit("ECONOMY").alias("right")).distinct()
    return matching.evaluated(matching.ranked(counts, ["count"], 3), truth).withColumns({c: F.round(c, 9) for c in ("mrr", "recall_1", "recall_3")})


@query("""WITH m AS (SELECT 'rel:orders.o_custkey->customer.c_custkey' AS subject, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))::DOUBLE / (SELECT count(DISTINCT o_custkey) FROM orders) AS c, (SELECT count(DISTINCT c_custkey)::DOUBLE / count(*) FROM customer) AS u
UNION ALL SELECT 'rel:lineitem.l_orderkey->orders.o_orderkey', (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem), (SELECT count(DISTINCT o_orderkey)::DOUBLE / count(*) FROM orders)
UNION ALL SELECT 'rel:customer.c_nationkey->supplier.s_nationkey', (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier))::DOUBLE / (SELECT count(DISTINCT c_nationkey) FROM customer), (SELECT count(DISTINCT s_nationkey)::DOUBLE / count(*) FROM supplier))
SELECT subject, round((round(c, 12) + round(CASE WHEN u < 1 THEN -u ELSE u END, 12) + 0.75) / 2.75, 9) AS score, CASE WHEN subject LIKE 'rel:orders%' THEN 'REVIEW_REQUIRED' ELSE 'INCOMPLETE_REQUIRED_EVIDENCE' END AS state,
CASE WHEN subject LIKE 'rel:orders%' THEN '' ELSE 'producer:profile' END AS missing, CAST(1 + 2 * (c >= 1)::INT + (u >= 1)::INT + (subject LIKE 'rel:orders%')::INT AS INTEGER) AS supports, CAST(2 * (c < 1)::INT + (u < 1)::INT AS INTEGER) AS contradicts FROM m""")
def fusion_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for review, of which two lack the evidence of a profile."""
    signals = relationship_evidence(spark, sf_dir)
    spread = profiling.spread(table(spark, sf_dir, "orders", ["o_custkey"]), ["o_custkey"], limit=None).withColumn("subject", F.lit("rel:orders.o_custkey->customer.c_custkey"))
    profile = fusion.signals_of(spread, "PROFILE", F.lit("distinct_ratio"), F.col("distinct_ratio"))
    found = fusion.decisions(fusion.deduplicated(signals.unionByName(profile)), required=("DEPENDENCY", "PROFILE"))
    return found.select("subject", F.round("score", 9).alias("score"), "state", F.concat_ws(",", "missing").alias("missing"), F.size("supports").alias("supports"), F.size("contradicts").alias("contradicts"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS canonical_ref, 'priority' AS attribute, CASE WHEN count(DISTINCT lower(trim(v))) = 1 THEN 'FORMAT_CONFLICT' ELSE 'VALUE_CONFLICT' END AS kind, count(DISTINCT v) AS candidates, count(*) AS "values"
FROM (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderstatus) || ' ' ELSE lower(o_orderstatus) END AS v FROM orders) GROUP BY 1 HAVING count(DISTINCT v) > 1""")
def canonical_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.upper("o_orderstatus"), F.lit(" "))).otherwise(F.lower("o_orderstatus"))
    values = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("canonical_ref"), F.lit("priority").alias("attribute"), F.col("o_orderkey").cast("string").alias("source_id"), spelled.alias("value"))
    return canonical.conflict_records(values)


@query("""SELECT s || c_custkey AS record_ref, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS size, CASE WHEN c_custkey % 4 = 2 THEN 'REFUSED_DISCONNECTED' WHEN c_custkey % 3 = 0 THEN 'REVIEW_REQUIRED' ELSE 'PROPOSED' END AS state
FROM customer, (VALUES ('crm-'), ('erp-')) AS v(s) WHERE s = 'crm-' OR c_custkey % 2 = 0""")
def canonical_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by number, of which those that no link holds together are refused."""
    number = F.regexp_extract("record_ref", "([0-9]+)", 1).cast("long")
    decided = F.when(number % 3 == 0, "REVIEW_CLUSTER").otherwise("CANDIDATE_CLUSTER")
    clusters = people(spark, sf_dir).select(number.alias("cluster"), "record_ref", decided.alias("decision"))
    edges = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("crm-"), "c_custkey").alias("l"), F.concat(F.lit("erp-"), "c_custkey").alias("r"))
    return canonical.memberships(clusters, edges, "customer").select("record_ref", "size", "state")


@query(f"""SELECT * FROM (SELECT 'tables' AS "check", 'FAIL' AS status, CAST(2 AS BIGINT) AS discrepancies, 'BLOCKING' AS severity UNION ALL SELECT 'fact_count', CASE WHEN count(*) FILTER (WHERE l_linenumber = 7) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FILTER (WHERE l_linenumber = 7), 'BLOCKING' FROM lineitem
UNION ALL SELECT 'allocation', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*), 'BLOCKING' {LINES} WHERE NOT EXISTS (SELECT 1 FROM lineitem x JOIN orders y ON x.l_orderkey = y.o_orderkey WHERE x.l_orderkey = l.l_orderkey AND x.l_linenumber = l.l_linenumber AND x.l_suppkey = l.l_suppkey AND x.l_suppkey % 9 <> 0 AND y.o_custkey = o.o_custkey)
UNION ALL SELECT 'semantic:lines', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*), 'BLOCKING' FROM (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS m {LINES} GROUP BY 1) WHERE n <> m)""")
def validate_star_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table set, fact count, allocation and a metric, each against an expectation that the star doesn't meet in part."""
    tables = published_star(spark, sf_dir)
    fact, lines = tables["fact_line"], line_rows(spark, sf_dir)
    names = spark.createDataFrame([(t,) for t in tables], "table string")
    said = F.when(F.col("l_suppkey") % 9 == 0, F.lit("elsewhere")).otherwise(F.col("l_suppkey").cast("string"))
    asked = ask(spark, sf_dir, {"part.brand": "brand", "lines": "lines"}, metrics=("lines",), group_by=("part.brand",))
    expected = lines.join(table(spark, sf_dir, "part", ["p_partkey", "p_brand"]), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.count_if(F.col("l_returnflag") != "R").alias("lines"))
    return validation.gate([
        validation.table_set([*[t for t in tables if t != "dim_date"], "dim_branch"], names),
        validation.fact_count(lines.where("l_linenumber <> 7"), fact),
        validation.allocation(lines, fact, ["l_orderkey", "l_linenumber"], {"supplier_key": (said, tables["dim_supplier"], "supplier_key"), "customer_key": (F.col("o_custkey"), tables["dim_customer"], "customer_key")}),
        validation.semantic_cross_check(asked, expected, ["brand"], "lines"),
    ])


@query("""WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM part) AS p), k AS (SELECT 'customer' AS "table", c AS rows, least(c, 1200) AS kept FROM n UNION ALL SELECT 'orders', o, least(o, greatest(1200 - c, 0)) FROM n UNION ALL SELECT 'part', p, least(p, greatest(1200 - c - o, 0)) FROM n)
SELECT "table", rows, kept, CASE WHEN kept = rows THEN 'FULLY_OBSERVED' WHEN kept > 0 THEN 'PARTIALLY_OBSERVED' ELSE 'NOT_OBSERVED' END AS scope FROM k""")
def source_wide_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("customer", "orders", "part")
    return files.bounded_source({t: table(spark, sf_dir, t) for t in names}, 1200, {"customer": ["c_custkey"], "orders": ["o_orderkey"], "part": ["p_partkey"]})[1]


@query(f"SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price {LINES} WHERE p_size <= 10 OR p_size > 10 GROUP BY ALL")
def semantic_built_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question to the model that follows from the published star itself."""
    tables = published_star(spark, sf_dir)
    model = semantic.build_model({n: tables[f"dim_{n}"] for n in ("customer", "part", "supplier", "date")}, "line", "fact_line", {"customer_key": "customer", "part_key": "part", "supplier_key": "supplier"}, {"ordered": "order_date_key", "shipped": "ship_date_key"},
                                 {"price": ("price", semantic.ADDITIVE, "SUM(price)"), "discount": ("discount", semantic.NON_ADDITIVE, "AT GRAIN")}, {"date": ("year", "quarter", "month")})
    out = semantic.query(model, tables, semantic.Request(("price",), group_by=("customer.segment", "date.year"), time_role="ordered"))
    return out.select(F.col("`customer.segment`").alias("segment"), F.col("`date.year`").alias("year"), F.col("price").cast("double").alias("price"))


from tessera import queries_discovery, queries_truth  # noqa: E402, F401 - register their queries
