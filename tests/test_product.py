"""Four sources with other column names, one customer identity, one star: the whole way on the small fixture."""

import datetime

from pyspark.sql import functions as F

from tessera.functions.expressions import identity_form
from tessera.operators import canonical, entity_resolution, star, validation
from tessera.plans import semantic

ALIASES = {"order_id": ["order_no", "sale_id", "id"], "customer_name": ["full_name", "client", "buyer"], "email": ["mail", "e_mail"], "phone": ["tel", "phone_no"], "order_date": ["booked_on", "sale_day", "day"], "quantity": ["qty", "units", "amount"]}
SOURCES = {
    "crm": (["order_id", "full_name", "email", "phone", "booked_on", "units"], [("1001", "Alice Smith", "alice@x.example", "555-0101", "2026-01-02", "2"), ("1002", "Bob Brown", "bob@x.example", "555-0102", "2026-01-03", "1"), ("1003", "Orphan", None, None, "2026-01-04", "1")]),
    "erp": (["order_no", "client", "mail", "tel", "order_date", "qty"], [("2001", "Alice S.", "alice@x.example", "555-0101", "2026-01-02", "3"), ("2002", "Bob Brown", "bob@x.example", "555-0102", "2026-01-03", "1"), ("2003", "Alice Smith", "other@x.example", "555-0199", "2026-01-04", "9")]),
    "sales": (["SALE_ID", "buyer", "e_mail", "phone_no", "sale_day", "qty"], [("3001", "Alice Smith", "alice@x.example", "555-0101", "2026-01-02", "4"), ("3002", "Bob B.", "bob@x.example", "555-0102", "2026-01-03", "2"), ("3003", None, None, None, "2026-01-05", "1")]),
    "legacy": (["id", "full_name", "mail", "tel", "day", "amount"], [("4001", "Alice Smith", "alice@x.example", "555-0101", "2026-01-02", "5"), ("4002", "Bob Brown", "bob@x.example", "555-0102", "2026-01-03", "1"), ("4003", "Missing email", "", "", "2026-01-05", "1")]),
}


def test_four_sources(spark):
    tables = {s: spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names)) for s, (names, rows) in SOURCES.items()}
    orders = star.coerced(star.union_of_sources(tables, ALIASES), {"order_date": "date", "quantity": "decimal(38,9)"})
    records = orders.select(F.concat_ws(":", "source_id", "order_id").alias("record_ref"), "source_id", identity_form(F.col("customer_name")).alias("name"), identity_form(F.col("email")).alias("email"), identity_form(F.col("phone"), digits_only=True).alias("phone"))
    c = entity_resolution.Comparison
    spec = entity_resolution.Spec((c("name", "jaro_winkler", (0.95, 0.85)), c("email"), c("phone")), (("email", "phone"), ("name",)), anchors=("email",))
    edges, clusters = entity_resolution.resolve(records, spec)
    groups = sorted(tuple(r.members) for r in clusters.where("decision = 'CANDIDATE_CLUSTER'").collect())
    assert groups == [("crm:1001", "erp:2001", "legacy:4001", "sales:3001"), ("crm:1002", "erp:2002", "legacy:4002", "sales:3002")]
    assert not any("erp:2003" in g for g in groups)

    names = canonical.record_map(records, clusters, "customer")
    consolidated = names.where("disposition = 'CONSOLIDATED'")
    people = star.build_dimension(consolidated.select("canonical_ref").distinct(), "customer", F.col("canonical_ref"), {"ref": F.col("canonical_ref")})
    lines = orders.withColumn("record_ref", F.concat_ws(":", "source_id", "order_id")).join(names, "record_ref")
    fact, quarantine = star.build_fact(lines, ["source_id", "order_id"], [star.ForeignKey(F.col("canonical_ref"), people)], {"order_date": F.col("order_date")}, {"quantity": F.col("quantity")}, lineage="record_ref")
    days = star.build_date_dimension(spark, orders.select("order_date"), "2026-01-01", "2026-01-05")
    # eight rows share an identity, and their quantities add up to 19
    assert fact.count() == 8 and fact.agg(F.sum("quantity")).first()[0] == 19 and quarantine.count() == 4
    counts = {r.source_id: (r.input, r.emitted, r.quarantined, r.unresolved) for r in star.accounting_by_source(orders, fact, quarantine).collect()}
    assert counts == {s: (3, 2, 1, 0) for s in SOURCES}

    expected = lines.where("disposition = 'CONSOLIDATED'").groupBy(F.col("canonical_ref").alias("slice")).agg(F.sum("quantity").alias("value"))
    checks = validation.gate(
        [
            validation.unique(fact, ["source_id", "order_id"]),
            validation.foreign_keys(fact, "customer_key", people.rows, "customer_key"),
            validation.date_coverage(orders, "order_date", days.rows),
            validation.aggregates(expected, fact, [("customer_key", people.rows, "customer_key")], "quantity"),
            validation.lineage(consolidated, "record_ref", fact),
        ]
    )
    assert validation.verdict(checks).first().status == "PASS"

    model = semantic.Model(
        (semantic.DimensionModel("date", "dim_date", "date_key", (semantic.Attribute("date.day", "full_date", "DATE"),)),),
        (semantic.FactModel("order", "fact", (semantic.Metric("quantity", "quantity"),), (semantic.Relationship("date", "order_date_key", time_role="ordered"),)),),
    )
    asked = semantic.Request(("quantity",), group_by=("date.day",), sort=(("date.day", False),), time_role="ordered")
    rows = semantic.query(model, {"fact": fact, "dim_date": days.rows}, asked).collect()
    assert [(r["date.day"], int(r["quantity"])) for r in rows] == [(datetime.date(2026, 1, 2), 14), (datetime.date(2026, 1, 3), 5)]
