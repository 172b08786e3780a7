"""Reconciliation of a star schema with independent expectations: each check gives PASS or FAIL and its count."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(name: str, bad: DataFrame, severity: str = "BLOCKING") -> DataFrame:
    """(check, status, discrepancies, severity) from the rows that shouldn't be."""
    return bad.agg(F.count("*").alias("discrepancies")).select(F.lit(name).alias("check"), F.when(F.col("discrepancies") == 0, "PASS").otherwise("FAIL").alias("status"), "discrepancies", F.lit(severity).alias("severity"))


def same(a: Column, b: Column) -> Column:
    """Equal as numbers where both are numbers, else as trimmed texts; null equals null."""
    x, y = a.cast("string"), b.cast("string")
    nx, ny = x.try_cast("decimal(38,9)"), y.try_cast("decimal(38,9)")
    return F.when(nx.isNotNull() & ny.isNotNull(), nx == ny).otherwise(F.trim(x).eqNullSafe(F.trim(y)))


def not_in(rows: DataFrame, keys: list[str], other: DataFrame, other_keys: list[str]) -> DataFrame:
    """rows whose keys the other table lacks; null keys are lacking, too."""
    right = other.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(other_keys)]).distinct()
    return rows.join(right, [F.col(k) == F.col(f"_o{i}") for i, k in enumerate(keys)], "left_anti")


def foreign_keys(fact: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    return check(f"fk:{column}", not_in(fact.select(column), [column], dimension, [key]))


def unique(rows: DataFrame, keys: list[str], name: str | None = None) -> DataFrame:
    """Repeated keys, null ones being equal."""
    return check(name or f"unique:{','.join(keys)}", rows.groupBy(*keys).count().where("count > 1"))


def duplicate_grain(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    one = rows.groupBy(*keys).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("discrepancies"))
    return one.select(F.lit(f"grain:{','.join(keys)}").alias("check"), F.when(F.col("discrepancies") == 0, "PASS").otherwise("FAIL").alias("status"), "discrepancies", F.lit("BLOCKING").alias("severity"))


def grain_sets(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing, and keys too many: two checks."""
    return check("grain:missing", not_in(expected.select(*keys).distinct(), keys, observed, keys)).unionByName(check("grain:extra", not_in(observed.select(*keys).distinct(), keys, expected, keys)))


def values(expected: DataFrame, observed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows whose columns differ, compared tolerantly, and rows that one side lacks."""
    right = observed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)], F.lit(True).alias("_right"))
    joined = expected.withColumn("_left", F.lit(True)).join(right, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "full")
    differ = reduce(lambda x, y: x | y, [~same(F.col(c), F.col(f"_v{i}")) for i, c in enumerate(columns)])
    return check("values", joined.where(differ | F.col("_left").isNull() | F.col("_right").isNull()))


def table_set(expected: Iterable[str], observed: DataFrame) -> DataFrame:
    """Tables that are missing, and tables too many; observed: (table)."""
    wanted = observed.sparkSession.createDataFrame([(t,) for t in sorted(set(expected))], "table string")
    found = observed.select("table").distinct()
    return check("tables", wanted.join(found, "table", "left_anti").unionByName(found.join(wanted, "table", "left_anti")))


def fact_count(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """By how many rows the counts differ."""
    one = expected.agg(F.count("*").alias("e")).join(observed.agg(F.count("*").alias("o")), F.lit(True)).select(F.abs(F.col("e") - F.col("o")).alias("discrepancies"))
    return one.select(F.lit("fact_count").alias("check"), F.when(F.col("discrepancies") == 0, "PASS").otherwise("FAIL").alias("status"), "discrepancies", F.lit("BLOCKING").alias("severity"))


def allocation(rows: DataFrame, fact: DataFrame, grain: list[str], references: dict[str, tuple[Column, DataFrame, str]]) -> DataFrame:
    """Facts of which no source row of their grain says that they point where they do.

    references: by fact column, (source reference, dimension, its key). References to no member are another check's business.
    """
    left = rows.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(grain)], *[c.cast("string").alias(f"_e{i}") for i, (c, _, _) in enumerate(references.values())])
    told = fact.select(*grain, *references)
    on = [F.col(g) == F.col(f"_g{i}") for i, g in enumerate(grain)]
    for i, (column, (_, dimension, key)) in enumerate(references.items()):
        members = dimension.select(F.col(key).alias(f"_k{i}"), F.col("canonical_ref").alias(f"_c{i}"))
        told = told.join(members, F.col(column) == F.col(f"_k{i}"), "left")
        on.append(F.col(f"_c{i}").isNull() | F.col(f"_c{i}").eqNullSafe(F.col(f"_e{i}")))
    return check("allocation", told.join(left, on, "left_anti"))


def semantic_cross_check(asked: DataFrame, expected: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Groups in which a metric's answer isn't what the expectation says, one-sided groups included."""
    one = values(expected.select(*keys, metric), asked.select(*keys, metric), keys, [metric])
    return one.withColumn("check", F.lit(f"semantic:{metric}"))


def monetary_status(measures: Iterable[str], forbidden: Iterable[str], evidence: Iterable[str] = ()) -> tuple[str, list[str]]:
    """Whether measures of money may be told: those that are forbidden, without evidence for them, aren't validated."""
    open_ones = sorted((set(measures) & set(forbidden)) - set(evidence))
    return ("NOT_VALIDATED", open_ones) if open_ones else ("VALIDATED", [])


def date_coverage(days: DataFrame, column: str, dimension: DataFrame) -> DataFrame:
    return check("dates", not_in(days.select(F.col(column).cast("date").alias("d")).where("d IS NOT NULL").distinct(), ["d"], dimension, ["full_date"]))


def aggregates(expected: DataFrame, observed: DataFrame, slices: list[tuple[str, DataFrame, str]], measure: str, operation: str = "sum") -> DataFrame:
    """Slices of a measure, expected against observed; expected: (slice, value).

    A slice is named by the canonical references of its dimensions, joined by '|'; facts without a member are '<orphan>'.
    """
    return aggregates_together(expected, observed, slices, [("value", measure, operation)])


def aggregates_together(expected: DataFrame, observed: DataFrame, slices: list[tuple[str, DataFrame, str]], wanted: list[tuple[str, str, str]]) -> DataFrame:
    """A check for each of several (column of expected, measure, operation) over the same slices, in one pass over both sides; expected has one row a slice."""
    rows = observed
    parts = []
    for i, (fact_column, dimension, key) in enumerate(slices):
        refs = dimension.select(F.col(key).alias(f"_k{i}"), F.col("canonical_ref").alias(f"_c{i}"))
        rows = rows.join(refs, F.col(fact_column) == F.col(f"_k{i}"), "left")
        parts.append(F.coalesce(F.col(f"_c{i}"), F.lit("<orphan>")))
    totals = {}
    for _, measure, operation in wanted:
        totals.setdefault((operation, measure), {"sum": F.sum, "max": F.max}[operation](measure).alias(f"_o{len(totals)}"))
    places = {at: f"_o{i}" for i, at in enumerate(totals)}
    found = rows.groupBy((F.concat_ws("|", *parts) if parts else F.lit("global")).alias("slice")).agg(*totals.values())
    both = expected.join(found, "slice", "full")
    bad = []
    for i, (value, measure, operation) in enumerate(wanted):
        a, b = F.col(value), F.col(places[operation, measure])
        bad.append(F.count_if(~same(a, b) | a.isNull() | b.isNull()).alias(f"_d{i}"))
    one = both.agg(*bad)
    names = [f"aggregate:{operation}:{measure}" for _, measure, operation in wanted]
    cells = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"_d{i}").alias("discrepancies")) for i, n in enumerate(names)])
    each = one.select(F.explode(cells).alias("x")).select("x.check", "x.discrepancies")
    return each.select("check", F.when(F.col("discrepancies") == 0, "PASS").otherwise("FAIL").alias("status"), "discrepancies", F.lit("BLOCKING").alias("severity"))


def lineage(sources: DataFrame, ref: str, target: DataFrame, column: str = "source_record_refs") -> DataFrame:
    """Source records that the target lacks, and target references that no source has; policy tags don't count."""
    refs = target.select(F.explode(F.from_json(column, "array<string>")).alias("ref")).where(~F.col("ref").rlike("^(?:policy|date-range|synthetic):")).distinct()
    own = sources.select(F.col(ref).cast("string").alias("ref")).distinct()
    return check("lineage:missing", own.join(refs, "ref", "left_anti")).unionByName(check("lineage:unknown", refs.join(own, "ref", "left_anti")))


def membership(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Groups (group, member) that differ as sets, whatever their names."""
    # a group is known by the count, sum and other sum of its members' hashes, so that none is gathered in a row
    def prints(rows: DataFrame) -> DataFrame:
        one, other = F.xxhash64("member").cast("decimal(38,0)"), F.xxhash64("member", F.lit(1)).cast("decimal(38,0)")
        return rows.select("group", "member").distinct().groupBy("group").agg(F.count("*").alias("n"), F.sum(one).alias("s"), F.sum(other).alias("t")).select("n", "s", "t")

    a, b = prints(expected), prints(observed)
    return check("membership", a.exceptAll(b).unionByName(b.exceptAll(a)))


def dispositions(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Records (record_ref, disposition) that one side lacks or that ended otherwise than expected."""
    both = expected.withColumnRenamed("disposition", "e").join(observed.withColumnRenamed("disposition", "o"), "record_ref", "full")
    return check("dispositions", both.where(~F.col("e").eqNullSafe(F.col("o"))))


def snapshot_universe(records: DataFrame, declared: DataFrame) -> DataFrame:
    """Sources whose records aren't all of the one snapshot that is pinned for them, with a fingerprint of its schema.

    records: (source, snapshot); declared: (source, snapshot, schema). Pinned sources without records, sources with records
    that aren't pinned, and sources pinned twice differ, too.
    """
    found = records.groupBy("source").agg(F.min("snapshot").alias("low"), F.max("snapshot").alias("high"), F.count_if(F.col("snapshot").isNull()).alias("without"))
    pinned = declared.groupBy("source").agg(F.min("snapshot").alias("snapshot"), F.countDistinct("snapshot").alias("pins"), F.count_if(F.coalesce(F.trim("schema"), F.lit("")) == "").alias("bare"))
    both = pinned.join(found, "source", "full")
    fine = (F.col("pins") == 1) & (F.col("bare") == 0) & (F.col("without") == 0) & (F.col("low") == F.col("snapshot")) & (F.col("high") == F.col("snapshot"))
    return check("snapshot_universe", both.where(~F.coalesce(fine, F.lit(False))))


def event_errors(events: DataFrame, maps: DataFrame, instances: DataFrame) -> DataFrame:
    """(record_ref, reason) of event records whose map or instance isn't what the source says; a record has one reason, the first.

    events: (record_ref, entity, type), what is expected; maps: (record_ref, entity, type), one a record; instances:
    (entity, kind), of which events have the kind EVENT.
    """
    mapped = maps.select("record_ref", F.col("entity").alias("_entity"), F.col("type").alias("_type"), F.lit(True).alias("_map"))
    known = instances.select("entity", F.col("kind").alias("_kind"), F.lit(True).alias("_instance"))
    both = events.join(mapped, "record_ref", "left").join(known, "entity", "left")
    reason = (
        F.when(F.col("_map").isNull(), "NO_MAP").when(F.col("_instance").isNull(), "NO_INSTANCE").when(~F.col("_kind").eqNullSafe(F.lit("EVENT")), "NOT_AN_EVENT")
        .when(~F.col("_entity").eqNullSafe(F.col("entity")), "ANOTHER_ENTITY").when(~F.col("_type").eqNullSafe(F.col("type")), "ANOTHER_TYPE")
    )
    return both.select("record_ref", reason.alias("reason")).where("reason IS NOT NULL")


def event_relationships(events: DataFrame, maps: DataFrame, instances: DataFrame, needed: DataFrame, declared: DataFrame) -> DataFrame:
    """Event records with a wrong identity, and relationships (relationship) that are needed and not declared; without any event it isn't evaluated."""
    missing = needed.select("relationship").distinct().join(declared.select("relationship").distinct(), "relationship", "left_anti")
    bad = event_errors(events, maps, instances).select("reason").unionByName(missing.select(F.lit("NOT_DECLARED").alias("reason")))
    status = F.when(~F.col("any"), "NOT_EVALUATED").otherwise(F.col("status"))
    some = events.limit(1).agg((F.count("*") > 0).alias("any"))
    return check("event_relationships", bad).join(some, F.lit(True)).select("check", status.alias("status"), "discrepancies", "severity")


def entity_counts(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(type, expected, observed) of the types whose entities (type, entity) differ in number."""
    counts = [rows.groupBy("type").agg(F.countDistinct("entity").alias(n)) for rows, n in ((expected, "expected"), (observed, "observed"))]
    both = counts[0].join(counts[1], "type", "full").fillna(0, ["expected", "observed"])
    return both.where("expected <> observed")


def unexplained_merges(groups: DataFrame, maps: DataFrame) -> DataFrame:
    """(entity, reason) of declared consolidations (entity, record_ref) that the maps (record_ref, entity, disposition) don't show as such.

    Every member has to be mapped to the entity as CONSOLIDATED, and nothing else may be mapped to it.
    """
    theirs = maps.select("record_ref", F.col("entity").alias("_entity"), "disposition")
    both = groups.distinct().join(theirs, "record_ref", "left")
    member = F.when(~F.col("_entity").eqNullSafe(F.col("entity")), "MEMBER_ELSEWHERE").when(F.col("disposition") != "CONSOLIDATED", "MEMBER_NOT_CONSOLIDATED")
    inside = both.select("entity", member.alias("reason")).where("reason IS NOT NULL")
    named = groups.select("entity").distinct()
    more = maps.join(named, "entity", "left_semi").join(groups.select("entity", "record_ref").distinct(), ["entity", "record_ref"], "left_anti")
    return inside.unionByName(more.select("entity", F.lit("MEMBER_TOO_MANY").alias("reason"))).distinct()


def gate(checks: list[DataFrame]) -> DataFrame:
    """All checks under each other."""
    return reduce(lambda a, b: a.unionByName(b), checks)


def verdict(checks: DataFrame) -> DataFrame:
    """One row: FAIL if a blocking check failed."""
    return checks.agg(F.when(F.max((F.col("severity") == "BLOCKING") & (F.col("status") == "FAIL")), "FAIL").otherwise("PASS").alias("status"), F.count("*").alias("checks"), F.count_if(F.col("status") == "FAIL").alias("failed"))
