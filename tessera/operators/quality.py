"""Declarative quality rules as predicates, with issues, proposals and summaries by dimension."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from tessera.functions.expressions import matches, stripped
from tessera.operators.profiling import primitive

# The dimension and the issue name of each rule type.
DIMENSIONS = {
    "REQUIRED_VALUE": ("completeness", "REQUIRED_VALUE_MISSING"),
    "UNIQUE_VALUES": ("uniqueness", "UNIQUE_VALUES_VIOLATION"),
    "EXACT_ROW_DUPLICATION": ("uniqueness", "EXACT_DUPLICATE_ROWS_OBSERVED"),
    "EXPECTED_PATTERN": ("validity", "EXPECTED_PATTERN_MISMATCH"),
    "EXPECTED_PRIMITIVE_TYPE": ("validity", "EXPECTED_PRIMITIVE_TYPE_MISMATCH"),
    "ALLOWED_DOMAIN": ("validity", "ALLOWED_DOMAIN_VIOLATION"),
    "NUMERIC_RANGE": ("validity", "NUMERIC_RANGE_VIOLATION"),
    "NORMALIZATION_OPPORTUNITY": ("consistency", "REPRESENTATION_NORMALIZATION_OPPORTUNITY"),
    "DECLARED_REFERENTIAL_INTEGRITY": ("referential_integrity", "DECLARED_REFERENTIAL_INTEGRITY_VIOLATION"),
}


@dataclass(frozen=True)
class Rule:
    """One rule on one table. Values that aren't present (null or a marker) are out of all rules but REQUIRED_VALUE."""

    rule_id: str
    kind: str
    table: str
    columns: tuple[str, ...] = ()
    severity: str = "MEDIUM"
    pattern: str | None = None
    expected_type: str | None = None
    allowed: tuple[str, ...] = ()
    minimum: float | None = None
    maximum: float | None = None
    markers: tuple[str, ...] = ()
    target: str | None = None
    target_columns: tuple[str, ...] = ()
    enabled: bool = True
    repair: str | None = None
    quarantine: bool = False
    scope: str = "TECHNICAL"

    def __post_init__(self):
        if self.kind not in DIMENSIONS:
            raise ValueError(f"UNKNOWN_RULE_TYPE: {self.kind}")


def missing(rows: DataFrame, name: str, markers: tuple[str, ...]) -> Column:
    column = F.col(name)
    if markers and isinstance(rows.schema[name].dataType, StringType):
        return column.isNull() | F.coalesce(column.isin(*markers), F.lit(False))
    return column.isNull()


def text_form(rows: DataFrame, name: str) -> Column:
    """A value as the rules' allowed texts spell it: True and False for booleans."""
    column = F.col(name)
    return F.initcap(column.cast("string")) if primitive(rows.schema[name].dataType) == "boolean" else column.cast("string")


def violation(rows: DataFrame, rule: Rule) -> Column:
    """Whether a present value breaks the rule."""
    name = rule.columns[0]
    column, family = F.col(name), primitive(rows.schema[name].dataType)
    if rule.kind == "EXPECTED_PATTERN":
        return ~matches(column, rule.pattern) if family == "string" else F.lit(True)
    if rule.kind == "EXPECTED_PRIMITIVE_TYPE":
        # dates count as nested values here
        return F.lit(("nested" if family == "datetime" else family) != (rule.expected_type or "").lower())
    if rule.kind == "ALLOWED_DOMAIN":
        return ~text_form(rows, name).isin(*rule.allowed)
    if rule.kind == "NUMERIC_RANGE":
        if family not in ("integer", "real"):
            return F.lit(True)
        low = column < rule.minimum if rule.minimum is not None else F.lit(False)
        high = column > rule.maximum if rule.maximum is not None else F.lit(False)
        return low | high
    return (column != stripped(column)) if family == "string" else F.lit(False)


def affected(rows: DataFrame, rule: Rule, ref: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(ref, affected) of the rows that the rule evaluates."""
    absent = [missing(rows, c, rule.markers) for c in rule.columns]
    any_absent = F.lit(False)
    for a in absent:
        any_absent = any_absent | a
    if rule.kind == "REQUIRED_VALUE":
        return rows.select(ref, any_absent.alias("affected"))
    if rule.kind == "UNIQUE_VALUES":
        return repeated(rows.where(~any_absent), list(rule.columns), ref)
    if rule.kind == "EXACT_ROW_DUPLICATION":
        return repeated(rows, [c for c in rows.columns if c != ref], ref)
    if rule.kind == "DECLARED_REFERENTIAL_INTEGRITY":
        keys = [F.col(c) for c in rule.columns]
        whole = F.lit(True)
        for k in keys:
            whole = whole & k.isNotNull()
        target = (tables or {})[rule.target].select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(rule.target_columns)]).distinct().withColumn("_hit", F.lit(True))
        on = [F.col(c) == F.col(f"_t{i}") for i, c in enumerate(rule.columns)]
        joined = rows.where(whole).join(target, on, "left")
        return joined.select(ref, F.col("_hit").isNull().alias("affected"))
    return rows.where(~any_absent).select(ref, violation(rows, rule).alias("affected"))


def repeated(rows: DataFrame, keys: list[str], ref: str) -> DataFrame:
    """Whether a row's key stands on other rows, too. Keys are counted first, so a key of many rows isn't one task's window."""
    counts = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg((F.count("*") > 1).alias("affected"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(counts, on).select(ref, "affected")


def partial_nulls(rows: DataFrame, rule: Rule) -> int:
    """Rows of which some but not all key columns are null: the reference can't be judged."""
    some = F.lit(False)
    every = F.lit(True)
    for c in rule.columns:
        some, every = some | F.col(c).isNull(), every & F.col(c).isNull()
    return rows.where(some & ~every).count()


ROW_KINDS = ("REQUIRED_VALUE", "EXPECTED_PATTERN", "EXPECTED_PRIMITIVE_TYPE", "ALLOWED_DOMAIN", "NUMERIC_RANGE", "NORMALIZATION_OPPORTUNITY")


def row_marks(rows: DataFrame, rule: Rule) -> tuple[Column, Column]:
    """(evaluated, affected) of a rule that judges each row alone."""
    absent = F.lit(False)
    for c in rule.columns:
        absent = absent | missing(rows, c, rule.markers)
    if rule.kind == "REQUIRED_VALUE":
        return F.lit(True), absent
    return ~absent, ~absent & violation(rows, rule)


def applicability(tables: dict[str, DataFrame], rules: list[Rule], runtime: bool = True) -> dict[str, tuple[str, str | None]]:
    """Each rule's state and the reason, if it can't be evaluated: a disabled rule isn't applicable, one without what it needs lacks evidence.

    runtime: benchmark rules are no part of a run's own policy. A rule whose plan can't be made fails alone.
    """
    out: dict[str, tuple[str, str | None]] = {}
    for r in rules:
        columns = set(tables[r.table].columns) if r.table in tables else set()
        lacking = sorted(set(r.columns) - columns)
        if not r.enabled:
            out[r.rule_id] = ("NOT_APPLICABLE", "RULE_DISABLED")
        elif r.table not in tables:
            out[r.rule_id] = ("INSUFFICIENT_EVIDENCE", f"TABLE_ABSENT: {r.table}")
        elif r.scope == "REFERENCE_BENCHMARK" and runtime:
            out[r.rule_id] = ("INSUFFICIENT_EVIDENCE", "RULE_INVALID: benchmark rule in a run")
        elif lacking and r.kind != "EXACT_ROW_DUPLICATION":
            out[r.rule_id] = ("INSUFFICIENT_EVIDENCE", f"COLUMN_ABSENT: {', '.join(lacking)}")
        elif r.kind == "DECLARED_REFERENTIAL_INTEGRITY" and (r.target not in tables or not set(r.target_columns) <= set(tables[r.target].columns)):
            out[r.rule_id] = ("INSUFFICIENT_EVIDENCE", f"TARGET_ABSENT: {r.target}")
        else:
            try:
                if r.kind in ROW_KINDS:
                    tables[r.table].select(*row_marks(tables[r.table], r))
                out[r.rule_id] = ("APPLICABLE", None)
            except Exception as error:  # whatever a rule's own settings break
                out[r.rule_id] = ("INSUFFICIENT_EVIDENCE", f"DETECTOR_FAILED: {type(error).__name__}")
    return out


def applicability_rows(spark: SparkSession, states: dict[str, tuple[str, str | None]]) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in states.items()], "rule_id string, applicability string, reason string")


def evaluate(tables: dict[str, DataFrame], rules: list[Rule], ref: str = "_record_ref", measurement: str = "EXACT_ON_FULL_SNAPSHOT_SCOPE") -> DataFrame:
    """(rule_id, table, kind, dimension, issue_type, severity, evaluated, affected, ratio, measurement) of all rules that apply.

    A table's rules that judge each row alone are one aggregation of one scan; others are counted on their own.
    """
    states = applicability(tables, rules, runtime=False)
    apply = [r for r in rules if states[r.rule_id][0] == "APPLICABLE"]
    if not apply:
        raise ValueError("NO_APPLICABLE_RULES")
    parts = []
    for table in sorted({r.table for r in apply}):
        here = [r for r in apply if r.table == table and r.kind in ROW_KINDS]
        if here:
            marks = [row_marks(tables[table], r) for r in here]
            one = tables[table].agg(*[F.count_if(m).alias(f"{n}{i}") for i, pair in enumerate(marks) for n, m in zip("ea", pair, strict=True)])
            cells = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"e{i}").alias("evaluated"), F.col(f"a{i}").alias("affected")) for i, r in enumerate(here)]
            parts.append(one.select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
    for rule in apply:
        if rule.kind not in ROW_KINDS:
            one = affected(tables[rule.table], rule, ref, tables).agg(F.count("*").alias("evaluated"), F.count_if("affected").alias("affected"))
            parts.append(one.select(F.lit(rule.rule_id).alias("rule_id"), "evaluated", "affected"))
    found = reduce(lambda x, y: x.unionByName(y), parts)

    def of(value) -> Column:
        return F.element_at(F.create_map(*[x for r in apply for x in (F.lit(r.rule_id), F.lit(value(r)))]), F.col("rule_id"))

    return found.select(
        "rule_id",
        of(lambda r: r.table).alias("table"),
        of(lambda r: r.kind).alias("kind"),
        of(lambda r: DIMENSIONS[r.kind][0]).alias("dimension"),
        of(lambda r: DIMENSIONS[r.kind][1]).alias("issue_type"),
        of(lambda r: r.severity).alias("severity"),
        "evaluated",
        "affected",
        F.try_divide("affected", "evaluated").alias("ratio"),
        F.lit(measurement).alias("measurement"),
    )


def issues(tables: dict[str, DataFrame], rules: list[Rule], ref: str = "_record_ref") -> DataFrame:
    """(rule_id, table, issue_type, record_ref): a row for each affected record, in place of unbounded lists."""
    parts = [
        affected(tables[r.table], r, ref, tables).where("affected").select(F.lit(r.rule_id).alias("rule_id"), F.lit(r.table).alias("table"), F.lit(DIMENSIONS[r.kind][1]).alias("issue_type"), F.col(ref).alias("record_ref"))
        for r in rules
        if r.enabled and r.table in tables
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dimension_summary(evaluations: DataFrame) -> DataFrame:
    """(dimension, rules, affected, evaluated, denominator): a ratio is given only where all rules saw as many rows."""
    one = F.min("evaluated") == F.max("evaluated")
    return evaluations.groupBy("dimension").agg(
        F.count("*").alias("rules"),
        F.sum("affected").alias("affected"),
        F.when(one, F.max("evaluated")).otherwise(0).alias("evaluated"),
        F.when(one, "COMMON_RECORD_REF_POPULATION").otherwise("RULE_LOCAL_DENOMINATORS_NOT_COMBINABLE").alias("denominator"),
    )


@dataclass
class Repair:
    """A proposal; nothing is changed unless its parts are asked for."""

    rule: Rule
    kept: DataFrame
    quarantined: DataFrame
    transform: str
    review_required: bool = field(default=True)


def propose(rows: DataFrame, rule: Rule, ref: str, tables: dict[str, DataFrame] | None = None) -> Repair | None:
    """A derived copy with the repair, or the split into kept and quarantined rows; only for rules that allow it."""
    marks = affected(rows, rule, ref, tables).where("affected").select(F.col(ref).alias("_bad")).distinct()
    none = rows.limit(0)
    if rule.repair == "trim_whitespace" and rule.kind == "NORMALIZATION_OPPORTUNITY":
        return Repair(rule, rows.withColumn(rule.columns[0], stripped(F.col(rule.columns[0]))), none, rule.repair)
    if rule.repair == "parse_expected_type" and rule.kind == "EXPECTED_PRIMITIVE_TYPE":
        kinds = {"integer": "bigint", "real": "double", "boolean": "boolean", "string": "string"}
        return Repair(rule, rows.withColumn(rule.columns[0], F.expr(f"try_cast(`{rule.columns[0]}` AS {kinds[rule.expected_type]})")), none, rule.repair)
    if rule.repair == "review_duplicate_handling" and rule.kind == "EXACT_ROW_DUPLICATION":
        order = Window.partitionBy(*[c for c in rows.columns if c != ref]).orderBy(ref)
        numbered = rows.withColumn("_copy", F.row_number().over(order))
        return Repair(rule, numbered.where("_copy = 1").drop("_copy"), numbered.where("_copy > 1").drop("_copy"), rule.repair)
    if rule.quarantine:
        return Repair(rule, rows.join(marks, rows[ref] == marks["_bad"], "left_anti"), rows.join(marks, rows[ref] == marks["_bad"], "left_semi"), "quarantine_affected_rows")
    return None
