"""Row rules on streams: the row-local predicates of the quality rules split a stream into kept and quarantined rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.quality import Rule, missing, violation

ROW_LOCAL = ("REQUIRED_VALUE", "EXPECTED_PATTERN", "EXPECTED_PRIMITIVE_TYPE", "ALLOWED_DOMAIN", "NUMERIC_RANGE", "NORMALIZATION_OPPORTUNITY")


def marked(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows, batch or stream, with `failed_rules`: the ids of the rules that a row breaks. Rules over several rows are refused."""
    marks = []
    for rule in rules:
        if rule.kind not in ROW_LOCAL:
            raise ValueError(f"NOT_ROW_LOCAL: {rule.rule_id}")
        absent = F.lit(False)
        for c in rule.columns:
            absent = absent | missing(rows, c, rule.markers)
        bad = absent if rule.kind == "REQUIRED_VALUE" else ~absent & violation(rows, rule)
        marks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule.rule_id)))
    return rows.withColumn("failed_rules", F.array_compact(F.array(*marks)))


def parted(rows: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    out = marked(rows, rules)
    return out.where(F.size("failed_rules") == 0).drop("failed_rules"), out.where(F.size("failed_rules") > 0)
