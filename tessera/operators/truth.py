"""What a star should hold, worked out from its sources' staged text alone.

Nothing here comes from the code that builds stars: texts are read by patterns of their own, entities are named by the
columns that tell a record, and all checks hold plain sums and sets against the published tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import validation

DIRECT = "EMITTED_DIRECT"
SOURCE_TO_CANONICAL, CANONICAL_TO_ANALYTICAL = "SOURCE_TO_CANONICAL", "CANONICAL_TO_ANALYTICAL"
_NUMBER = r"^\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]{1,2})?\s*$"
_DAY = r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[ T].*)?\s*$"


@dataclass(frozen=True)
class Subject:
    """How a source's text tells events: the columns of the grain, the measure, its decimal type, and the day."""

    kind: str
    grain: tuple[str, ...]
    measure: str
    day: str
    decimal: str = "decimal(18,2)"


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def records(rows: DataFrame, subject: Subject, source: str, snapshot: str) -> DataFrame:
    """(record_ref, kind, source, snapshot, entity, grain columns, measure, day, disposition, reason), one for each staged row.

    rows are all text. A record without a whole grain, a readable measure or a readable day is UNRESOLVED, with the first
    reason; all others are EMITTED_DIRECT. A repeated grain is UNRESOLVED for all its rows, as none of them is the event.
    """
    grain = [F.trim(F.col(g)).alias(g) for g in subject.grain]
    number = F.when(F.col(subject.measure).rlike(_NUMBER), F.trim(subject.measure).try_cast(subject.decimal))
    day = F.regexp_extract(F.coalesce(F.col(subject.day), F.lit("")), _DAY, 1).try_cast("date")
    reason = F.lit(None).cast("string")
    for g in subject.grain:
        reason = F.coalesce(reason, F.when(_blank(g), F.lit(f"NO_GRAIN:{g}")))
    reason = F.coalesce(reason, F.when(number.isNull(), F.lit(f"UNREADABLE:{subject.measure}")), F.when(day.isNull(), F.lit(f"UNREADABLE:{subject.day}")))
    read = rows.select(*grain, number.alias("_measure"), day.alias("_day"), reason.alias("reason"))
    ref = F.sha2(F.concat_ws("\x1f", F.lit(source), F.lit(subject.kind), *subject.grain), 256)
    # counts of a key are small before they meet its rows
    twice = read.where("reason IS NULL").groupBy(*subject.grain).agg(F.count("*").alias("_n")).where("_n > 1")
    judged = read.join(twice, list(subject.grain), "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_n") > 1, F.lit("REPEATED_GRAIN"))))
    return judged.select(
        ref.alias("record_ref"), F.lit(subject.kind).alias("kind"), F.lit(source).alias("source"), F.lit(snapshot).alias("snapshot"), F.concat(F.lit("event_"), F.substring(ref, 1, 32)).alias("entity"),
        *subject.grain, F.col("_measure").alias(subject.measure), F.col("_day").alias(subject.day), F.when(F.col("reason").isNull(), DIRECT).otherwise("UNRESOLVED").alias("disposition"), "reason",
    )


def facts(told: DataFrame, subject: Subject) -> DataFrame:
    """(grain columns, measure, day) of the records that are emitted."""
    return told.where(F.col("disposition") == DIRECT).select(*subject.grain, subject.measure, subject.day)


def expectations(told: DataFrame, subject: Subject) -> DataFrame:
    """(slice, value): the sum of all emitted records, and of each day; without any, the sum is null."""
    mine = facts(told, subject)
    days = mine.groupBy(F.date_format(subject.day, "yyyy-MM-dd").alias("slice")).agg(F.sum(subject.measure).alias("value"))
    return mine.agg(F.sum(subject.measure).alias("value")).select(F.lit("global").alias("slice"), "value").unionByName(days)


def accounting(told: DataFrame) -> DataFrame:
    """(boundary, input, disposition, output) of every record at both boundaries; unresolved ones have no output and no second boundary."""
    emitted = F.col("disposition") == DIRECT
    first = told.select(F.lit(SOURCE_TO_CANONICAL).alias("boundary"), F.col("record_ref").alias("input"), "disposition", F.when(emitted, F.col("entity")).alias("output"))
    fact = F.concat(F.lit("fact_"), F.substring(F.sha2(F.col("entity"), 256), 1, 32))
    return first.unionByName(told.where(emitted).select(F.lit(CANONICAL_TO_ANALYTICAL).alias("boundary"), F.col("entity").alias("input"), "disposition", fact.alias("output")))


def by_day(told: DataFrame, subject: Subject, observed: DataFrame) -> DataFrame:
    """(slice, expected, observed, same) of each day and of all; observed: (day, measure) rows of the published facts."""
    slices = observed.groupBy(F.date_format("day", "yyyy-MM-dd").alias("slice")).agg(F.sum("measure").alias("observed"))
    found = observed.agg(F.sum("measure").alias("observed")).select(F.lit("global").alias("slice"), "observed").unionByName(slices)
    both = expectations(told, subject).withColumnRenamed("value", "expected").join(found, "slice", "full")
    return both.select("slice", "expected", "observed", F.col("expected").eqNullSafe(F.col("observed")).alias("same"))


def checks(told: DataFrame, subject: Subject, observed: DataFrame) -> DataFrame:
    """The published facts (grain columns as text, measure, day) against the truth: count, grain both ways, values, sums."""
    mine = facts(told, subject)
    sums = by_day(told, subject, observed.select(F.col(subject.day).alias("day"), F.col(subject.measure).alias("measure"))).where("NOT same")
    return validation.gate(
        [
            validation.fact_count(mine, observed),
            validation.grain_sets(mine, observed, list(subject.grain)),
            validation.values(mine, observed, list(subject.grain), [subject.measure, subject.day]),
            validation.check("truth:sum", sums.where("slice = 'global'")),
            validation.check("truth:sum_by_day", sums.where("slice <> 'global'")),
        ]
    )
