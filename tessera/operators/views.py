"""Ordered, bounded projections for display: what is left out is counted, and sensitive values are suppressed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import matches

SUPPRESSED = "<SUPPRESSED>"


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0, **equal: object) -> DataFrame:
    """Rows with the given values, ordered, from an offset on."""
    for column, value in equal.items():
        rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return rows.orderBy(*order).offset(offset).limit(limit)


def breakdown(rows: DataFrame, group: str, value: str, top: int, suppress: bool = True) -> DataFrame:
    """(group, value, n, rank, hidden): the commonest values of each group, and how many further ones there are.

    Values that look like addresses or phone numbers aren't shown.
    """
    from pyspark.sql.window import Window

    text = F.col(value).cast("string")
    shown = F.when(matches(text, "EMAIL_LIKE") | matches(text, "PHONE_LIKE"), SUPPRESSED).otherwise(text) if suppress else text
    counts = rows.groupBy(F.col(group).alias("group"), shown.alias("value")).agg(F.count("*").alias("n"))
    kinds = counts.groupBy("group").agg(F.greatest(F.count("*") - top, F.lit(0)).alias("hidden"))
    order = Window.partitionBy("group").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(kinds, "group")


def distribution(rows: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bin, low, high, n) of a number between edges, the last bin closed; empty bins are there, too."""
    value = F.col(column).cast("double")
    bins = list(zip(edges[:-1], edges[1:], strict=True))
    inside = [F.count_if((value >= a) & ((value < b) if i + 1 < len(bins) else (value <= b))).alias(f"b{i}") for i, (a, b) in enumerate(bins)]
    cells = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.col(f"b{i}").alias("n")) for i, (a, b) in enumerate(bins)])
    return rows.agg(*inside).select(F.explode(cells).alias("c")).select("c.*")


def heat_map(rows: DataFrame, down: str, across: str, score: str) -> DataFrame:
    """(down, across, n, mean) of each pair of values."""
    return rows.groupBy(F.col(down).alias("down"), F.col(across).alias("across")).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
