"""Column and table profiles in few passes: counts, lengths, numbers, times, patterns, spread and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, FractionalType, IntegralType, StringType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from tessera.functions.expressions import PATTERNS, iso_timestamp, matches

DISTINCT_LIMIT = 100_000


def primitive(kind: DataType) -> str:
    """The kind of a column's values. Decimals count as nested, as they aren't measured as numbers."""
    for types, name in (((BooleanType,), "boolean"), ((IntegralType,), "integer"), ((DecimalType,), "nested"), ((FractionalType,), "real"), ((DateType, TimestampType, TimestampNTZType), "datetime"), ((StringType,), "string")):
        if isinstance(kind, types):
            return name
    return "nested"


def present(name: str, kind: DataType, markers: tuple[str, ...]) -> Column:
    """The value, or null where it is missing or one of the texts that mark missing values."""
    column = F.col(name)
    return F.when(~column.isin(*markers), column) if markers and isinstance(kind, StringType) else column


def measures(name: str, kind: DataType, markers: tuple[str, ...]) -> dict[str, Column]:
    """Aggregates of one column, by metric."""
    column, value, family = F.col(name), present(name, kind, markers), primitive(kind)
    out = {
        "rows": F.count("*"),
        "physical_nulls": F.count_if(column.isNull()),
        "marker_count": F.count_if(column.isNotNull() & value.isNull()),
        "non_missing": F.count(value),
    }
    if family == "string":
        out |= {
            "length_min": F.min(F.length(value)),
            "length_max": F.max(F.length(value)),
            "length_mean": F.avg(F.length(value)),
            "empty_strings": F.count_if(value == ""),
            "datetime_parsed": F.count(iso_timestamp(value)),
        }
        out |= {f"pattern_{p.lower()}": F.count_if(matches(value, p)) for p in PATTERNS}
    if family in ("integer", "real"):
        number = value.cast("double")
        finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
        out |= {
            "number_count": F.count(finite),
            "number_min": F.min(finite),
            "number_max": F.max(finite),
            "number_mean": F.avg(finite),
            "number_variance": F.when(F.count(finite) > 0, F.coalesce(F.var_samp(finite), F.lit(0.0))),
            "number_stddev": F.when(F.count(finite) > 0, F.coalesce(F.stddev_samp(finite), F.lit(0.0))),
            "number_zeros": F.count_if(finite == 0),
            "number_negatives": F.count_if(finite < 0),
        }
    return out


def profile(rows: DataFrame, columns: list[str] | None = None, markers: tuple[str, ...] = ()) -> DataFrame:
    """(column, metric, value) of the single-pass statistics of all columns: one scan, one aggregation."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    names = columns or rows.columns
    wanted = [(n, m, a) for n in names for m, a in measures(n, kinds[n], markers).items()]
    one = rows.agg(*[a.cast("double").alias(f"m{i}") for i, (_, _, a) in enumerate(wanted)])
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(m).alias("metric"), F.col(f"m{i}").alias("value")) for i, (n, m, _) in enumerate(wanted)])
    return one.select(F.explode(cells).alias("cell")).select("cell.*")


def observed_types(rows: DataFrame, columns: list[str] | None = None, markers: tuple[str, ...] = ()) -> DataFrame:
    """(column, primitive, n): what the present values of each column are; texts are judged by what they can be read as.

    One scan: a count for each column and type, the types being few.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    cells = []
    for name in columns or rows.columns:
        value = present(name, kinds[name], markers)
        kind = F.lit(primitive(kinds[name]))
        if isinstance(kinds[name], StringType):
            text = F.trim(value)
            kind = F.when(text.rlike(r"^[+-]?[0-9]+\z"), "integer").when(text.rlike(r"^[+-]?(?:[0-9]+\.[0-9]*|\.?[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), "real").when(F.lower(text).isin("true", "false"), "boolean").when(iso_timestamp(text).isNotNull(), "datetime").otherwise("string")
        cells.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("column"), kind.alias("primitive"))))
    return rows.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.column", "c.primitive").agg(F.count("*").alias("n"))


def value_counts(rows: DataFrame, columns: list[str], markers: tuple[str, ...] = ()) -> DataFrame:
    """(column, value, n): how often each present value stands in each column; one scan, then partial counts."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    cells = F.array(*[F.struct(F.lit(n).alias("column"), present(n, kinds[n], markers).cast("string").alias("value")) for n in columns])
    return rows.select(F.explode(cells).alias("cell")).select("cell.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def spread(rows: DataFrame, columns: list[str], markers: tuple[str, ...] = (), limit: int | None = DISTINCT_LIMIT) -> DataFrame:
    """(column, non_missing, distinct_count, distinct_ratio, gini, uniqueness) from value counts.

    Above the limit of distinct values, counts and impurity are reported as not computed; without one, always computed.
    """
    found = value_counts(rows, columns, markers).groupBy("column").agg(F.sum("n").alias("non_missing"), F.count("*").alias("d"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    within = F.lit(True) if limit is None else F.col("d") <= limit
    return found.select(
        "column",
        "non_missing",
        F.when(within, F.col("d")).alias("distinct_count"),
        F.when(within, F.col("d") / F.col("non_missing")).alias("distinct_ratio"),
        F.when(within, 1 - F.col("squares") / (F.col("non_missing").cast("double") * F.col("non_missing"))).alias("gini"),
        F.when(within, "EXACT_ON_FULL_SCOPE").otherwise("NOT_COMPUTED_BOUNDED").alias("uniqueness"),
    )


def quantiles(rows: DataFrame, column: str, fractions: dict[str, float] | None = None) -> DataFrame:
    """Values at place floor(fraction * (n - 1)) of the sorted finite numbers: no interpolation.

    Equal numbers are counted first; their running counts are summed over ranges, so no task sorts the column whole.
    """
    fractions = fractions or {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    number = F.col(column).cast("double")
    counts = rows.where(~F.isnan(number) & (F.abs(number) != float("inf"))).groupBy(number.alias("value")).agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges of values; the totals of the ranges before it are added to a range's own running count
    borders = counts.approxQuantile("value", [i / parts for i in range(1, parts)], 0.01)
    at = F.size(F.filter(F.lit(sorted(set(borders))), lambda b: b < F.col("value"))) if borders else F.lit(0)
    placed = counts.withColumn("range", at)
    totals = placed.groupBy("range").agg(F.sum("n").alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = placed.withColumn("inside", inside).join(F.broadcast(before), "range").select("value", (F.col("before") + F.col("inside")).alias("upto"))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("quantile"), F.floor(F.lit(f) * (F.col("size") - 1)).alias("place")) for k, f in fractions.items()]))
    targets = size.where("size > 0").select(wanted.alias("t")).select("t.*")
    return upto.join(F.broadcast(targets), F.col("upto") > F.col("place")).groupBy("quantile").agg(F.min("value").alias("value"))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """(row_count, duplicate_rows): rows beyond the first of each set of equal rows, nulls being equal."""
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    return counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def datetimes(rows: DataFrame, column: str) -> DataFrame:
    """(observed, parsed, least, largest) of the ISO times in a text or time column."""
    kind = dict((f.name, f.dataType) for f in rows.schema.fields)[column]
    value = iso_timestamp(F.col(column)) if isinstance(kind, StringType) else F.col(column).cast("timestamp_ntz")
    return rows.agg(F.count(column).alias("observed"), F.count(value).alias("parsed"), F.min(value).alias("least"), F.max(value).alias("largest"))


def profile_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, metric, before, after, delta, state) of two profiles: a full outer join."""
    old, new = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    both = old.join(new, ["column", "metric"], "full")
    state = F.when(F.col("before").isNull() & F.col("after").isNull(), "LIMITED").when(F.col("before").isNull() | F.col("after").isNull(), "INCOMPATIBLE").otherwise("COMPARABLE")
    return both.select("column", "metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"), state.alias("state"))
