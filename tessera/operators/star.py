"""Dimensions, facts and dates of a star schema with stable surrogate keys and explicit quarantine."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expressions import iso_weekday, surrogate_key

# References without a member that facts are held against by broadcast, at most; with more of them all facts are joined.
ABSENT = 100_000
# Types whose text JSON leaves as it is.
PLAIN = ("tinyint", "smallint", "int", "bigint", "date")
# What an unknown member holds, by type.
UNKNOWN = {"string": "'UNKNOWN'", "date": "DATE '1970-01-01'", "timestamp": "TIMESTAMP '1970-01-01'", "timestamp_ntz": "TIMESTAMP_NTZ '1970-01-01'", "boolean": "FALSE"}


class StarError(Exception):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}")
        self.code = code


def check_grain(rows: DataFrame, grain: list[str], nulls: str = "REJECT") -> tuple[DataFrame, DataFrame]:
    """rows with whole grain keys, and those without; repeated keys are an error, and so are null ones under REJECT."""
    if not grain:
        raise StarError("EMPTY_GRAIN")
    lacking = F.lit(False)
    for g in grain:
        lacking = lacking | F.col(g).isNull()
    bad, good = rows.where(lacking), rows.where(~lacking)
    if nulls == "REJECT" and bad.take(1):
        raise StarError("NULL_GRAIN", ",".join(grain))
    if good.groupBy(*grain).count().where("count > 1").take(1):
        raise StarError("DUPLICATE_GRAIN", ",".join(grain))
    return good, bad


@dataclass(frozen=True)
class Dimension:
    """A dimension table: `key` is its surrogate key, `canonical_ref` what the facts refer to.

    derived says that each key is `surrogate_key` of the name and the reference, so that it needs no look-up.
    """

    name: str
    key: str
    rows: DataFrame = field(compare=False)
    derived: bool = False


def build_dimension(rows: DataFrame, name: str, reference: Column, attributes: dict[str, Column], required: tuple[str, ...] = (), unknown_member: bool = False, check: bool = True, history: str = "TYPE1_SNAPSHOT") -> Dimension:
    """One row for each canonical reference. Repeated references, null required attributes and key clashes are errors."""
    history_mode(history)
    key = f"{name}_key"
    out = rows.select(reference.cast("string").alias("canonical_ref"), *[c.alias(a) for a, c in attributes.items()])
    out = out.select(surrogate_key(name, F.col("canonical_ref"), is_plain(rows, reference)).alias(key), "*")
    if check:
        facts = out.agg(F.count("*").alias("n"), F.countDistinct("canonical_ref").alias("refs"), F.countDistinct(key).alias("keys"), *[F.count_if(F.col(r).isNull()).alias(f"null_{r}") for r in required]).first()
        if facts.n != facts.refs:
            raise StarError("DUPLICATE_CANONICAL_REFERENCE", name)
        if facts.refs != facts["keys"]:
            raise StarError("SURROGATE_KEY_COLLISION", name)
        for r in required:
            if facts[f"null_{r}"]:
                raise StarError("NULL_REQUIRED_ATTRIBUTE", f"{name}.{r}")
    if unknown_member:
        out = out.unionByName(unknown_row(out, name, key))
    return Dimension(name, key, out, True)


def is_plain(rows: DataFrame, reference: Column) -> bool:
    return rows.select(reference).dtypes[0][1] in PLAIN


def history_mode(mode: str = "TYPE1_SNAPSHOT", overwrite: bool = True, columns: tuple[str | None, str | None, str | None] = (None, None, None)) -> str:
    """The mode in which a dimension may be built: the present snapshot alone, written over the last.

    Histories can be prepared by naming their columns (valid from, valid to, current), but none is built: no source has a
    contract of history, so TYPE2_PREPARED is refused where rows are asked for.
    """
    if mode == "TYPE1_SNAPSHOT":
        if not overwrite:
            raise StarError("SNAPSHOT_MUST_OVERWRITE", mode)
        return mode
    if mode != "TYPE2_PREPARED":
        raise StarError("UNKNOWN_HISTORY_MODE", mode)
    if not all(columns):
        raise StarError("HISTORY_COLUMNS_MISSING", mode)
    raise StarError("HISTORY_NOT_SUPPORTED", mode)


def unknown_row(rows: DataFrame, name: str, key: str) -> DataFrame:
    reference = f"__UNKNOWN__:{name}"
    one = rows.sparkSession.range(1).select(F.lit(reference).alias("canonical_ref"))
    cells = [F.expr(f"CAST({UNKNOWN.get(t, '0')} AS {t})").alias(c) for c, t in rows.dtypes if c not in (key, "canonical_ref")]
    return one.select(surrogate_key(name, F.col("canonical_ref")).alias(key), "canonical_ref", *cells)


def date_attributes(day: str = "full_date") -> list[Column]:
    d = F.col(day)
    parts = {"year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "day": F.dayofmonth(d), "weekday": iso_weekday(d)}
    return [c.cast("int").alias(n) for n, c in parts.items()]


def date_key(day: Column) -> Column:
    return surrogate_key("date", F.date_format(day, "yyyy-MM-dd"), plain=True)


def build_date_dimension(spark: SparkSession, days: DataFrame | None = None, start: str | None = None, end: str | None = None) -> Dimension:
    """Days that facts have, and all days of a reviewed range, each once."""
    parts = []
    if days is not None:
        parts.append(days.select(F.col(days.columns[0]).cast("date").alias("full_date")).where("full_date IS NOT NULL"))
    if start and end:
        parts.append(spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date")))
    if not parts:
        raise StarError("EMPTY_DATE_DIMENSION")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = both.distinct().select(date_key(F.col("full_date")).alias("date_key"), F.date_format("full_date", "yyyy-MM-dd").alias("canonical_ref"), "full_date", *date_attributes())
    return Dimension("date", "date_key", rows, True)


@dataclass(frozen=True)
class ForeignKey:
    """How a fact column refers to a dimension, and what becomes of facts whose reference isn't there.

    policy: QUARANTINE_FACT, NULLABLE_FK or EXPLICIT_UNKNOWN_MEMBER. role names the key column for several of one dimension.
    source: a table with all references that the facts can have, if that's cheaper to read than the facts' own rows.
    """

    column: Column
    dimension: Dimension
    policy: str = "QUARANTINE_FACT"
    required: bool = True
    role: str | None = None
    source: DataFrame | None = field(default=None, compare=False)

    @property
    def name(self) -> str:
        return f"{self.role or self.dimension.name}_key"


def looked_up(out: DataFrame, k: ForeignKey, rows: DataFrame, i: int) -> DataFrame:
    """out with `_c{i}`, the reference as text, `_lost{i}`, whether it has no member, and `_k{i}`, the member's key or null.

    The distinct references are held against the dimension first. Where keys are derived, each reference has one member at
    most and few have none, the key is worked out from the reference and only those without a member are broadcast, so the
    facts aren't shuffled. Else they're joined with the dimension.
    """
    reference = k.column.cast("string")
    out = out.withColumn(f"_c{i}", reference)
    if k.dimension.derived:
        asked = (rows if k.source is None else k.source).select(reference.alias("_ref")).where("_ref IS NOT NULL").distinct()
        members = k.dimension.rows.groupBy(F.col("canonical_ref").alias("_ref")).agg(F.count("*").alias("_n"))
        found = asked.join(members, "_ref", "left").agg(F.count_if(F.col("_n").isNull()).alias("absent"), F.coalesce(F.max("_n"), F.lit(0)).alias("most")).first()
        if found.most <= 1 and found.absent <= ABSENT:
            key = surrogate_key(k.dimension.name, F.col(f"_c{i}"), is_plain(rows, k.column))
            if not found.absent:
                return out.withColumns({f"_lost{i}": F.col(f"_c{i}").isNull(), f"_k{i}": key})
            absent = asked.join(members, "_ref", "left_anti").select(F.col("_ref").alias(f"_r{i}"))
            out = out.join(F.broadcast(absent), F.col(f"_c{i}") == F.col(f"_r{i}"), "left")
            return out.withColumns({f"_lost{i}": F.col(f"_c{i}").isNull() | F.col(f"_r{i}").isNotNull(), f"_k{i}": F.when(F.col(f"_r{i}").isNull(), key)})
    refs = k.dimension.rows.select(F.col("canonical_ref").alias(f"_r{i}"), F.col(k.dimension.key).alias(f"_k{i}"))
    return out.join(refs, F.col(f"_c{i}") == F.col(f"_r{i}"), "left").withColumn(f"_lost{i}", F.col(f"_k{i}").isNull())


def build_fact(
    rows: DataFrame, grain: list[str], keys: list[ForeignKey], dates: dict[str, Column] | None = None, measures: dict[str, Column] | None = None, degenerate: list[str] | None = None, lineage: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(facts, quarantine). Facts go to quarantine for the first of their keys that fails, in the given order.

    Key values are the dimensions' (`looked_up`). Date keys follow from the day alone.
    """
    out = rows
    reason = F.lit(None).cast("string")
    for g in grain:
        reason = F.coalesce(reason, F.when(F.col(g).isNull(), F.lit(f"NULL_GRAIN:{g}")))
    tags = []
    values = [F.col(f"_k{i}") for i, _ in enumerate(keys)]
    for i, k in enumerate(keys):
        if k.required and k.policy == "NULLABLE_FK":
            raise StarError("REQUIRED_KEY_CANNOT_BE_NULLABLE", k.name)
        out = looked_up(out, k, rows, i)
        lost = F.col(f"_lost{i}")
        if k.policy == "QUARANTINE_FACT":
            reason = F.coalesce(reason, F.when(lost & (F.lit(k.required) | F.col(f"_c{i}").isNotNull()), F.lit(f"ORPHAN:{k.name}")))
        if k.policy == "EXPLICIT_UNKNOWN_MEMBER":
            tags.append(F.when(lost, F.lit(f"policy:unknown-member:{k.name}")))
            values[i] = F.coalesce(values[i], surrogate_key(k.dimension.name, F.lit(f"__UNKNOWN__:{k.dimension.name}")))
    out = out.withColumn("_reason", reason)
    refs = F.array(F.col(lineage).cast("string"), *tags) if lineage else F.array(*tags).cast("array<string>")
    columns = [F.col(g) for g in grain] + [v.alias(k.name) for v, k in zip(values, keys)]
    columns += [date_key(c.cast("date")).alias(f"{role}_key") for role, c in (dates or {}).items()]
    columns += [F.col(d) for d in degenerate or []] + [c.alias(m) for m, c in (measures or {}).items()]
    facts = out.where("_reason IS NULL").select(*columns, F.to_json(F.array_compact(refs)).alias("source_record_refs"))
    quarantine = out.where("_reason IS NOT NULL").select(*[F.col(g) for g in grain], F.col("_reason").alias("reason"))
    return facts, quarantine


def coerced(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """rows with columns of declared types; a value that can't be read as its type is an error, not a null."""
    lost = [F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS {t})").isNull()).alias(c) for c, t in types.items()]
    bad = {c: n for c, n in rows.agg(*lost).first().asDict().items() if n}
    if bad:
        raise StarError("MEASURE_TYPE_MISMATCH", str(bad))
    return rows.select(*[F.expr(f"try_cast(`{c}` AS {types[c]})").alias(c) if c in types else F.col(c) for c in rows.columns])


def resolve_aliases(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """The physical column of each logical one, by name lists in any case; none or several are errors."""
    folded: dict[str, list[str]] = {}
    for c in columns:
        folded.setdefault(c.casefold(), []).append(c)
    out = {}
    for logical, names in aliases.items():
        hits = [c for n in [logical, *names] for c in folded.get(n.casefold(), [])]
        if len(set(hits)) != 1:
            raise StarError("COLUMN_NOT_RESOLVED" if not hits else "COLUMN_AMBIGUOUS", logical)
        out[logical] = hits[0]
    return out


def union_of_sources(sources: dict[str, DataFrame], aliases: dict[str, list[str]]) -> DataFrame:
    """Rows of all sources under logical names, as text, with `source_id`."""
    out = None
    for source, rows in sorted(sources.items()):
        found = resolve_aliases(rows.columns, aliases)
        one = rows.select(F.lit(source).alias("source_id"), *[F.col(c).cast("string").alias(logical) for logical, c in found.items()])
        out = one if out is None else out.unionByName(one)
    return out


def accounting_by_source(inputs: DataFrame, facts: DataFrame, quarantine: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, input, emitted, quarantined, unresolved) rows of each source."""
    marked = [df.groupBy(source).agg(F.count("*").alias(n)) for df, n in ((inputs, "input"), (facts, "emitted"), (quarantine, "quarantined"))]
    out = marked[0].join(marked[1], source, "left").join(marked[2], source, "left").fillna(0)
    return out.withColumn("unresolved", F.col("input") - F.col("emitted") - F.col("quarantined"))


def publish(tables: dict[str, DataFrame], folder: str, source: str = "") -> dict:
    """Write all tables, read their counts back, and write the manifest last: without it, readers see nothing.

    source is a mark of what the tables were made from; readers can hold it against the source's present mark.
    """
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, rows in sorted(tables.items()):
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
        counts[name] = spark.read.parquet(f"{folder}/{name}").count()
    spark.createDataFrame([(json.dumps({"tables": counts, "source": source}, sort_keys=True),)], "manifest string").coalesce(1).write.mode("errorifexists").text(f"{folder}/_manifest")
    return counts


def read_published(spark: SparkSession, folder: str, name: str, source: str | None = None) -> DataFrame:
    """A published table; with a source's mark, only if the table was made from what has that mark."""
    manifest = json.loads(spark.read.text(f"{folder}/_manifest").first()[0])
    if source is not None and manifest["source"] != source:
        raise StarError("STALE_TARGET", folder)
    if name not in manifest["tables"]:
        raise StarError("UNKNOWN_TABLE", name)
    return spark.read.parquet(f"{folder}/{name}")
