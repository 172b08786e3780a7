"""Reading CSV, Parquet and SQL tables without guessing: strict rows, declared types, bounded and referenced snapshots."""

from __future__ import annotations

import csv
import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.expressions import record_reference


class SourceError(Exception):
    """A source that can't be read as declared; the code says why."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The columns of a CSV file: none empty, none twice. A byte order mark is dropped."""
    lines = spark.read.text(path).limit(1).collect()
    if not lines:
        raise SourceError("EMPTY_SOURCE", path)
    try:
        names = next(csv.reader([lines[0][0].removeprefix("﻿")], strict=True))
    except csv.Error as error:
        raise SourceError("PARSE_FAILED", str(error)) from None
    if any(not n.strip() for n in names) or len(set(names)) != len(names):
        raise SourceError("INVALID_HEADER", f"{names}")
    return names


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; empty cells are empty texts, never null. Rows of another width fail the read."""
    names = header_of(spark, path)
    broken = spark.read.option("wholetext", True).text(path).select((F.size(F.split("value", '"')) % 2 == 0).alias("odd")).where("odd")
    if broken.take(1):
        raise SourceError("PARSE_FAILED", "a quote isn't closed")
    schema = StructType([StructField(n, StringType()) for n in names])
    rows = spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False, multiLine=True, escape='"').csv(path)
    return rows.fillna("")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A .csv or .parquet source by its suffix, with only the named columns read."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        rows = read_csv(spark, path)
    elif suffix == "parquet":
        rows = spark.read.parquet(path)
    else:
        raise SourceError("UNSUPPORTED_SOURCE", suffix)
    missing = sorted(set(columns or []) - set(rows.columns))
    if missing:
        raise SourceError("UNKNOWN_COLUMN", ", ".join(missing))
    return rows.select(*columns) if columns else rows


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A SQL table by name; user SQL isn't accepted. partition: column, least and largest value, number of reads."""
    if not all(part.isidentifier() for part in table.replace('"', "").split(".")):
        raise SourceError("UNSAFE_IDENTIFIER", table)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if partition:
        column, low, high, count = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=count)
    return reader.load()


def catalog_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, ordinal, native_type, normalized_type, nullable) of all tables."""
    first = next(iter(tables.values()))
    rows = [(t, f.name, i, f.dataType.simpleString(), normalized_type(f.dataType.simpleString()), f.nullable) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return first.sparkSession.createDataFrame(rows, "table string, column string, ordinal int, native_type string, normalized_type string, nullable boolean")


def normalized_type(kind: str) -> str:
    """The family of a Spark type."""
    head = kind.split("(")[0].split("<")[0]
    families = {"boolean": "boolean", "float": "real", "double": "real", "decimal": "decimal", "date": "date", "binary": "binary"}
    families |= dict.fromkeys(("tinyint", "smallint", "int", "bigint"), "integer") | dict.fromkeys(("array", "map", "struct"), "nested") | dict.fromkeys(("timestamp", "timestamp_ntz"), "timestamp")
    return families.get(head, "text")


def declared_sql_type(declared: str) -> str:
    """The family of a declared SQL type, by the parts of its name in this order."""
    name = declared.upper()
    for parts, family in ((("INT",), "integer"), (("CHAR", "CLOB", "TEXT"), "text"), (("BLOB",), "blob"), (("REAL", "FLOA", "DOUB"), "real")):
        if any(p in name for p in parts):
            return family
    return "numeric" if name else "blob"


@dataclass(frozen=True)
class Selection:
    """Tables and columns to read; nothing means all."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    columns: dict[str, list[str]] = field(default_factory=dict)

    def apply(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        unknown = sorted((set(self.include) | set(self.columns)) - set(tables))
        if unknown:
            raise SourceError("UNKNOWN_TABLE", ", ".join(unknown))
        kept = [t for t in tables if (not self.include or t in self.include) and t not in self.exclude]
        return {t: tables[t].select(*self.columns[t]) if t in self.columns else tables[t] for t in kept}


def with_references(rows: DataFrame, scope: str, key: list[str] | None = None, ordinal: str | None = None) -> DataFrame:
    """rows with `_record_ref`: from the declared key where there is one, else from the row's ordinal in the snapshot."""
    if key:
        return rows.withColumn("_record_ref", record_reference(scope, *[F.col(k) for k in key]))
    if not ordinal:
        raise SourceError("NO_RECORD_IDENTITY", scope)
    return rows.withColumn("_record_ref", record_reference(scope + "#ordinal", F.col(ordinal)))


def bounded(rows: DataFrame, max_rows: int | None, key: list[str]) -> tuple[DataFrame, str]:
    """The first max_rows rows by key, and whether that is all of the table."""
    if max_rows is None:
        return rows, "FULLY_OBSERVED"
    if max_rows == 0:
        return rows.limit(0), "NOT_OBSERVED"
    whole = len(rows.take(max_rows + 1)) <= max_rows
    return rows.orderBy(*key).limit(max_rows), "FULLY_OBSERVED" if whole else "PARTIALLY_OBSERVED"


def bounded_source(tables: dict[str, DataFrame], max_rows: int, keys: dict[str, list[str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables within one bound of rows for the whole source, in the order of their names, and (table, rows, kept, scope) of each.

    Counts come first, so that a table's share is known before any of its rows is read.
    """
    counts = {t: tables[t].count() for t in sorted(tables)}
    kept, report, left = {}, [], max_rows
    for t, n in counts.items():
        take = min(n, left)
        left -= take
        kept[t] = tables[t] if take == n else tables[t].orderBy(*keys[t]).limit(take)
        report.append((t, n, take, "FULLY_OBSERVED" if take == n else "PARTIALLY_OBSERVED" if take else "NOT_OBSERVED"))
    spark = next(iter(tables.values())).sparkSession
    return kept, spark.createDataFrame(report, "table string, rows long, kept long, scope string")


def source_mark(spark: SparkSession, path: str) -> str:
    """A digest of a source's files, their sizes and times, from the file system alone: another one means that the source has changed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in store.listStatus(where)]
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def explained(rows: DataFrame, max_rows: int | None = None) -> dict:
    """What a read would do, without doing it: its columns, the filters that reach the scan, and its bound."""
    plan = (rows if max_rows is None else rows.limit(max_rows))._jdf.queryExecution().executedPlan().toString()
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    schema = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    return {"columns": rows.columns, "read": [c.split(":")[0] for x in schema for c in x.split(",") if c], "filters": [f for x in pushed for f in x.split(", ") if f], "bound": max_rows, "representative": max_rows is None}


def hash_sample(rows: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """The rows with the smallest seeded hashes of their key: a top-k, the same whatever the partitioning."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(size)


def fingerprint(rows: DataFrame) -> tuple[int, str]:
    """Row count and a digest that doesn't depend on the order of rows."""
    hashed = F.xxhash64(*[F.col(c) if not t.startswith("map") else F.to_json(c) for c, t in rows.dtypes])
    found = rows.agg(F.count("*").alias("n"), F.sum(hashed.cast("decimal(38,0)")).alias("s"), F.sum(F.shiftright(hashed, 32).cast("decimal(38,0)") * F.lit(31)).alias("t")).first()
    return found.n, hashlib.sha256(f"{rows.schema.simpleString()}|{found.n}|{found.s}|{found.t}".encode()).hexdigest()


def stage(rows: DataFrame, folder: str) -> dict:
    """Write a snapshot as Parquet; the manifest is what a later read is held against."""
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(folder)
    n, digest = fingerprint(rows.sparkSession.read.parquet(folder))
    return {"folder": folder, "rows": n, "digest": digest, "schema": rows.schema.simpleString()}


def read_staged(spark: SparkSession, manifest: dict, columns: list[str] | None = None) -> DataFrame:
    """A staged snapshot, after its rows have been held against the manifest."""
    rows = spark.read.parquet(manifest["folder"])
    if fingerprint(rows) != (manifest["rows"], manifest["digest"]):
        raise SourceError("SNAPSHOT_INVALID", manifest["folder"])
    return rows.select(*columns) if columns else rows


def accounting(observed: int, staged: int, quarantined: int, unresolved: int = 0) -> dict:
    if observed != staged + quarantined + unresolved:
        raise SourceError("ROW_ACCOUNTING", f"{observed} != {staged} + {quarantined} + {unresolved}")
    return {"observed": observed, "staged": staged, "quarantined": quarantined, "unresolved": unresolved}
