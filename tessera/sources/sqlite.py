"""SQLite as a Spark data source: catalog from its metadata, tables read in rowid ranges by read-only connections."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from tessera.sources.files import SourceError, declared_sql_type


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    """Read-only, and with an authorizer that lets reads through alone."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    reads = {sqlite3.SQLITE_SELECT, sqlite3.SQLITE_READ, sqlite3.SQLITE_FUNCTION, sqlite3.SQLITE_PRAGMA, sqlite3.SQLITE_RECURSIVE}
    con.set_authorizer(lambda action, *_: sqlite3.SQLITE_OK if action in reads else sqlite3.SQLITE_DENY)
    return con


def spark_type(declared: str):
    return {"integer": LongType(), "real": DoubleType(), "blob": BinaryType()}.get(declared_sql_type(declared), StringType())


def catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """tables (name, kind), columns (table, column, ordinal, native_type, normalized_type, nullable) and constraints
    (table, kind, columns, referenced_table, referenced_columns): primary keys, unique indexes and foreign keys."""
    con = connect(path)
    tables = con.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall()
    columns, constraints = [], []
    for name, _ in tables:
        info = con.execute(f"PRAGMA table_info({quoted(name)})").fetchall()
        columns += [(name, c, i, t, declared_sql_type(t), not (required or key)) for i, c, t, required, _, key in info]
        keys = [c for _, c, *_, key in sorted(info, key=lambda r: r[5]) if key]
        if keys:
            constraints.append((name, "PRIMARY_KEY", keys, None, None))
        for _, index, unique, origin, *_ in con.execute(f"PRAGMA index_list({quoted(name)})").fetchall():
            if unique and origin == "u":
                constraints.append((name, "UNIQUE", [r[2] for r in con.execute(f"PRAGMA index_info({quoted(index)})").fetchall()], None, None))
        references: dict[int, list] = {}
        for number, _, other, source, target, *_ in con.execute(f"PRAGMA foreign_key_list({quoted(name)})").fetchall():
            references.setdefault(number, [other, [], []])
            references[number][1].append(source)
            references[number][2].append(target or source)
        constraints += [(name, "FOREIGN_KEY", own, other, theirs) for other, own, theirs in references.values()]
    con.close()
    return {
        "tables": spark.createDataFrame(tables, "name string, kind string"),
        "columns": spark.createDataFrame(columns, "table string, column string, ordinal int, native_type string, normalized_type string, nullable boolean"),
        "constraints": spark.createDataFrame(constraints, "table string, kind string, columns array<string>, referenced_table string, referenced_columns array<string>"),
    }


@dataclass
class Range(InputPartition):
    low: int | None
    high: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[str], parts: int):
        self.path, self.table, self.names, self.parts = path, table, names, parts

    def partitions(self) -> list[InputPartition]:
        con = connect(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # tables without rowids are read at once, as views and empty tables are
            return [Range(None, None)]
        finally:
            con.close()
        if low is None:
            return [Range(None, None)]
        step = -(-(high - low + 1) // self.parts)
        return [Range(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        con = connect(self.path)
        columns = ", ".join(map(quoted, self.names))
        where, bounds = ("", ()) if partition.low is None else (" WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
        yield from con.execute(f"SELECT {columns} FROM {quoted(self.table)}{where}", bounds)
        con.close()


class SqliteSource(DataSource):
    """Options: path, table, columns (comma-separated, all by default) and partitions (4 by default)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        con = connect(self.options["path"])
        info = con.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        con.close()
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        found = {c: spark_type(t) for _, c, t, *_ in info}
        if not found or any(c not in found for c in wanted):
            raise SourceError("UNKNOWN_TABLE" if not found else "UNKNOWN_COLUMN", self.options["table"])
        return StructType([StructField(c, found[c]) for c in wanted or found])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema.names, int(self.options.get("partitions", "4")))


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").options(path=path, table=table, columns=",".join(columns or []), partitions=partitions).load()


def capabilities() -> dict[str, str]:
    """What can be read here: optional readers that aren't installed are unavailable, and say so when asked for."""
    import importlib.util

    out = {"csv": "AVAILABLE", "parquet": "AVAILABLE", "sqlite": "AVAILABLE", "jdbc": "NEEDS_DRIVER_JAR"}
    return out | {"xlsx": "AVAILABLE" if importlib.util.find_spec("openpyxl") else "UNAVAILABLE"}


def read_xlsx(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A worksheet as text; blank rows are left out and short ones filled with nulls. A workbook is one file of bounded size."""
    if capabilities()["xlsx"] != "AVAILABLE":
        raise SourceError("CAPABILITY_UNAVAILABLE", "openpyxl isn't installed")
    from openpyxl import load_workbook

    rows = [[None if c is None else str(c) for c in r] for r in load_workbook(path, read_only=True, data_only=True)[sheet].iter_rows(values_only=True)]
    head, body = rows[0], [r for r in rows[1:] if any(c is not None for c in r)]
    if any(not h for h in head) or len(set(head)) != len(head):
        raise SourceError("INVALID_HEADER", f"{head}")
    return spark.createDataFrame([(r + [None] * len(head))[: len(head)] for r in body], StructType([StructField(h, StringType()) for h in head]))
