"""Sources as files: what their footers say, whether they change around a read, and staging in parts that goes on after a loss."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tessera.operators.graph import settled
from tessera.sources.files import SourceError

BOUNDED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "boolean")  # types whose least and largest values footers keep whole


# --- footers -------------------------------------------------------------------------------------------------------


def counts_and_bounds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row of `rows`, and `n_<i>`, `least_<i>` and `most_<i>` of each column whose type has them."""
    kinds, wanted = dict(rows.dtypes), [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        if kinds[c] in BOUNDED or kinds[c] in ("string", "timestamp", "timestamp_ntz", "binary") or kinds[c].startswith("decimal"):
            wanted.append(F.count(f"`{c}`").alias(f"n_{i}"))
        if kinds[c] in BOUNDED:
            wanted += [F.min(f"`{c}`").alias(f"least_{i}"), F.max(f"`{c}`").alias(f"most_{i}")]
    return rows.agg(*wanted)


def footer_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """`counts_and_bounds` of a Parquet table from its footers alone.

    The scan answers by each file's metadata, in tasks; no page of data is read. A session of its own has the settings
    for it, so that the caller's reads stay as they are.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return counts_and_bounds(own.read.parquet(path), columns)


def footer_statistics(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """(column, rows, values, nulls, least, most) of a Parquet table, exact, without reading its data.

    Bounds are given, as texts, for numbers, days and truth values; footers may cut texts off, so these have none. A nested
    column has only the row count. Footers may lack statistics, as of a column that is null throughout a row group; then the
    named columns are read instead.
    """
    kinds = dict(spark.read.parquet(path).dtypes)
    names = columns or list(kinds)
    missing = sorted(set(names) - set(kinds))
    if missing:
        raise SourceError("UNKNOWN_COLUMN", ", ".join(missing))
    try:
        row = footer_rows(spark, path, names).first().asDict()
    except (PySparkException, Py4JJavaError) as error:
        if "FAILED_READ_FILE" not in str(error):
            raise
        # a file that can't be read at all fails here, too
        row = counts_and_bounds(spark.read.parquet(path), names).first().asDict()

    def bound(value) -> str | None:
        return None if value is None else str(value + 0.0 if isinstance(value, float) else value)  # no negative zero

    cells = [(c, row["rows"], row.get(f"n_{i}"), bound(row.get(f"least_{i}")), bound(row.get(f"most_{i}"))) for i, c in enumerate(names)]
    out = spark.createDataFrame(cells, "column string, rows long, values long, least string, most string")
    return out.select("column", "rows", "values", (F.col("rows") - F.col("values")).alias("nulls"), "least", "most")


# --- change around a read ------------------------------------------------------------------------------------------


def file_states(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """(path, size, modified, digest) of a source's files as they are now; the digest, of their bytes, only if it's asked for.

    Without digests no content is read. A file that is written anew with its old size within one tick of the clock shows in
    its digest alone.
    """
    spark.catalog.refreshByPath(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), (F.sha2("content", 256) if digests else F.lit(None).cast("string")).alias("digest"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files that are new, gone or different."""
    same = reduce(lambda x, y: x & y, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("size", "modified", "digest")])
    both = before.alias("b").join(after.alias("a"), "path", "full")
    change = F.when(F.col("b.size").isNull(), "NEW").when(F.col("a.size").isNull(), "GONE").when(~same, "CHANGED")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


@contextmanager
def unchanged(spark: SparkSession, path: str, digests: bool = False) -> Iterator[DataFrame]:
    """Gives the Parquet rows of a path to a block; a change of the files before its end is an error, and what the block made isn't to be used.

    The files' states are kept before the first read, held against those that the scan itself planned with, and against the
    states when the block ends.
    """
    before = settled(file_states(spark, path, digests))
    rows = spark.read.parquet(path)
    planned = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified")).distinct()
    # files without rows aren't seen by the scan
    odd = planned.join(before.drop("digest"), ["path", "size", "modified"], "left_anti").select("path", F.lit("CHANGED").alias("change"))
    _refuse(odd, "before it was read")
    yield rows
    _refuse(changes(before, file_states(spark, path, digests)), "while it was read")


def _refuse(found: DataFrame, when: str) -> None:
    some = found.orderBy("path").take(5)
    if some:
        raise SourceError("SNAPSHOT_INVALID", f"the source has changed {when}: " + ", ".join(f"{r.path} ({r.change})" for r in some))


# --- parts under a manifest ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Store:
    """A folder with parts and their manifest: one file a part, named by its key, which is written once and never changed."""

    spark: SparkSession
    folder: str

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> dict[int, dict]:
        """Registered parts by key; as many as the stage was cut into."""
        where, store = self._at(f"{self.folder}/manifest")
        if not store.exists(where):
            return {}
        rows = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifest").collect()
        return {e["part"]: e for e in (json.loads(r.value) for r in rows)}

    def register(self, entry: dict) -> None:
        """A part enters the manifest whole: its file is written aside and given its name, which fails if another has it."""
        target, store = self._at(f"{self.folder}/manifest/part-{entry['part']:06}.json")
        aside, _ = self._at(f"{self.folder}/.manifest-{uuid.uuid4().hex}")
        stream = store.create(aside)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        store.mkdirs(target.getParent())
        if store.exists(target) or not store.rename(aside, target):
            store.delete(aside, False)
            raise SourceError("PART_COLLISION", f"part {entry['part']} is registered already")

    def forget(self, part: int) -> None:
        target, store = self._at(f"{self.folder}/manifest/part-{part:06}.json")
        store.delete(target, False)

    def has(self, path: str) -> bool:
        where, store = self._at(path)
        return store.exists(where)


def digests_of(rows: DataFrame) -> DataFrame:
    """(part, rows, digest) of rows with a column `_part`, whatever their order: counts and two sums of a row hash, as one text."""
    columns = [F.to_json(c) if t.startswith("map") else F.col(f"`{c}`") for c, t in rows.dtypes if c != "_part"]
    hashed = F.xxhash64(*columns)
    sums = [F.sum(hashed.cast("decimal(38,0)")), F.sum(F.shiftright(hashed, 32).cast("decimal(38,0)") * F.lit(31))]
    return rows.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("rows"), F.concat_ws(":", *[s.cast("string") for s in sums]).alias("digest"))


def dealt(rows: DataFrame, key: list[str], parts: int) -> DataFrame:
    """rows with `_part`, from the hash of their logical key."""
    return rows.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key]), F.lit(parts)).cast("int"))


def stage_parts(rows: DataFrame, folder: str, key: list[str], parts: int) -> dict:
    """Write rows in parts by their key, each registered with a digest of its own; only parts that aren't there yet are written.

    Called again after a failure it goes on with what is missing, and with parts whose files were lost. A part that is there
    with the same content is left as it is; another content is an error, as a snapshot never changes. Gives the numbers
    of parts written, found in place, and staged anew after a loss.
    """
    spark, store = rows.sparkSession, Store(rows.sparkSession, folder)
    spread = dealt(rows, key, parts)
    wanted = {r.part: (r.rows, r.digest) for r in digests_of(spread).collect()}  # a row a part
    known = store.entries()
    schema = rows.schema.json()
    for part, entry in known.items():
        if (entry["parts"], entry["key"], entry["schema"]) != (parts, key, schema) or (entry["rows"], entry["digest"]) != wanted.get(part):
            raise SourceError("PART_COLLISION", f"part {part} is registered with other content")
    sound = verified(store, known)
    lost = sorted(set(known) - sound)
    for part in lost:
        store.forget(part)
    todo = sorted(set(wanted) - sound)
    if todo:
        attempt = f"{folder}/parts/{uuid.uuid4().hex}"
        # one folder a part, written by one task each
        spread.where(F.col("_part").isin(todo)).repartition(len(todo), "_part").write.option("compression", "zstd").partitionBy("_part").parquet(attempt)
        written = {r.part: (r.rows, r.digest) for r in digests_of(spark.read.parquet(attempt).select(*rows.columns, "_part")).collect()}
        for part in todo:
            if written.get(part) != wanted[part]:
                raise SourceError("PART_INVALID", f"part {part} isn't what was to be written")
            store.register({"part": part, "parts": parts, "key": key, "schema": schema, "folder": f"{attempt}/_part={part}", "rows": wanted[part][0], "digest": wanted[part][1]})
    return {"written": len(todo) - len(lost), "in_place": len(sound), "restaged": len(lost)}


def verified(store: Store, entries: dict[int, dict]) -> set[int]:
    """The registered parts whose files are there and have their registered content."""
    there = {p: e for p, e in entries.items() if store.has(e["folder"])}
    if not there:
        return set()
    found = {}
    for attempt in sorted({e["folder"].rpartition("/")[0] for e in there.values()}):
        mine = [p for p, e in there.items() if e["folder"].startswith(attempt + "/")]
        rows = store.spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).option("basePath", attempt)
        rows = rows.schema(StructType.fromJson(json.loads(there[mine[0]]["schema"])).add("_part", IntegerType())).parquet(*[there[p]["folder"] for p in mine])
        # a file that can't be read gives no rows, so its part's digest is another one
        found |= {r.part: (r.rows, r.digest) for r in digests_of(rows).collect()}
    return {p for p, e in there.items() if found.get(p) == (e["rows"], e["digest"])}


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a finished stage, after every part has been held against the manifest. A part that is lost or changed is an error."""
    store = Store(spark, folder)
    entries = store.entries()
    if not entries:
        raise SourceError("SNAPSHOT_INVALID", f"{folder} has no parts")
    bad = sorted(set(entries) - verified(store, entries))
    if bad:
        raise SourceError("SNAPSHOT_INVALID", f"parts {bad[:5]} of {folder} are lost or changed")
    folders = [e["folder"] for e in entries.values()]
    return spark.read.schema(StructType.fromJson(json.loads(next(iter(entries.values()))["schema"]))).parquet(*folders)

