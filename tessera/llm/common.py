"""Shared helpers: table access, checkpoints, and numpy word and shingle hashing over Arrow batches."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 18  # text handled at once by the numpy code; one longer text is handled alone

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
LONG_SPAN = 1024  # bytes, from which a span is hashed on its own


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set and all run in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage: computed once, kept in the shared folder, so that a lost executor costs no recomputation.

    A checkpoint keeps its plan's estimated size, which multiplies with every join of a loop; rows read from it have none.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.javaRDD(), kept.schema()), spark)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate rows, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined_by_weight(rows: DataFrame, table: DataFrame, key: str, weight: str, sums: tuple[int, int] | None = None) -> DataFrame:
    """rows joined with table, one row a key, on key, where weight says how many of the rows have the key.

    Keys of more rows than a quarter of a task's even share go by broadcast, so that no task gets all rows of a key.
    They are at most four a task, which bounds what is broadcast. Both sides are read twice then, so they should be
    pinned. sums: the sum and the largest of the weights, where they are known.
    """
    total, most = sums or weight_sums(table, weight)
    least = max(64, total // (4 * shuffle_width(rows.sparkSession)))
    if most <= least:
        return rows.join(table, key)
    hot = table.where(F.col(weight) > least)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(weight) <= least), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def weight_sums(table: DataFrame, weight: str) -> tuple[int, int]:
    return tuple(table.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first())


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that rows doesn't have."""
    taken, mark = {c.lower() for c in rows.columns}, "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply), so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts take at most limit bytes together; a longer text is a run of its own."""
    ends = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1 + array.offset)[array.offset :].astype(np.int64)
    row = 0
    while row < len(array):
        stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), len(array))
        yield row, stop
        row = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes end to end, and the len + 1 places where they begin and end."""
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1 + array.offset)[array.offset :].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans hash alike wherever they stand. Another seed gives another function.

    Eight bytes at a time go through a mixer, so that no two spans collide by the algebra of a polynomial. What is held
    beside a copy of the bytes grows with the number of spans, not with their length.
    """
    length = (ends - starts).astype(np.int64)
    out = mix64(length.astype(np.uint64) * _ODD + np.uint64(seed * 0x2545F4914F6CDD1D % (1 << 64)))
    if not len(length):
        return out
    data = np.zeros(len(raw) + 8, np.uint8)
    data[: len(raw)] = raw
    lanes = np.ndarray((len(raw) + 1,), "<u8", data, strides=(1,))
    # eight bytes of each span at a time; bytes beyond its end count as none
    out = mix64((out ^ (lanes[starts] & _FIRST_BYTES[np.minimum(length, 8)])) + _ODD)
    at, step = np.flatnonzero((length > 8) & (length <= LONG_SPAN)), 8
    while len(at):
        left = length[at] - step
        out[at] = mix64((out[at] ^ (lanes[starts[at] + step] & _FIRST_BYTES[np.minimum(left, 8)])) + _ODD)
        at, step = at[left > 8], step + 8
    for i in np.flatnonzero(length > LONG_SPAN).tolist():
        whole = hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(whole, "little")
    return out


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words: runs of bytes that aren't ASCII white space, cut at the texts' ends."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, owner


def shingle_hashes(array: pa.Array, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word shingle of the lower-cased texts, in text order; a text of fewer words is one shingle, an empty one none."""
    raw, offsets = text_bytes(pc.utf8_lower(array))
    starts, ends, owner = word_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = span_hashes(raw, starts, ends)
    factors = [np.uint64(pow(_BASE, 2 * k + 3, 1 << 64)) for k in range(words)]
    n = max(len(hashed) - words + 1, 0)
    whole = np.zeros(n, np.uint64)
    for k in range(words):
        whole += hashed[k : k + n] * factors[k]
    inside = owner[:n] == owner[words - 1 : words - 1 + n]
    doc, out = owner[:n][inside], mix64(whole[inside])
    counts = np.bincount(owner, minlength=len(array))
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        at = np.concatenate([[0], np.cumsum(counts)])
        extra = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = counts[short] > k
            extra[has] += hashed[at[short[has]] + k] * factors[k]
        doc, out = np.concatenate([doc, short]), np.concatenate([out, mix64(extra ^ _ODD)])
        order = np.argsort(doc, kind="stable")
        doc, out = doc[order], out[order]
    return doc, out


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as a plain string array without nulls."""
    column = batch.column(name)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column




