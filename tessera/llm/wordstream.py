"""Words of whole texts in windows of bounded bytes, bounded bitmaps of hashes, and phrases as Arrow strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix64, slices, text_bytes

HELD_HASHES = 1 << 20  # that a task gathers before it hands them on
BLOCK_BITS = 15  # of bitmap_construct_agg's blocks
MOST_BITS = 27  # of a bitmap's width: 16 MB


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


class Splitter:
    """Cuts texts into pieces of about `limit` bytes, at separators, each followed by the next `ahead` words of its text."""

    def __init__(self, separators: bytes, ahead: int, limit: int = SLICE_BYTES):
        sep = b"[" + re.escape(separators) + b"]"
        self.space = byte_table(separators)
        self.limit = limit
        self._cut = re.compile(sep)
        self._ahead = re.compile(b"(?:%s*[^%s+){0,%d}" % (sep, sep[1:], ahead))

    def pieces(self, array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(bytes, offsets of texts in them, row numbers, end of the piece's own bytes), in order.

        Short texts come many to a piece, and a long one in pieces of its own; words that start from the own end on come
        again in the next piece. One word longer than the limit isn't cut.
        """
        raw, offsets = text_bytes(array)
        for a, b in slices(array, self.limit):
            first, last = int(offsets[a]), int(offsets[b])
            if b - a > 1 or last - first <= self.limit:
                yield raw[first:last], offsets[a : b + 1] - first, np.arange(a, b), last - first
                continue
            whole, at, row = raw[first:last], 0, np.array([a])
            data = memoryview(whole)
            while True:
                found = self._cut.search(data, at + self.limit) if len(whole) - at > self.limit else None
                own = found.start() if found else len(whole)
                end = self._ahead.match(data, own).end() if found else own
                yield whole[at:end], np.array([0, end - at]), row, own - at
                if not found:
                    break
                at = own


def spans_where(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of marked bytes, cut at the texts' ends."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def gathered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes end to end, and the len + 1 offsets of them."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return raw[at], offsets


def string_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of bytes as strings."""
    data, offsets = gathered(raw, starts, ends)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values, in order, across texts: the caller drops those that cross an end."""
    size = max(len(hashes) - n + 1, 0)
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total = (total + hashes[k : k + size]) * np.uint64(0x9FB21C651E98DF25)
    return mix64(total)


class Bitmap:
    """A set of 64-bit hashes with false members but no missing ones, of at most `most` bits whatever the set's size."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.width = bits, width

    @classmethod
    def of(cls, hashes: DataFrame, count: int, most: int = MOST_BITS, each: int = 128) -> Bitmap:
        """Of a column `hash` (long), with about `each` bits a member below the bound.

        Bits are dealt by block, so each block is built by one task; the driver holds at most 2 ** most bits.
        """
        width = min(most, max(BLOCK_BITS, int(count * each).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.column("hash").to_numpy().view(np.uint64)
                places = np.concatenate([found >> np.uint64(64 - width), mix64(found) >> np.uint64(64 - width)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places >> BLOCK_BITS), pa.array(places & ((1 << BLOCK_BITS) - 1))], names=["block", "bit"])

        blocks = hashes.select("hash").mapInArrow(run, "block long, bit long").repartition("block").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
        bits = np.zeros(1 << (width - 3), np.uint8)
        for row in blocks.toLocalIterator():
            start = row.block << (BLOCK_BITS - 3)
            bits[start : start + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
        return cls(bits, width)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be in the set."""
        first = (hashes >> np.uint64(64 - self.width)).astype(np.int64)
        found = (self.bits[first >> 3] >> (first & 7).astype(np.uint8)) & 1 > 0
        at = np.flatnonzero(found)
        second = (mix64(hashes[at]) >> np.uint64(64 - self.width)).astype(np.int64)
        found[at] = (self.bits[second >> 3] >> (second & 7).astype(np.uint8)) & 1 > 0
        return found

    def shared(self, spark: SparkSession):
        return spark.sparkContext.broadcast(self)


def packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising 32-bit codes and their counts (cut off at 65,535) as planes of bytes, of which most are alike and shrink when compressed."""
    steps = np.diff(codes, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    times = np.minimum(counts, 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T
    return steps.tobytes() + times.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 6
    planes = np.frombuffer(data, np.uint8).reshape(6, n)
    steps = np.ascontiguousarray(planes[:4].T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32), np.ascontiguousarray(planes[4:].T).view("<u2").ravel().astype(np.int64)


def common_hashes(rows: DataFrame, hashes_in, least: int, buckets: int) -> DataFrame:
    """Hashes (column `hash`) that occur `least` times or more, with only their first bits, as `cut_hash` leaves them.

    hashes_in gives arrays of hashes from a batch. Hashes are dealt to 2 ** buckets groups by their first bits, and travel
    packed: about three bytes each. Others that share those bits may be among the found ones; none is missing.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                if not held:
                    return
                found = np.concatenate(held) >> np.uint64(32 - buckets)
                found.sort()
                first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                counts, found = np.diff(np.append(first, len(found))), found[first]
                bucket, code = (found >> np.uint64(32)).astype(np.int32), found.astype(np.uint32)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(bucket)]
                blobs = [packed(code[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "codes"])

            for some in hashes_in(batch):
                held.append(some)
                size += len(some)
                if size > HELD_HASHES:
                    yield from flush()
                    held, size = [], 0
            yield from flush()

    def join(group: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in group.column("codes").to_pylist()]
        codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        often = np.add.reduceat(counts, first) >= min(least, 65535)  # counts in a part were cut off there
        bucket = group.column("bucket")[0].as_py()
        found = (np.uint64(bucket) << np.uint64(32) | codes[first][often].astype(np.uint64)) << np.uint64(32 - buckets)
        return pa.table({"hash": pa.array(found.view(np.int64))})

    return rows.mapInArrow(deal, "bucket int, codes binary").groupBy("bucket").applyInArrow(join, "hash long")


def cut_hash(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return hashes >> np.uint64(32 - buckets) << np.uint64(32 - buckets)


def bucket_bits(count: int) -> int:
    """So many bits that a bucket has about a million of `count` hashes."""
    return min(24, max(8, (int(count) >> 20).bit_length()))
