"""Bottom-k fingerprints of word-shingle hashes.

A fingerprint keeps the k smallest distinct hashes of a document's shingles and says whether those are all of them.
Fingerprints of parts merge into the fingerprint of the whole, and give estimates of resemblance, containment and
the count of distinct shingles; they are exact while a document has no more than k shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, shingle_hashes, shuffle_width, slices, strings, text_or_empty

SKETCH_SIZE = 128


@dataclass(frozen=True)
class Sketch:
    """values: the smallest hashes, rising; whole: whether there are no others; k: how many are kept at most."""

    values: np.ndarray
    whole: bool
    k: int = SKETCH_SIZE

    @classmethod
    def of(cls, hashes: np.ndarray, k: int = SKETCH_SIZE) -> Sketch:
        if len(hashes) > 8 * k:  # most hashes can't be among the smallest; repeated ones only widen the choice
            bound = np.partition(hashes, 4 * k)[4 * k]
            least = np.unique(hashes[hashes <= bound])
            if len(least) > k:
                return cls(least[:k], False, k)
        least = np.unique(hashes)
        return cls(least[:k], len(least) <= k, k)

    @classmethod
    def parse(cls, text: str, k: int = SKETCH_SIZE) -> Sketch:
        mark, _, code = text.partition(":")
        return cls(np.frombuffer(base64.b64decode(code), "<u8"), mark == "all", k)

    def __str__(self) -> str:
        return ("all:" if self.whole else "low:") + base64.b64encode(self.values.astype("<u8").tobytes()).decode()

    def merge(self, other: Sketch) -> Sketch:
        k = min(self.k, other.k)
        both = np.union1d(self.values, other.values)
        # beyond an incomplete part's largest kept hash nothing is known
        for part in (self, other):
            if not part.whole:
                both = both[both <= part.values[-1]]
        return Sketch(both[:k], self.whole and other.whole and len(both) <= k, k)

    def distinct(self) -> float:
        if self.whole:
            return float(len(self.values))
        return (len(self.values) - 1) / ((float(self.values[-1]) + 1) / 2.0**64)

    def resemblance(self, other: Sketch) -> float:
        """Shared share of the two documents' shingles together. Two without shingles are alike."""
        union = self.merge(other).values
        if not len(union):
            return 1.0
        shared = np.intersect1d(self.values, other.values, assume_unique=True)
        return float(np.isin(union, shared, assume_unique=True).mean())

    def containment(self, other: Sketch) -> float:
        """Share of this document's shingles that the other one has, too."""
        if not len(self.values):
            return 1.0
        common = self.resemblance(other) * self.merge(other).distinct()
        return min(1.0, common / max(self.distinct(), 1.0))


def sketches(array: pa.Array, k: int, words: int) -> list[Sketch]:
    doc, hashes = shingle_hashes(array, words)
    cuts = np.searchsorted(doc, np.arange(len(array) + 1))
    return [Sketch.of(hashes[a:b], k) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def fingerprint(docs: DataFrame, k: int = SKETCH_SIZE, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, n_shingles) for each row; nothing is shuffled. A null text counts as empty and has no shingles.

    Ids, null and repeated ones included, come out as they are, and so do repeated rows; other columns are ignored. An
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = strings(batch, "text")
            for a, b in slices(array):
                found = sketches(array.slice(a, b - a), k, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([str(s) for s in found]), pa.array([s.distinct() for s in found], pa.float64())],
                    names=[id_col, "fingerprint", "n_shingles"],
                )

    rows = docs.select(id_col, text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint string, n_shingles double")


PAIR_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_shingles double, in_edited double"
)


def placed_in(rows: DataFrame, borders: list[int]) -> DataFrame:
    """rows with `range`, the number of borders below their id: a binary search, one projection for each halving."""
    rows = rows.withColumn("range", F.lit(0))
    if not borders:
        return rows
    among = F.lit([Decimal(b) for b in borders]).cast("array<decimal(20,0)>")
    step = 1 << (len(borders).bit_length() - 1)
    while step:
        passed = F.coalesce(F.get(among, F.col("range") + (step - 1)) < F.col("doc_id"), F.lit(False))
        rows = rows.withColumn("range", F.col("range") + F.when(passed, step).otherwise(0))
        step >>= 1
    return rows


def with_next_in_order(docs: DataFrame, id_col: str, text_col: str, parts: int, null_ids: str) -> DataFrame:
    """Rows in ranges of rising id, each range closed by a copy of a row that follows it.

    The ranges' borders are approximate quantiles of the ids; their count is that of the partitions, so only so many
    numbers reach the driver, and so many rows are copied. After the last row comes a copy of the first. Rows without an
    id come last of all, in the order of their texts' hashes, so that they too are cut into ranges.
    Columns: range, doc_id (that place), id, text, closing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    if null_ids == "leave out":
        rows = rows.where(F.col("id").isNotNull()).withColumn("doc_id", F.col("id").cast("decimal(20,0)"))
    else:
        behind = F.shiftrightunsigned(F.xxhash64("text"), 1).cast("decimal(20,0)") + F.lit(Decimal(2**63))
        rows = rows.withColumn("doc_id", F.coalesce(F.col("id").cast("decimal(20,0)"), behind.cast("decimal(20,0)")))
    ids = rows.select("doc_id")
    found = ids.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    borders = sorted({int(x) for x in found})
    ids = placed_in(ids, borders)
    firsts = {r.range: r.first for r in ids.groupBy("range").agg(F.min("doc_id").alias("first")).collect()}
    order = sorted(firsts)
    if not order:
        return rows.select(F.lit(0).alias("range"), "doc_id", "id", "text", F.lit(False).alias("closing"))
    # the first row of a range also closes the range before it
    before = {b: a for a, b in zip([order[-1], *order[:-1]], order, strict=True)}
    first = F.lit([firsts.get(r) for r in range(len(borders) + 1)]).cast("array<decimal(20,0)>")
    closes = F.lit([before.get(r, -1) for r in range(len(borders) + 1)])
    own = F.array(F.struct(F.col("range"), F.lit(False).alias("closing")))
    copy = F.array(F.struct(F.get(closes, F.col("range")).alias("range"), F.lit(True).alias("closing")))
    placed = placed_in(rows, borders).withColumn("to", F.explode(F.when(F.col("doc_id") == F.get(first, F.col("range")), F.concat(own, copy)).otherwise(own)))
    return placed.select(F.col("to.range").alias("range"), "doc_id", "id", "text", F.col("to.closing").alias("closing"))


def edited_pairs(docs: DataFrame, k: int = SKETCH_SIZE, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", null_ids: str = "leave out") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document by id.

    The edited text is the document with its last quarter of code points replaced by the first as many of the next
    document. Texts are shuffled once, into id ranges, and each task goes through its range holding two texts. Null
    texts count as empty. Rows with a null id are left out, or come last (null_ids="last"), in an order that their texts
    give. Repeated ids follow each other in the order of their texts. An empty table gives no rows; other columns are
    ignored.
    """
    if null_ids not in ("leave out", "last"):
        raise ValueError(f"null_ids: {null_ids}")
    parts = shuffle_width(docs.sparkSession)
    # ranges of ranges, as hashed ones would leave some partitions empty and others with several
    placed = with_next_in_order(docs, id_col, text_col, parts, null_ids).repartitionByRange(parts, "range").sortWithinPartitions("range", "closing", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the range, id and text of the row before

        def measure(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
            texts = [r[1] for r in rows]
            nexts = [r[2] for r in rows]
            edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, nexts, strict=True)]
            # a row's next text is the text of the row after it, except at the end
            all_texts = pa.array([*texts, nexts[-1]], pa.string())
            own = sketches(all_texts, k, words)
            new = sketches(pa.array(edited, pa.string()), k, words)
            out = [
                [r[0] for r in rows],
                [len(t) for t in texts],
                [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                [str(s) for s in own[:-1]],
                [str(s) for s in new],
                [a.resemblance(b) for a, b in zip(own, new, strict=False)],
                [a.resemblance(b) for a, b in zip(own[:-1], own[1:], strict=True)],
                [s.distinct() for s in own[:-1]],
                [a.containment(b) for a, b in zip(own, new, strict=False)],
            ]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in PAIR_SCHEMA.split(", ")])

        ready: list[tuple[int, str, str]] = []
        size = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("range", "id", "closing")]
            texts = strings(batch, "text")
            for row in range(batch.num_rows):
                here, doc, closing = (c[row].as_py() for c in columns)
                text = texts[row].as_py()
                if held is not None and held[0] == here:
                    ready.append((held[1], held[2], text))
                    size += len(text)
                if closing and ready:  # the next range's texts don't follow on
                    yield measure(ready)
                    ready, size = [], 0
                elif size > 1 << 20:
                    yield measure(ready)
                    ready, size = [], 0
                held = None if closing else (here, doc, text)
        if ready:
            yield measure(ready)

    return placed.select("range", "id", "text", "closing").mapInArrow(run, PAIR_SCHEMA)
