"""Quality classifier with supervised subword embeddings.

A document is the mean of learned vectors of its hashed features: words, word pairs, character n-grams of its bytes,
and, for each word and word pair, how far back it stood before (in powers of two), hashed like a further word. A softmax layer over that mean gives the class. Vectors and layer are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows. Scoring folds the layer into
the vectors, so that each feature adds one number and every whole text is scored in one pass of numpy code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from .common import fresh, mix64, pinned, slices, span_hashes, strings, text_bytes, text_or_empty, word_spans

CUT = 0.3  # score from which a document is predicted good
FOLDS = 5
WINDOW_BYTES = 1 << 18  # bytes whose n-grams are taken at once


@dataclass(frozen=True)
class Settings:
    """rows_per_class bounds the labelled rows that training reads, bytes_per_class their features; all else shapes the model."""

    rows_per_class: int = 800
    bytes_per_class: int = 128 << 20
    buckets: int = 1 << 18
    dim: int = 12
    ngrams: tuple[int, ...] = (3, 5)
    epochs: int = 6
    rate: float = 0.5
    decay: float = 1e-5
    batch: int = 16
    seed: int = 17


def feature_parts(array: pa.Array, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every feature of the whole texts, in parts; an empty text has none.

    Byte n-grams come in windows of WINDOW_BYTES, so that what is held beside the texts grows with their words alone.
    """
    mask = np.uint64(settings.buckets - 1)
    raw, offsets = text_bytes(array)
    starts, ends, owner = word_spans(raw, offsets)
    if len(starts):
        words = span_hashes(raw, starts, ends)
        del starts, ends
        yield owner, (words & mask).astype(np.int64)
        yield owner, (recurrence(owner, words, 1) & mask).astype(np.int64)
        same = owner[:-1] == owner[1:]
        pair_owner, pairs = owner[:-1][same], mix64(words[:-1] * np.uint64(3) + words[1:])[same]
        del words, same
        yield pair_owner, (pairs & mask).astype(np.int64)
        yield pair_owner, (recurrence(pair_owner, pairs, 2) & mask).astype(np.int64)
        del pair_owner, pairs
    del owner
    for n in settings.ngrams:
        for at in range(0, len(raw) - n + 1, WINDOW_BYTES):
            # windows overlap by n - 1 bytes, so each n-gram starts in one of them
            wide = raw[at : at + WINDOW_BYTES + n - 1].astype(np.uint64)
            place = np.searchsorted(offsets, np.arange(at, at + len(wide)), side="right") - 1
            count = len(wide) - n + 1
            value = np.full(count, n, np.uint64)
            for k in range(n):
                value = value * np.uint64(0x100000001B3) + wide[k : k + count]
            same = place[:count] == place[n - 1 : n - 1 + count]
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            yield place[:count][same], ((value[same] >> np.uint64(40)) & mask).astype(np.int64)


def feature_buckets(array: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature of texts that are short enough to hold all of them."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *feature_parts(array, settings)]
    return np.concatenate([o for o, _ in parts]), np.concatenate([c for _, c in parts])


def bucket_counts(array: pa.Array, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text, ascending, and how many of its features are in each."""
    if len(array) == 1:  # it may be of any length
        total = np.zeros(settings.buckets, np.int64)
        for _, code in feature_parts(array, settings):
            total += np.bincount(code, minlength=settings.buckets)
        found = np.flatnonzero(total)
        return [(found, total[found])]
    owner, code = feature_buckets(array, settings)
    key, counts = np.unique(owner * settings.buckets + code, return_counts=True)
    cut = np.searchsorted(key, np.arange(len(array) + 1) * settings.buckets)
    return [(key[s:e] & (settings.buckets - 1), counts[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]


def recurrence(owner: np.ndarray, values: np.ndarray, kind: int) -> np.ndarray:
    """For each value a hash of the bit length of the distance to its last place in the same text; of 0 where there is none."""
    keyed = mix64(values + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    near = np.zeros(len(values), np.int64)
    again = np.flatnonzero(keyed[order[1:]] == keyed[order[:-1]])
    near[order[again + 1]] = order[again + 1] - order[again]
    return mix64(np.frexp(near.astype(np.float64))[1].astype(np.uint64) + np.uint64(kind << 8))


@dataclass
class Model:
    """weights: what a feature adds to the log-odds of class 1, per bucket; bias: the log-odds of an empty text."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def score(self, array: pa.Array) -> np.ndarray:
        total, count = np.zeros(len(array)), np.zeros(len(array), np.int64)
        for owner, code in feature_parts(array, self.settings):
            total += np.bincount(owner, weights=self.weights[code], minlength=len(array))
            count += np.bincount(owner, minlength=len(array))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """Fit on (buckets, shares, label) samples: one softmax step for each small batch, classes drawn in turn."""
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1, 1, (settings.buckets, settings.dim)).astype(np.float32) / settings.dim
    layer, bias = np.zeros((settings.dim, 2), np.float32), np.zeros(2, np.float32)
    by_class = [[k for k, s in enumerate(samples) if s[2] == c] for c in (0, 1)]
    if not by_class[0] or not by_class[1]:  # nothing to tell apart: the one class that was seen, or undecided
        seen = 0.0 if not samples else (4.0 if by_class[1] else -4.0)
        return Model(np.zeros(settings.buckets, np.float32), seen, settings)
    steps = settings.epochs * (len(samples) // settings.batch + 1)
    for step in range(steps):
        rate = settings.rate * (1 - step / steps)
        drawn = [int(rng.choice(by_class[k % 2])) for k in range(settings.batch)]
        codes = np.concatenate([samples[k][0] for k in drawn])
        share = np.concatenate([samples[k][1] for k in drawn])
        sizes = np.array([len(samples[k][0]) for k in drawn])
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rows = np.repeat(np.arange(len(drawn)), sizes)
        hidden = np.zeros((len(drawn), settings.dim), np.float32)
        filled = sizes > 0
        hidden[filled] = np.add.reduceat(vectors[codes] * share[:, None], at[filled])
        logits = hidden @ layer + bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        odds[np.arange(len(drawn)), [samples[k][2] for k in drawn]] -= 1
        back = odds @ layer.T
        layer -= rate * (hidden.T @ odds / len(drawn) + settings.decay * layer)
        bias -= rate * odds.mean(axis=0)
        # the mean's gradient is spread over a text's features; scaled up, as each takes a small share
        order = np.argsort(codes, kind="stable")
        grown = (back[rows] * share[:, None])[order]
        codes = codes[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        vectors[codes[first]] -= rate * settings.dim * np.add.reduceat(grown, first)
    weights = vectors @ (layer[:, 1] - layer[:, 0])
    return Model(weights.astype(np.float32), float(bias[1] - bias[0]), settings)


def fold_of(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def training_samples(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str, label_col: str) -> list:
    """Features of at most rows_per_class labelled texts of each class, outside fold 0.

    Rows are chosen by the hash of their id, as many as have bytes_per_class of features together, and one at least.
    An id with several labels takes their majority, a tie counts as good;
    null ids and null labels aren't used.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold_of(id_col) != 0))
        .groupBy(F.col(id_col).alias("key"))
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    )
    # a bounded choice: two ordered limits, each of rows_per_class rows
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("key"), "key").limit(settings.rows_per_class) for c in (0, 1)]
    chosen = pinned(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    # of an id's texts, the one with the smallest hash
    picked = texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = strings(batch, "text")
            for a, b in slices(array):
                rows = bucket_counts(array.slice(a, b - a), settings)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(a, b - a),
                        pa.array([c.astype("<u4").tobytes() for c, _ in rows], pa.binary()),
                        pa.array([(n / max(n.sum(), 1)).astype("<f4").tobytes() for _, n in rows], pa.binary()),
                        batch.column("label").slice(a, b - a),
                    ],
                    names=["key", "codes", "shares", "label"],
                )

    kind = dict(texts.dtypes)["key"]
    # at most rows_per_class rows a class stand in a window
    rows = pinned(picked.select("key", "text", "label").mapInArrow(features, f"key {kind}, codes binary, shares binary, label int"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key")
    size = (F.octet_length("codes") + F.octet_length("shares")).cast("long")
    sized = rows.select("key", "label", F.sum(size).over(order).alias("bytes"), F.row_number().over(order).alias("place"))
    within = sized.where((F.col("bytes") <= settings.bytes_per_class) | (F.col("place") == 1)).select("key")
    rows = rows.join(F.broadcast(within), "key").collect()
    rows.sort(key=lambda r: r.key)
    return [(np.frombuffer(r.codes, "<u4"), np.frombuffer(r.shares, "<f4"), r.label) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    return train(training_samples(docs, labels, settings, id_col, text_col, label_col), settings)


def score(docs: DataFrame, model: Model, cut: float = CUT, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all by default) with `score` and `predicted`.

    Every row gets a score: a null or empty text that of the class balance alone. Rows are kept one for one, repeated
    ones too; an empty table stays empty. Columns of docs with those two names are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    (whole,) = fresh(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * 4 bytes, set by Settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = strings(batch, whole)
            for a, b in slices(array):
                found = shared.value.score(array.slice(a, b - a))
                columns = [batch.column(c).slice(a, b - a) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64()), pa.array((found >= cut).astype(np.int32))], names=[*kept, "score", "predicted"])

    rows = docs.select(*kept, text_or_empty(text_col).alias(whole))
    schema = StructType([*(docs.schema[c] for c in kept), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(run, schema)
