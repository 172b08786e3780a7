"""Substring dedup: words are removed that lie in a window of 50 words which also begins in an earlier document.

1. Hashes of all runs of 8 words are counted over the corpus; those that occur once can't be in a repeated window. 2. Each
document's windows whose 8-word runs all occur again are cut into segments: neighbouring windows with the same
smallest run hash, their anchor. Equal windows have equal anchors, wherever they stand. 3. Equal segments become one, with
their first document. 4. Segments are dealt by anchor to shards of bounded size, so equal windows meet; each shard builds
an FM-index of its segments and streams them past it: backward search gives how many words before each window's end
stand in an earlier document, and a window is repeated where these are 50. 5. An anchor with more different segments than a
shard may hold is dealt by whole windows instead, whose first documents are compared. 6. The repeated places of each
document are put together, and its other words are kept.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_weight, pinned, removed, shared_dir, span_hashes, strings, text_bytes, text_or_empty, weight_sums
from .fm_index import FMIndex
from .wordstream import Bitmap, Splitter, bucket_bits, common_hashes, cut_hash, run_hashes, spans_where, string_array

SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 50
RUN = 8  # words of a run
SHARD_WORDS = 1 << 18
LAST = (1 << 63) - 1  # the place of rows without an id
SEGMENTS = "doc_id long, node binary, place long, windows int, anchor long, words string, seg binary"


def run_codes(raw: np.ndarray, offsets: np.ndarray, splitter: Splitter, run: int):
    """Starts, ends, text numbers of words, and a hash of the run from each word on; `whole` tells which runs lie in one text."""
    starts, ends, owner = spans_where(~splitter.space[raw], offsets)
    codes = run_hashes(span_hashes(raw, starts, ends), run)
    return starts, ends, owner, codes, owner[: len(codes)] == owner[run - 1 : run - 1 + len(codes)]


def smallest(codes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each `width` codes from each place on, the first one of equals."""
    count = len(codes) - width + 1
    best, span = np.arange(len(codes)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(codes[right] < codes[left], right, left)
        span += step
    return best[:count]


def segments(docs: DataFrame, repeated, buckets: int, window: int, run: int) -> DataFrame:
    """Segments of the documents (doc_id, node, text): place of the first word, number of windows, anchor, words and a digest of them."""
    splitter = Splitter(SPACES, window - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = repeated.value
        for batch in batches:
            passed: dict[int, int] = {}  # words of a long text in its earlier pieces
            for raw, offsets, rows, own in splitter.pieces(strings(batch, "text")):
                starts, ends, owner, codes, whole = run_codes(raw, offsets, splitter, run)
                base = passed.get(int(rows[0]), 0)
                if len(rows) == 1:
                    passed[int(rows[0])] = base + int(np.searchsorted(starts, own))
                count = len(starts) - window + 1
                if count <= 0:
                    continue
                good = whole.copy()
                good[whole] = known.has(cut_hash(codes[whole], buckets))
                bad = np.concatenate([[0], np.cumsum(~good)])
                runs = window - run + 1
                at = np.flatnonzero((bad[runs : runs + count] == bad[:count]) & (owner[:count] == owner[window - 1 :]) & (starts[:count] < own))
                if not len(at):
                    continue
                anchor = smallest(codes, runs)[at]
                first = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
                begin, n = at[first], np.diff(np.append(np.flatnonzero(first), len(at)))
                end = begin + n + window - 2  # the last word
                after = np.cumsum(ends - starts + 1) - 1
                line = np.full(int(after[-1]) + 1, 32, np.uint8)
                line[np.arange(int((ends - starts).sum())) + np.repeat(np.arange(len(starts)), ends - starts)] = raw[~splitter.space[raw]]
                words = string_array(line, (after - (ends - starts))[begin], after[end])
                data, bounds = text_bytes(words)
                whose = rows[owner[begin]]
                place = begin - np.searchsorted(owner, owner[begin]) + (base if len(rows) == 1 else 0)
                digests = [hashlib.md5(data[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(whose)), batch.column("node").take(pa.array(whose)), pa.array(place.astype(np.int64)), pa.array(n.astype(np.int32)),
                        pa.array(codes[anchor[first]].view(np.int64)), words, pa.array(digests, pa.binary()),
                    ],
                    names=["doc_id", "node", "place", "windows", "anchor", "words", "seg"],
                )

    return docs.select("doc_id", "node", "text").mapInArrow(cut, SEGMENTS)


def repeated_runs(docs: DataFrame, buckets: int, run: int) -> DataFrame:
    """Cut hashes of runs that occur twice or more in the texts."""
    splitter = Splitter(SPACES, run - 1)

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for raw, offsets, _, own in splitter.pieces(strings(batch, "text")):
            starts, _, _, codes, whole = run_codes(raw, offsets, splitter, run)
            yield codes[whole & (starts[: len(codes)] < own)]

    return pinned(common_hashes(docs.select("text"), hashes, 2, buckets))


def searched(kinds: DataFrame, window: int, shards: int) -> DataFrame:
    """(seg, first, marks) from (seg, anchor, words, first): marks has a byte for each window of a segment, 1 where an earlier document has it."""

    def search(group: pa.Table) -> pa.Table:
        words = group.column("words").combine_chunks()
        raw, bounds = text_bytes(words)
        starts, ends, owner = spans_where(raw != 32, bounds)
        tokens = string_array(raw, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        offsets = np.searchsorted(owner, np.arange(len(words) + 1))
        _, rank = np.unique(group.column("first").to_numpy(), return_inverse=True)
        rank = rank.astype(np.int32)
        index = FMIndex(tokens, offsets, rank)
        count = np.diff(offsets) - window + 1
        # what all windows of a segment share, if they share anything, must be in an earlier document, too
        core = np.maximum(window - count + 1, 0)
        near = (core == 0) | (index.matched(tokens, offsets[:-1] + window, core, rank) == core)
        which = np.repeat(np.arange(len(count)), np.where(near, count, 0))
        nth = np.arange(len(which)) - np.repeat(np.cumsum(np.where(near, count, 0)) - np.where(near, count, 0), np.where(near, count, 0))
        hit = index.matched(tokens, offsets[which] + nth + window, np.full(len(which), window), rank[which]) == window
        marks = np.zeros(int(count.sum()), np.uint8)
        at = np.concatenate([[0], np.cumsum(count)])
        marks[at[which] + nth] = hit
        return pa.table({"seg": group.column("seg"), "first": group.column("first"), "marks": pa.array([marks[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    dealt = kinds.select("seg", "words", "first", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(search, "seg binary, first long, marks binary")


def by_windows(kinds: DataFrame, window: int) -> DataFrame:
    """The same as `searched` for the segments of common anchors: all their windows are dealt by their own words, and hold their first document."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for seg, words, first in zip(*(batch.column(c).to_pylist() for c in ("seg", "words", "first")), strict=True):
                w = words.encode().split(b" ")
                for k in range(len(w) - window + 1):
                    for column, value in zip(out, (seg, first, k, hashlib.sha256(b" ".join(w[k : k + window])).digest()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["seg", "first", "nth", "code"])

    cut = pinned(kinds.select("seg", "words", "first").mapInArrow(explode, "seg binary, first long, nth int, code binary"))
    least = pinned(cut.groupBy("code").agg(F.min("first").alias("least"), F.count("*").alias("n")))
    told = joined_by_weight(cut, least, "code", "n").select("seg", "first", "nth", F.when(F.col("least") < F.col("first"), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))).alias("mark"))
    marks = F.array_sort(F.collect_list(F.struct("nth", F.hex("mark").alias("mark"))))
    return told.groupBy("seg", "first").agg(F.unhex(F.array_join(F.transform(marks, lambda x: x["mark"]), "")).alias("marks"))


def repeated_places(docs: DataFrame, window: int = WINDOW, run: int = RUN, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, node, spans): the spans (place, words) of each document (doc_id, node, text) that lie in repeated windows; they may overlap."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = bucket_bits(size // 6)
    codes = repeated_runs(docs, buckets, run)
    repeated = Bitmap.of(codes, codes.count()).shared(spark)
    folder = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    segments(docs, repeated, buckets, window, run).write.parquet(folder)
    found = spark.read.schema(SEGMENTS).parquet(folder)
    kinds = pinned(found.groupBy("seg", "anchor", "words").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    n_words = F.length("words") - F.length(F.translate("words", " ", "")) + 1
    anchors = pinned(kinds.groupBy("anchor").agg(F.sum(n_words).alias("words")).where(F.col("words") > shard_words // 4).select("anchor"))
    total, hot = kinds.agg(F.coalesce(F.sum(n_words), F.lit(0))).first()[0], anchors.count()
    shards = max(1, -(-total // shard_words))
    if hot:
        cold = kinds.join(anchors, "anchor", "left_anti")
        told = searched(cold, window, shards).unionByName(by_windows(kinds.join(anchors, "anchor", "left_semi"), window))
    else:
        told = searched(kinds, window, shards)
    told = pinned(told.join(kinds.select("seg", "n"), "seg"))
    # equal rows of documents have equal places
    places = pinned(found.groupBy("doc_id", "node", "place").agg(F.first("windows").alias("windows"), F.first("seg").alias("seg")))
    of_all = joined_by_weight(places, told, "seg", "n", weight_sums(told, "n"))
    all_of_it = F.col("doc_id") > F.col("first")
    marks = F.when(all_of_it, F.lit(None)).otherwise(F.col("marks"))
    kept = of_all.where(all_of_it | (F.hex("marks").contains("01"))).select("doc_id", "node", F.struct("place", "windows", marks.alias("marks")).alias("span"))
    spans = pinned(kept.groupBy("doc_id", "node").agg(F.collect_list("span").alias("spans")))
    removed(spark, folder)
    return spans


def thinned(spans: list[dict] | None, window: int) -> np.ndarray | None:
    """Which of a document's words go, up to the last span's end, or None if none does."""
    if not spans:
        return None
    edge = np.zeros(max(s["place"] + s["windows"] for s in spans) + window, np.int64)
    for span in spans:
        place, n, marks = span["place"], span["windows"], span["marks"]
        if marks is None:
            edge[place] += 1
            edge[place + n + window - 1] -= 1
        else:
            hit = np.flatnonzero(np.frombuffer(marks, np.uint8)) + place
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicated_words(docs: DataFrame, window: int = WINDOW, run: int = RUN, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row: words that lie in windows which also begin in a document of a smaller id go.

    Null and empty texts have no words. Rows of one id are one document as far as order goes, so equal rows stay as they
    are, and rows without an id come after all others. Windows are judged on the input. Texts of any length are read in
    pieces; a single word is held whole. Other columns, whatever their names, are ignored, and an empty table gives no rows.
    """
    if not 1 < run <= window:
        raise ValueError("a run has more than one word and fits in the window")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    rows = rows.withColumn("node", F.unhex(F.md5("text")))
    spans = repeated_places(rows, window, run, shard_words)
    splitter = Splitter(SPACES, 0)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = strings(batch, "text")
            marks = [thinned(spans, window) for spans in batch.column("spans").to_pylist()]
            counts, gone, digests = [0] * len(array), [0] * len(array), [hashlib.sha256() for _ in marks]
            for raw, offsets, rows, own in splitter.pieces(array):
                data = raw[:own].tobytes()
                for row, a, b in zip(rows.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = data[a : min(b, own)].split()
                    before = counts[row]
                    counts[row] += len(words)
                    if marks[row] is not None:
                        go = marks[row][before : before + len(words)].tolist()
                        words = [w for w, x in zip(words, go + [False] * (len(words) - len(go)), strict=True) if not x]
                    lost = counts[row] - before - len(words)
                    if words:
                        # a space stands between what earlier pieces kept and this one
                        digests[row].update((b" " if before - gone[row] else b"") + b" ".join(words))
                    gone[row] += lost
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array([d.hexdigest() for d in digests])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = rows.join(spans, ["doc_id", "node"], "left").select("id", "text", "spans")
    return joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
