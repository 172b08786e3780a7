"""Hierarchical multi-length packing of tokenized documents into training windows.

Documents are routed to context-size tiers by token count. Whole windows of the largest tier are cut from long
documents; the rest of them and all shorter documents are packed tier by tier into windows of the tier's length, and
the gaps of a window are filled from shorter tiers, cutting the last filler where it doesn't fit. Steps group windows of
all tiers to equal token budgets. Packing is local to shards of bounded size within each input partition, so nothing is
shuffled.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, span_hashes, strings, text_or_empty

TIERS = (256, 512, 1024, 2048)
END_ID = 1
SHARD_TOKENS = 1 << 20
STEP_WINDOWS = 32
CACHE_BYTES = 112 << 20  # of words and ids that a worker keeps
LONG_PART = 64  # bytes of a word above which it isn't kept
BATCH_WORDS = 4096
SLICE_BYTES = 1 << 20  # of text, encoded together
STRETCH_BYTES = 1 << 20  # of text, whose words are looked up together

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, window int, step_id long"
)


def runs(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[at : at + n] for each at and n, end to end."""
    return values[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]


ENTRY = np.dtype([("check", "<u8"), ("at", "<i8"), ("n", "<i8"), ("word_at", "<i8"), ("size", "<i8"), ("used", "?")])
ENTRY_BYTES = 8 + ENTRY.itemsize  # what an entry takes beside its word and ids


class WordIds:
    """Token ids, as little-endian bytes, of the parts of texts.

    The tokenizer drops white space, lowers letters and divides letters from signs before it looks at words, so a
    text's ids are those of its parts end to end, and those of a word with a closing sign after a letter of ASCII are the
    word's and the sign's.
    Texts with letters that change with what surrounds them stay as they are but for white space. Parts that aren't
    known yet are encoded by the tokenizer, many at once. The cache is a sorted table of hashes; two hashes of 64 bits
    tell parts apart. It is bounded by bytes: when it is full, only parts looked up since the last time stay, and long
    parts never enter it. That changes the speed alone.
    """

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.keys, self.entries = np.zeros(0, np.uint64), np.zeros(0, ENTRY)
        self.words, self.pool = np.zeros(0, np.uint8), np.zeros(0, "<u4")

    @property
    def known(self) -> dict[str, bytes]:
        """The words and ids that the cache holds."""
        e = self.entries
        ends = zip(e["word_at"].tolist(), e["size"].tolist(), e["at"].tolist(), e["n"].tolist(), strict=True)
        return {self.words[w : w + size].tobytes().decode(): self.pool[at : at + n].tobytes() for w, size, at, n in ends}

    def trim(self) -> None:
        if ENTRY_BYTES * len(self.keys) + self.words.nbytes + self.pool.nbytes < self.limit:
            return
        kept = np.flatnonzero(self.entries["used"])
        if 2 * len(kept) > len(self.keys):
            kept = kept[:0]
        e = self.entries[kept]
        self.keys, self.entries = self.keys[kept], e
        self.words, self.pool = runs(self.words, e["word_at"], e["size"]), runs(self.pool, e["at"], e["n"])
        e["word_at"], e["at"], e["used"] = np.cumsum(e["size"]) - e["size"], np.cumsum(e["n"]) - e["n"], False

    def look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each part are, and how many; the parts are different, and their keys ascend."""
        self.trim()
        place = np.searchsorted(self.keys, keys)
        near = np.minimum(place, max(len(self.keys) - 1, 0))
        same = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        hit = same.copy()
        hit[same] = self.entries["check"][near[same]] == checks[same]
        self.entries["used"][near[hit]] = True
        at, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[hit], n[hit] = self.entries["at"][near[hit]], self.entries["n"][near[hit]]
        new = np.flatnonzero(~hit)
        keep = ~same[new] & (ends[new] - starts[new] <= LONG_PART)
        new = np.concatenate([new[keep], new[~keep]])  # those that the cache keeps come first
        data = raw.tobytes()
        found, n[new] = self.encoded([data[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        at[new] = len(self.pool) + np.cumsum(n[new]) - n[new]
        ids, kept = np.concatenate([self.pool, found]), new[: keep.sum()]
        rows, sizes = np.zeros(len(kept), ENTRY), ends[kept] - starts[kept]
        rows["check"], rows["at"], rows["n"], rows["size"], rows["used"] = checks[kept], at[kept], n[kept], sizes, True
        rows["word_at"] = len(self.words) + np.cumsum(sizes) - sizes
        self.words = np.concatenate([self.words, runs(raw, starts[kept], sizes)])
        self.keys, self.entries = np.insert(self.keys, place[kept], keys[kept]), np.insert(self.entries, place[kept], rows)
        self.pool = ids if len(kept) == len(new) else ids[: len(self.pool) + n[kept].sum()].copy()
        return ids, at, n

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokenizer's ids of the words end to end, and how many each has."""
        found, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(words), BATCH_WORDS):  # the tokenizer's own results are far larger than the ids
            some = words[at : at + BATCH_WORDS]
            joined = f" {MARK} ".join(some)
            if len(self.mark) == 1 and joined.count(MARK) == len(some) - 1:
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
                marks = np.flatnonzero(ids == self.mark[0])
                sizes.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
                found.append(np.delete(ids, marks))
            else:
                lists = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                sizes.append(np.array([len(ids) for ids in lists], np.int64))
                found.append(np.array(list(chain.from_iterable(lists)), "<u4"))
        return np.concatenate(found), np.concatenate(sizes)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        plain = [unicodedata.is_normalized("NFC", t) and not ODD_CASES.search(t) for t in texts]
        coded = [(t.lower() if lower else t).encode() for t, lower in zip(texts, plain, strict=True)]
        data = b"\n".join(coded)
        starts = np.cumsum([0, *[len(c) + 1 for c in coded]])
        ids, counts = [], np.zeros(len(texts), np.int64)
        small = np.array(plain, bool)
        for at, stop in stretches(data):
            found, sizes, places = self.encode_stretch(data[at:stop], starts - at, small)
            np.add.at(counts, places, sizes)
            ids.append(found)
        whole = memoryview(np.concatenate(ids) if ids else np.zeros(0, "<u4")).cast("B")
        ends = 4 * np.cumsum(counts)
        return [bytes(whole[e - 4 * n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]

    def encode_stretch(self, data: bytes, texts: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a stretch, those of each text in it, and these texts' numbers; the texts begin at the given places.

        Each different part is looked up once. Equal parts are found by two hashes of 64 bits.
        """
        raw = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = (raw != 32) & (raw != 10)
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        owner = np.searchsorted(texts, starts, side="right") - 1
        # a sign after a small ASCII letter is a part of its own
        before = raw[np.maximum(ends - 2, 0)]
        closed = (ends - starts > 1) & IS_SIGN[raw[ends - 1]] & (before >= 97) & (before <= 122) & plain[owner]
        both = np.repeat(np.arange(len(starts)), 1 + closed)
        sign = np.zeros(len(both), bool)
        sign[1:] = both[1:] == both[:-1]
        starts, ends, owner = np.where(sign, ends[both] - 1, starts[both]), ends[both] - (closed[both] & ~sign), owner[both]
        if len(raw) <= STRETCH_BYTES:
            hashed, checks = span_hashes(raw, starts, ends), span_hashes(raw, starts, ends, seed=1)
            keys, first, slot = np.unique(hashed, return_index=True, return_inverse=True)
            clash = np.flatnonzero(checks != checks[first][slot])
            ids, at, n = self.look_up(raw, starts[first], ends[first], keys, checks[first])
        else:
            # a part longer than a stretch
            clash, slot = np.arange(len(starts)), np.zeros(len(starts), np.int64)
            ids, at, n = np.zeros(0, "<u4"), slot[:0], slot[:0]
        if len(clash):
            more, sizes = self.encoded([data[a:b].decode() for a, b in zip(starts[clash].tolist(), ends[clash].tolist(), strict=True)])
            slot[clash] = len(n) + np.arange(len(clash))
            ids, at, n = np.concatenate([ids, more]), np.concatenate([at, len(ids) + np.cumsum(sizes) - sizes]), np.concatenate([n, sizes])
        return runs(ids, at[slot], n[slot]), n[slot], owner

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


#: Capitals whose small form depends on what surrounds them, or takes several characters.
ODD_CASES = re.compile("[\u03a3\u0130]")
SIGNS = ".,;:!?"
MARK = "\x01"  # between words that are encoded together; words that hold it are encoded one by one
IS_SIGN = np.isin(np.arange(256), list(SIGNS.encode()))
_CODERS: dict[tuple[str, int], WordIds] = {}


def stretches(data: bytes) -> Iterator[tuple[int, int]]:
    """Runs of at most STRETCH_BYTES that end after white space or with the data; a longer part is a run of its own."""
    at = 0
    while at < len(data):
        stop = at + STRETCH_BYTES
        if stop < len(data):
            last = max(data.rfind(b" ", at, stop), data.rfind(b"\n", at, stop))
            if last < 0:
                last = min((k for k in (data.find(b" ", stop), data.find(b"\n", stop)) if k >= 0), default=len(data))
            stop = last + 1
        yield at, min(stop, len(data))
        at = stop


def coder_for(path: str, limit: int) -> WordIds:
    """One cache for each Python worker process; workers serve many tasks."""
    if (path, limit) not in _CODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        _CODERS[path, limit] = WordIds(path, limit)
    return _CODERS[path, limit]


class Pieces:
    """Pieces (document, start) by length, and which lengths there are, as the bits of a number."""

    def __init__(self):
        self.by_length: dict[int, deque[tuple[int, int]]] = {}
        self.lengths = 0

    def add(self, doc: int, start: int, length: int) -> None:
        if length:
            self.by_length.setdefault(length, deque()).append((doc, start))
            self.lengths |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        here = self.by_length[length]
        first = here.popleft()
        if not here:
            self.lengths ^= 1 << length
        return first

    def longest(self, limit: int) -> int:
        """The length of the longest piece of at most limit tokens; 0 if there is none."""
        return (self.lengths & ((2 << limit) - 1)).bit_length() - 1 if self.lengths & ((2 << limit) - 1) else 0

    def shortest(self) -> int:
        return (self.lengths & -self.lengths).bit_length() - 1


def plan_windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length) that hold each token of the documents once.

    A document's tier is the smallest that holds it; of longer ones, whole windows of the largest tier are cut off, and
    the rest is routed. Tiers are packed from the largest on: a window has its tier's length and begins with the longest
    piece, and its gap takes the longest pieces that fit, which are of shorter tiers. Where none fits, a piece of the
    shortest tier there is gives its head, and the rest of it is routed anew. So all windows are full, but for those
    that end a shard: once fewer tokens stay than the tier has, they are of the largest tiers that they fill.
    """
    top = tiers[-1]
    windows: list[list[tuple[int, int, int]]] = []
    pieces = Pieces()
    for doc, n in enumerate(lengths):
        whole = n - n % top
        windows.extend([(doc, at, top)] for at in range(0, whole, top))
        pieces.add(doc, whole, n - whole)
    left = sum(k * len(held) for k, held in pieces.by_length.items())
    while left:
        tier = next(t for t in tiers if pieces.longest(top) <= t)
        size = tier if left >= tier else next((t for t in reversed(tiers) if t <= left), left)
        window, room = [], size
        while room:
            length = pieces.longest(room)
            if length:
                doc, start = pieces.take(length)
            else:
                shortest = next(t for t in tiers if pieces.shortest() <= t)
                whole = pieces.longest(shortest)
                doc, start = pieces.take(whole)
                pieces.add(doc, start + room, whole - room)
                length = room
            window.append((doc, start, length))
            room -= length
        windows.append(window)
        left -= size
    return windows


def balance_steps(windows: list[list[tuple[int, int, int]]], tiers: tuple[int, ...], per_step: int) -> list[int]:
    """A step for each window: all steps take equal tokens, of windows of all tiers; the longest are dealt first, to the step with the fewest tokens."""
    sizes = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda w: (-sizes[w], -len(windows[w]), w))
    steps = max(1, -(-sum(sizes) // (per_step * tiers[-1])))
    heap, step_of = [(0, s) for s in range(steps)], [0] * len(windows)
    for w in order:
        load, s = heapq.heappop(heap)
        step_of[w] = s
        heapq.heappush(heap, (load + sizes[w], s))
    return step_of


def in_order_of_documents(windows: list[list[tuple[int, int, int]]], budget: int) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Windows by the mean place of their tokens' documents, and their steps: runs of windows of budget tokens."""
    sizes = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda w: (sum(p[0] * p[2] for p in windows[w]) / sizes[w], w))
    steps, before = [], 0
    for w in order:
        steps.append(before // budget)
        before += sizes[w]
    return [windows[w] for w in order], steps


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    step_windows: int = STEP_WINDOWS,
    in_order: bool = False,
    cache_bytes: int = CACHE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack (id, text) rows into windows; one row for each piece of a document.

    A null text counts as empty and still gives its end id. A null id is kept as null. Repeated rows are packed as
    often as they come. An empty table gives no rows. Other columns are ignored. Windows hold at most the largest
    tier's tokens, and words of any length are encoded whole; `window` is the length that a window is padded to. cache_bytes bounds the words that a worker keeps, for speed alone. With in_order, the sequences and steps of a shard
    follow its documents, and those of a table in ranges follow the ranges; else steps are balanced over the shard.
    """
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = coder_for(tokenizer_path, cache_bytes)
        ids: list[int | None] = []
        codes: list[bytes] = []
        held = sequences = steps = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences, steps
            windows = plan_windows([len(c) // 4 for c in codes], tiers)
            if in_order:
                windows, step_of = in_order_of_documents(windows, step_windows * tiers[-1])
            else:
                step_of = balance_steps(windows, tiers, step_windows)
            out: list[list] = [[] for _ in range(10)]
            for w, window in enumerate(windows):
                offset, filled = 0, sum(p[2] for p in window)
                tier = next(t for t in tiers if filled <= t)
                padded = filled if filled & (filled - 1) == 0 else tiers[-1]
                for doc, start, length in window:
                    row = (ids[doc], start, length, zlib.crc32(codes[doc][4 * start : 4 * (start + length)]), len(codes[doc]) // 4, (part << 33) + sequences + w, offset, tier, padded, (part << 33) + steps + step_of[w])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    offset += length
            sequences += len(windows)
            steps += max(step_of, default=-1) + 1
            ids.clear()
            codes.clear()
            kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            array, keys = strings(batch, "text"), batch.column("id").to_pylist()
            for a, b in slices(array, SLICE_BYTES):
                for key, code in zip(keys[a:b], coder.encode_all(array.slice(a, b - a).to_pylist()), strict=True):
                    ids.append(key)
                    codes.append(code + tail)
                    held += len(code) // 4 + 1
                    if held >= shard_tokens:
                        yield flush()
                        held = 0
        if codes:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
