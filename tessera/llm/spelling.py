"""Spelling variants: words that differ in one code point, found by each word's full neighbourhood.

Every deletion, replacement and insertion over the alphabet that the vocabulary uses is made for each word, each result
once, and joined by its own characters with the vocabulary; equality says that the two are near, so no distance is
computed. A word has about (2 * length + 1) * alphabet neighbours, nearly all of them no words: a bitmap of the
vocabulary, which misses no member, keeps those from the join.

Words are runs of Latin letters up to U+00FF, so inside tasks a code point is one byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pinned, strings, text_or_empty
from .wordstream import Bitmap, Splitter, gathered, spans_where, string_array

BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2 ** 64
NEIGHBOURS_AT_ONCE = 1 << 21
FLUSH_BYTES = 1 << 22
LONG_RUN = 64  # bytes, from which a run's check sum is computed on its own

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
#: first bytes of all code points that aren't letters of a run
_SEPARATORS = bytes(b for b in range(0xF5) if (b < 128 and not _LETTERS[b]) or b == 0xC2 or b > 0xC3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Rules:
    """min_length, min_count: of a word; ratio: how many times as common its form is; damage: the share of runs, as 1 in so many, that lose a code point."""

    min_length: int = 7
    min_count: int = 2
    ratio: int = 10
    damage: int | None = 31


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def check_sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each span, each begun with the check sum of what stands before it."""
    state = begun.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    length = ends - starts
    order = np.argsort(-np.minimum(length, LONG_RUN + 1), kind="stable")
    at, left, state = starts[order], length[order], state[order]
    few = int((left > LONG_RUN).sum())
    for i in range(few):
        span = raw[at[i] : at[i] + left[i]].tobytes()
        state[i] = zlib.crc32(span, int(begun[order[i]])) ^ 0xFFFFFFFF
    at, left, rest = at[few:], left[few:], state[few:]
    for k in range(LONG_RUN):
        n = int(np.searchsorted(-left, -k, side="left"))  # spans of more than k bytes
        if not n:
            break
        rest[:n] = _CRC[(rest[:n] ^ raw[at[:n] + k]) & np.uint32(255)] ^ (rest[:n] >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def runs_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the maximal runs of letters in UTF-8, and their text numbers."""
    lead = raw == 0xC3
    inside = _LETTERS[raw] | lead
    inside[1:] |= lead[:-1]
    return spans_where(inside, offsets)


def damaged(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans without the code point of the given index, as bytes with starts and ends of their own."""
    spans, offsets = gathered(raw, starts, ends)
    first = spans & 0xC0 != 0x80  # a code point's first byte
    number = np.cumsum(first) - 1
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    number -= number[offsets[:-1]][owner]
    stay = number != index[owner]
    kept = np.concatenate([[0], np.cumsum(stay)])
    return spans[stay], kept[offsets[:-1]], kept[offsets[1:]]


def words_of(docs: DataFrame, rules: Rules) -> DataFrame:
    """(word, n) of the vocabulary; each task counts its words before they are shuffled."""
    splitter = Splitter(_SEPARATORS, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [zlib.crc32(f"{i}:".encode()) for i in strings(batch, "id").to_pylist()]
            begun, tables, held = np.array(ids, np.uint32), [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                if tables:
                    summed = pa.concat_tables(tables).group_by("word").aggregate([([], "count_all")])
                    yield from summed.rename_columns(["word", "n"]).combine_chunks().to_batches()

            for raw, offsets, rows, own in splitter.pieces(strings(batch, "text")):
                raw = _LOWER[raw]
                starts, ends, owner = runs_of(raw, offsets)
                lead = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(raw == 0xC3, out=lead[1:])
                length = ends - starts - (lead[ends] - lead[starts])
                long = (length >= rules.min_length) & (starts < own)
                starts, ends, owner, length = starts[long], ends[long], owner[long], length[long]
                if not len(starts):
                    continue
                hit = np.zeros(len(starts), bool)
                if rules.damage:
                    sums = check_sums(raw, starts, ends, begun[rows[owner]])
                    hit = (sums % np.uint32(rules.damage) == 0) & (length > rules.min_length)
                    lost = (sums % np.uint32(rules.damage) == 0) & ~hit
                    whole = ~hit & ~lost
                    if hit.any():
                        tables.append(pa.table({"word": string_array(*damaged(raw, starts[hit], ends[hit], sums[hit] % length[hit]))}))
                    starts, ends = starts[whole], ends[whole]
                tables.append(pa.table({"word": string_array(raw, starts, ends)}))
                held += sum(t.nbytes for t in tables[-2:])
                if held > FLUSH_BYTES:
                    yield from flush()
                    tables, held = [], 0
            yield from flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rules.min_count)


def narrowed(array: pa.Array) -> np.ndarray:
    """The words' code points as bytes, end to end."""
    return np.frombuffer("".join(array.to_pylist()).encode("latin-1"), np.uint8)


def lengths(array: pa.Array) -> np.ndarray:
    return np.array([len(w) for w in array.to_pylist()], np.int64)


def powers(n: int) -> np.ndarray:
    steps = np.full(n, BASE, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def neighbourhood(words: np.ndarray, alphabet: np.ndarray, at: range, up: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, hashes, distinct) of the neighbours of words of one length that change a place in `at`, as arrays of words x places (x alphabet).

    A place is an index of a code point; insertions stand before it, and after the last at the word's length. Not
    distinct are the word itself and what an earlier place gives, too.
    """
    m, size = words.shape
    codes = words.astype(np.uint64) + np.uint64(1)
    before = np.zeros((m, size + 1), np.uint64)  # hash of what stands before each place
    np.cumsum(codes * up[:size], axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    letters = alphabet.astype(np.uint64) + np.uint64(1)
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    inside = np.arange(at.start, min(at.stop, size))
    if len(inside):
        fixed = whole - codes[:, inside] * up[inside]
        yield "replaced", fixed[:, :, None] + letters * up[inside][None, :, None], words[:, inside, None] != alphabet
        again = np.zeros((m, len(inside)), bool)
        later = inside[inside > 0]
        again[:, inside > 0] = words[:, later] == words[:, later - 1]
        yield "deleted", before[:, inside] + (whole - before[:, inside + 1]) * inverse, ~again
    places = np.arange(at.start, at.stop)
    shifted = before[:, places] + (whole - before[:, places]) * np.uint64(BASE)
    fresh = np.ones((m, len(places), len(alphabet)), bool)
    later = places > 0
    fresh[:, later] = words[:, places[later] - 1, None] != alphabet
    yield "inserted", shifted[:, :, None] + letters * up[places][None, :, None], fresh


def spelled(word: bytes, kind: str, place: int, letter: int) -> str:
    change = b"" if kind == "deleted" else bytes([letter])
    return (word[:place] + change + word[place + (kind != "inserted") :]).decode("latin-1")


def near_candidates(vocabulary: DataFrame, alphabet: bytes, known, at_once: int = NEIGHBOURS_AT_ONCE) -> DataFrame:
    """(word, near) of all distinct neighbours that the bitmap doesn't rule out; known = None rules out none."""
    letters = np.frombuffer(alphabet, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = None if known is None else known.value
        for batch in batches:
            array = strings(batch, "word")
            flat, size = narrowed(array), lengths(array)
            ends = np.cumsum(size)
            names = array.to_pylist()
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                up = powers(n + 2)
                per_place = 2 * len(letters) + 1
                group = max(1, at_once // ((n + 1) * per_place))
                span = max(1, min(n + 1, at_once // (group * per_place)))
                for a in range(0, len(rows), group):
                    some = rows[a : a + group]
                    words = flat[(ends[some] - n)[:, None] + np.arange(n)]
                    word, near = [], []
                    for place in range(0, n + 1, span):
                        here = range(place, min(place + span, n + 1))
                        for kind, hashes, good in neighbourhood(words, letters, here, up):
                            good = good.copy()
                            if look is not None:
                                good[good] = look.has(mix64(hashes[good]))
                            for spot in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
                                row, at, letter = (*spot, 0)[:3]
                                word.append(names[some[row]])
                                near.append(spelled(words[row].tobytes(), kind, here.start + at, letters[letter]))
                    yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string())], names=["word", "near"])

    return vocabulary.select("word").mapInArrow(run, "word string, near string")


def letters_of(vocabulary: DataFrame) -> bytes:
    """The alphabet that the vocabulary uses: at most 90 code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(narrowed(strings(batch, "word"))).astype(np.int32))], names=["code"])

    return bytes(sorted(r.code for r in vocabulary.select("word").mapInArrow(run, "code int").distinct().collect()))


def bitmap_of(vocabulary: DataFrame):
    """A broadcast bitmap of the words, of at most 2 ** 27 bits; with very many words it lets more strangers through to the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = strings(batch, "word")
            flat, size = narrowed(array), lengths(array)
            ends = np.cumsum(size)
            up = powers(int(size.max(initial=0)))
            place = np.arange(len(flat)) - np.repeat(ends - size, size)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[place])])
            yield pa.RecordBatch.from_arrays([pa.array(mix64(total[ends] - total[ends - size]).view(np.int64))], names=["hash"])

    return Bitmap.of(vocabulary.select("word").mapInArrow(run, "hash long"), vocabulary.count()).shared(vocabulary.sparkSession)


def roots(forms: DataFrame) -> DataFrame:
    """(word, form, root) from (word, form): the end of each word's chain, by jumps that double in length. A chain has no circle, as counts grow along it."""
    links = pinned(forms.select("word", "form", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = pinned(links.join(ahead, "root", "left").select("word", "form", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = jumped.drop("moved")
        if not jumped.where("moved").take(1):
            return links


def variants(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary.

    Null texts and texts without runs give no words; a null id counts as an empty one in the check sum. Repeated rows
    count as often as they stand there. Ties between forms go to the smaller word in code-point order. Words of any
    length are held whole, and their neighbours are made in steps of bounded size. Other columns, whatever their names,
    are ignored, and an empty table gives no rows.
    """
    vocabulary = pinned(words_of(docs, rules))
    # dealt evenly by word, whatever the order in which counting left them
    near = near_candidates(vocabulary.repartition("word"), letters_of(vocabulary), bitmap_of(vocabulary))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    pairs = near.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    found = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    judged = vocabulary.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    taken = F.col("form_n") >= rules.ratio * F.col("n")
    judged = pinned(judged.select("word", "n", "n_near", F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n")))
    ends = roots(judged.where("form is not null").select("word", "form")).select("word", "root")
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
