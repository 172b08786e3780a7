"""Collocations: phrases of two to five words that occur together more often than their parts make likely.

N-grams of all sizes are exploded into rows and counted by language. Most of them occur once, and would make the shuffle
many times the input, so a sieve goes before: words are counted, then hashes of pairs of frequent words, then hashes
of longer phrases whose pairs are frequent; a phrase can't be more common than its parts. Only phrases whose hash is common
enough are exploded. Hashes and bitmaps may let rare phrases through, never lose a frequent one, and all counts come
from the rows. Candidates are then cut after each word, joined with the counts of both parts, scored in decimals
of 38 digits, thinned by an anti-join with their one-word extensions, and ranked.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pinned, span_hashes, strings, text_bytes, text_or_empty
from .wordstream import Bitmap, Splitter, bucket_bits, byte_table, common_hashes, cut_hash, run_hashes, spans_where, string_array

BLANKS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
FLUSH_BYTES = 1 << 22  # of phrases that a task counts before it hands them on
SALTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = byte_table(BREAKS)


@dataclass(frozen=True)
class Limits:
    """min_count: of a candidate; max_words: of one; cover: share of its count, in percent, that lets a longer candidate replace it; top: of each language."""

    min_count: int = 100
    max_words: int = 5
    cover: int = 100
    top: int = 2000


def hashes_of(array: pa.Array) -> np.ndarray:
    """A hash of each string as a whole."""
    raw, offsets = text_bytes(array)
    return span_hashes(raw, offsets[:-1], offsets[1:])


@dataclass(frozen=True)
class Sieve:
    """What may be frequent: runs of `unit` words in `parts`, and, where it is given, the phrases themselves in `whole`, by hashes cut to `buckets`."""

    parts: Broadcast | None = None
    unit: int = 1
    whole: Broadcast | None = None
    buckets: int = 0


def possible(text: pa.Array, lang: pa.Array, sizes: range, splitter: Splitter, sieve: Sieve) -> Iterator[tuple]:
    """(row numbers, hashes, phrases) of what the sieve lets through; phrases is a function that makes their strings."""
    tongue = hashes_of(lang)
    parts = sieve.parts.value if sieve.parts else None
    whole = sieve.whole.value if sieve.whole else None
    unit = sieve.unit
    for raw, offsets, rows, own in splitter.pieces(text):
        raw = _LOWER[raw]
        starts, ends, owner = spans_where(~splitter.space[raw], offsets)
        if not len(starts):
            continue
        breaks = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_BREAK[raw], out=breaks[1:])
        part = breaks[starts] + owner  # words of one part of a text have one number
        hashes = span_hashes(raw, starts, ends) ^ tongue[rows][owner]
        alive = np.ones(max(len(starts) - unit + 1, 0), bool)
        if parts is not None:
            alive = parts.has(cut_hash(run_hashes(hashes, unit), sieve.buckets))
        dead = np.concatenate([[0], np.cumsum(~alive)])

        @functools.cache
        def joined(raw=raw, starts=starts, ends=ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """All words, each followed by one space, and where they begin and end."""
            after = np.cumsum(ends - starts + 1) - 1
            line = np.full(int(after[-1]) + 1, 32, np.uint8)
            line[np.arange(int((ends - starts).sum())) + np.repeat(np.arange(len(starts)), ends - starts)] = raw[~splitter.space[raw]]
            return line, after - (ends - starts), after

        for n in sizes:
            count = len(starts) - n + 1
            if count <= 0:
                continue
            at = np.flatnonzero((part[:count] == part[n - 1 :]) & (starts[:count] < own) & (dead[n - unit + 1 : n - unit + 1 + count] == dead[:count]))
            found = run_hashes(hashes, n)[at]
            if whole is not None:
                good = whole.has(cut_hash(found, sieve.buckets))
                at, found = at[good], found[good]

            def phrases(at=at, n=n, joined=joined) -> pa.Array:
                line, begin, end = joined()
                return string_array(line, begin[at], end[at + n - 1])

            if len(at):
                yield rows[owner[at]], found, phrases


def counted(docs: DataFrame, sizes: range, least: int, sieve: Sieve = Sieve(), totals: bool = False) -> DataFrame:
    """(lang, phrase, n) of phrases with `least` occurrences or more, and, if asked for, all words of a language under a null phrase.

    docs: (lang, text). Each task counts what it explodes before it is shuffled, so common phrases are few rows.
    """
    splitter = Splitter(BLANKS + BREAKS, max(sizes) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = strings(batch, "lang")
            names = lang.dictionary_encode()
            code, tables, held = names.indices.to_numpy(), [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                if tables:
                    summed = pa.concat_tables(tables).group_by(["code", "phrase"]).aggregate([([], "count_all")])
                    whole = pa.table({"lang": names.dictionary.take(summed.column("code").combine_chunks()), "phrase": summed.column("phrase"), "n": summed.column("count_all")})
                    if totals:
                        found = whole.group_by("lang").aggregate([("n", "sum")])
                        whole = pa.concat_tables([whole, pa.table({"lang": found.column("lang"), "phrase": pa.nulls(len(found), pa.string()), "n": found.column("n_sum")})])
                    yield from whole.combine_chunks().to_batches()

            for rows, _, phrases in possible(strings(batch, "text"), lang, sizes, splitter, sieve):
                tables.append(pa.table({"code": pa.array(code[rows], pa.int32()), "phrase": phrases()}))
                held += tables[-1].nbytes
                if held > FLUSH_BYTES:
                    yield from flush()
                    tables, held = [], 0
            yield from flush()

    found = docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= least) | F.col("phrase").isNull())


def sieved(docs: DataFrame, sizes: range, least: int, sieve: Sieve) -> DataFrame:
    """Cut hashes of the phrases of these sizes that may have `least` occurrences."""
    splitter = Splitter(BLANKS + BREAKS, max(sizes) - 1)

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, found, _ in possible(strings(batch, "text"), strings(batch, "lang"), sizes, splitter, sieve):
            yield found

    return pinned(common_hashes(docs, hashes, least, sieve.buckets))


def word_codes(words: DataFrame, buckets: int) -> DataFrame:
    """The cut hashes of words (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = run_hashes(hashes_of(strings(batch, "phrase")) ^ hashes_of(strings(batch, "lang")), 1)
            yield pa.RecordBatch.from_arrays([pa.array(cut_hash(found, buckets).view(np.int64))], names=["hash"])

    return words.select("lang", "phrase").mapInArrow(run, "hash long")


def frequent_phrases(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(lang, phrase, n) of all phrases of 1 to max_words words with min_count occurrences or more, and (lang, null, words)."""
    least, spark = limits.min_count, docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    words = pinned(counted(rows, range(1, 2), least, totals=True))
    if limits.max_words < 2:
        return words
    n_words, common = words.agg(F.coalesce(F.sum(F.when(F.col("phrase").isNull(), F.col("n"))), F.lit(0)), F.count("phrase")).first()
    buckets = bucket_bits(n_words)
    one = Bitmap.of(word_codes(words.where("phrase is not null"), buckets), common).shared(spark)
    codes = sieved(rows, range(2, 3), least, Sieve(one, 1, None, buckets))
    n_pairs = codes.count()
    pairs = Bitmap.of(codes, n_pairs).shared(spark)
    if limits.max_words > 2:
        longer = sieved(rows, range(3, limits.max_words + 1), least, Sieve(pairs, 2, None, buckets))
        all_codes, count = codes.unionByName(longer), n_pairs + longer.count()
        pairs_and_longer = Bitmap.of(all_codes, count).shared(spark)
    else:
        pairs_and_longer = pairs
    return words.unionByName(pinned(counted(rows, range(2, limits.max_words + 1), least, Sieve(None, 1, pairs_and_longer, buckets))))


def scored(found: DataFrame, limits: Limits) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates, covered ones included."""
    counts = found.where("phrase is not null")
    words = F.split("phrase", " ")
    cuts = (
        counts.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
        .select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        .select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    totals = found.where("phrase is null").select("lang", "n")
    # a row a language, so few that Spark may send them to all tasks once it has seen their size
    parts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")}
    above = (F.lit(1000).cast("decimal(4,0)") * wide["a"]).cast("decimal(22,0)") * F.col("n").cast("decimal(16,0)")
    parts = parts.withColumns({"above": above.cast("decimal(38,0)"), "below": (wide["l"] * wide["r"]).cast("decimal(38,0)")})
    least = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut")
    lowest = parts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), least)
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def uncovered(candidates: DataFrame, counts: DataFrame, limits: Limits) -> DataFrame:
    """Candidates without a longer one around them that has cover percent of their count.

    The words between a candidate and a longer one around it make a chain of one-word extensions, each at least as common
    as the next, so one-word extensions decide.
    """
    longer = counts.where((F.length("phrase") - F.length(F.translate("phrase", " ", ""))) > 1)
    inner = F.array(F.substring_index("phrase", " ", -1), F.substring_index("phrase", " ", 1))
    cut = F.array(
        F.expr("substring(phrase, 1, length(phrase) - length(_last) - 1)"),
        F.expr("substring(phrase, length(_first) + 2)"),
    )
    around = longer.withColumns({"_last": inner[0], "_first": inner[1]}).select("lang", F.explode(cut).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    return candidates.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < limits.cover * F.col("a"), F.lit(True))).drop("around")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """Each language's first rows by score, count and phrase, with their rank; a language's rows are first cut in salted parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("_salt", "_place")


def collocations(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases.

    Null texts and texts without words give nothing, and null languages are `und`. Repeated rows count as often as they
    stand there. Ties in score go to the more common phrase, then to the smaller one in byte order. A phrase may be of any
    length; texts are read in windows, but a single word is held whole. Other columns, whatever their names, are ignored,
    and an empty table gives no rows.
    """
    found = frequent_phrases(docs, limits)
    kept = uncovered(scored(found, limits), found.where("phrase is not null"), limits)
    return ranked(kept, limits.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
