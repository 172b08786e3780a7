"""Quality rules with DataFrame functions alone: repetition counts, and divergence from language references.

Each document gives a histogram of character classes and one of its language's commonest words. The references are the
mean histograms of the language's documents over the whole corpus. A document diverges if its Jensen-Shannon distance
from a reference is above a bound; texts too short for a histogram to mean anything are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pinned, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8

# The commonest function words of four languages.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to a in that is was he for it with as his on be at by are".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas sur".split(),
}
#: Classes of characters in the order in which they are counted; the last is all that is left.
CLASSES = (("lower", r"\p{Ll}+"), ("space", SPACE), ("upper", r"\p{Lu}+"), ("punctuation", r"\p{P}+"), ("digit", r"\p{Nd}+"), ("symbol", r"\p{S}+"))


@dataclass(frozen=True)
class Bounds:
    """Largest distances from the references, and the text lengths from which they count."""

    classes: float = 0.21
    words: float = 0.32
    min_chars: int = 200
    min_words: int = 60
    base_words: int = 20
    base_repeats: int = 30  # percent


def bound_once(value: Column, use) -> Column:
    """use(value), with value computed once: lambda variables are Spark's only local names."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words stand in windows of the given size that occur twice or more in the text."""
    hashes = F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>"))

    def covered(sorted_windows: Column) -> Column:
        def same(i: Column) -> Column:
            return F.coalesce(F.get(sorted_windows, i)["h"], F.lit(None))

        twins = F.filter(sorted_windows, lambda w, i: F.coalesce(w["h"] == same(i - 1), F.lit(False)) | F.coalesce(w["h"] == same(i + 1), F.lit(False)))
        places = F.sort_array(F.transform(twins, lambda w: w["i"]))
        start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(size), p - acc["last"])).alias("total")), lambda acc: acc["total"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bound_once(pairs, covered))

    return bound_once(hashes, count).cast("long")


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One row for each document with its counts and histograms."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    for k, (_, pattern) in enumerate(CLASSES):
        rows = rows.withColumn(f"_left{k}", F.regexp_replace("text" if k == 0 else f"_left{k - 1}", pattern, ""))
    lengths = [F.length("text"), *(F.length(f"_left{k}") for k in range(len(CLASSES)))]
    # all symbols are still there once small letters and white space are gone
    symbols = F.length("_left1") - F.length(F.regexp_replace("_left1", SYMBOLS, ""))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    spaced = F.concat(F.lit(" "), F.lower(F.array_join("words", "  ")), F.lit(" "))
    rows = rows.withColumn("spaced", spaced)

    def times(word: str) -> Column:
        # octet lengths are at hand, code points have to be counted
        return (F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit(f" {word} "), F.lit("")))) / F.lit(len(word.encode()) + 2)

    common = reduce(lambda other, lang: F.when(F.col("lang") == lang, F.array(*[times(w).cast("long") for w in COMMON_WORDS[lang]])).otherwise(other), COMMON_WORDS, F.lit(None).cast("array<bigint>"))
    return rows.select(
        "doc_id",
        F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang")).otherwise("other").alias("lang"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        bound_once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        lengths[0].cast("long").alias("n_chars"),
        F.array(*[(a - b).cast("double") for a, b in zip(lengths[:-1], lengths[1:], strict=True)], lengths[-1].cast("double")).alias("class_counts"),
        common.alias("common_counts"),
    )


def shares(counts: Column, rest: Column | None = None) -> Column:
    """Counts, and what is left of a total, as shares of the whole."""
    if rest is not None:
        counts = F.concat(counts.cast("array<double>"), F.array((rest - F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)).cast("double")))
    return bound_once(counts, lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda a, y: a + y)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares: 0 for equal ones, 1 for those without a common class."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    both = F.aggregate(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(both / 2, F.lit(0.0)))


def quality(docs: DataFrame, bounds: Bounds = Bounds(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, distances and verdicts, one row for each row of docs.

    A null text counts as empty: it has no words and fails the base rule. A null or unknown language shares the
    reference of all others and has no word histogram. Repeated rows and ids are judged alike and all count for the
    references; an empty table gives no rows. Other columns are ignored.
    """
    rows = features(docs, id_col, text_col, lang_col)
    long_enough = (F.col("n_chars") >= bounds.min_chars) & (F.col("n_words") > 0)
    rows = rows.withColumn("class_shares", F.when(long_enough, shares(F.col("class_counts"))))
    rows = rows.withColumn("word_shares", F.when((F.col("n_words") >= bounds.min_words) & F.col("common_counts").isNotNull(), shares(F.col("common_counts"), F.col("n_words"))))
    rows = pinned(rows.drop("class_counts", "common_counts"))
    means = [F.avg(F.col("class_shares")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    width = len(next(iter(COMMON_WORDS.values()))) + 1
    means += [F.avg(F.col("word_shares")[i]).alias(f"w{i}") for i in range(width)]
    found = rows.groupBy("lang").agg(*means)
    # a row for each language of COMMON_WORDS and one for all others
    reference = found.select(
        F.col("lang").alias("_lang"),
        F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)]).alias("class_reference"),
        F.array(*[f"w{i}" for i in range(width)]).alias("word_reference"),
    )
    joined = rows.join(F.broadcast(reference), F.col("lang") == F.col("_lang"))
    joined = joined.withColumn("class_distance", F.when(F.col("class_shares").isNotNull(), js_distance(F.col("class_shares"), F.col("class_reference"))))
    joined = joined.withColumn("word_distance", F.when(F.col("word_shares").isNotNull(), js_distance(F.col("word_shares"), F.col("word_reference"))))
    failed = (F.col("n_words") < bounds.base_words) | (100 * F.col("n_repeat_words") > bounds.base_repeats * F.col("n_words"))
    diverges = F.coalesce(F.col("class_distance") > bounds.classes, F.lit(False)) | F.coalesce(F.col("word_distance") > bounds.words, F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~diverges).alias("kept"), "class_distance", "word_distance"
    )
