"""Schema matching between sources: bounded column pairs, several named signals, ranks and assembled candidates.

Pairs are made of column descriptions, so their number follows from the schemas, never from the rows.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Our own words that stand for each other in column names; a caller can give others.
ABBREVIATIONS = {"cust": "customer", "client": "customer", "no": "number", "num": "number", "nr": "number", "id": "identifier", "code": "identifier", "qty": "quantity", "units": "quantity", "amt": "amount", "addr": "address", "tel": "phone", "dt": "date", "day": "date"}
TOP, MAX_PAIRS, MAX_CANDIDATES = 3, 100_000, 2000


def family(kind: str) -> str:
    """The family of a declared type; what isn't known matches all."""
    name = kind.lower()
    for parts, out in ((("bool",), "bool"), (("date", "time"), "datetime"), (("int", "dec", "num", "real", "double", "float"), "numeric"), (("char", "text", "string", "clob"), "text")):
        if any(p in name for p in parts):
            return out
    return "unknown"


def name_tokens(name: str) -> list[str]:
    parts = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", unicodedata.normalize("NFKC", name))
    return [ABBREVIATIONS.get(t, t) for t in re.findall(r"[^\W_]+", parts.casefold())]


def name_similarity(a: str, b: str) -> float:
    return SequenceMatcher(None, " ".join(name_tokens(a)), " ".join(name_tokens(b))).ratio()


def token_overlap(a: str, b: str) -> float:
    x, y = set(name_tokens(a)), set(name_tokens(b))
    return len(x & y) / len(x | y) if x | y else 0.0


def column_pairs(left: DataFrame, right: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Pairs of columns (table, column, native_type) of two sources whose types may match, with name signals.

    Column descriptions are metadata; their product is checked against a budget before it is made.
    """
    lefts, rights = left.collect(), right.collect()
    if len(lefts) * len(rights) > max_pairs:
        raise ValueError(f"PAIR_BUDGET_EXCEEDED: {len(lefts) * len(rights)}")
    out = []
    for a in lefts:
        for b in rights:
            fa, fb = family(a.native_type), family(b.native_type)
            if fa == fb or "unknown" in (fa, fb):
                out.append((f"{a.table}.{a.column}", f"{b.table}.{b.column}", name_similarity(a.column, b.column), name_similarity(a.table, b.table), token_overlap(a.column, b.column)))
    return left.sparkSession.createDataFrame(out, "left string, right string, name double, table_name double, tokens double")


def with_profiles(pairs: DataFrame, ratios: DataFrame) -> DataFrame:
    """pairs with `profile`: how close the two columns' distinct ratios are; ratios: (column, distinct_ratio)."""
    l = ratios.select(F.col("column").alias("left"), F.col("distinct_ratio").alias("_l"))
    r = ratios.select(F.col("column").alias("right"), F.col("distinct_ratio").alias("_r"))
    return pairs.join(l, "left", "left").join(r, "right", "left").withColumn("profile", 1 - F.least(F.abs(F.col("_l") - F.col("_r")), F.lit(1.0))).drop("_l", "_r")


def with_dependencies(pairs: DataFrame, inclusions: DataFrame) -> DataFrame:
    """pairs with `dependency`: the best coverage of an inclusion between the two, in either direction."""
    one = inclusions.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"), "coverage").groupBy("a", "b").agg(F.max("coverage").alias("dependency"))
    return pairs.join(one, (F.least("left", "right") == F.col("a")) & (F.greatest("left", "right") == F.col("b")), "left").drop("a", "b")


def ranked(pairs: DataFrame, signals: list[str], top: int = TOP) -> DataFrame:
    """(matcher, left, right, score, rank): each signal's best partners of each left column; ties by name."""
    cells = F.array(*[F.struct(F.lit(s).alias("matcher"), F.col(s).cast("double").alias("score")) for s in signals])
    long = pairs.select("left", "right", F.explode(cells).alias("c")).select("left", "right", "c.*").where("score IS NOT NULL")
    order = Window.partitionBy("matcher", "left").orderBy(F.desc("score"), "left", "right")
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def candidates(ranks: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """(left, right, matchers, best_rank, score): one row for each unordered pair, the most supported first.

    The limit is the report's length; `pruning` tells how many pairs there are in all.
    """
    one = ranks.groupBy(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).agg(F.sort_array(F.collect_set("matcher")).alias("matchers"), F.min("rank").alias("best_rank"), F.avg("score").alias("score"))
    return one.orderBy(F.size("matchers").desc(), F.desc("score"), "left", "right").limit(limit)


def with_distributions(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs with `distribution`: 1 less the total variation distance of the two columns' value shares; values: (column, value, n).

    Shares of equal values are joined, so the work grows with distinct values; what only one column has adds nothing shared.
    """
    totals = values.groupBy("column").agg(F.sum("n").alias("all"))
    shares = values.join(totals, "column").select("column", "value", (F.col("n") / F.col("all")).alias("share"))
    wanted = pairs.select("left", "right").distinct()
    left = wanted.join(shares.withColumnsRenamed({"column": "left", "share": "_l"}), "left")
    both = left.join(shares.withColumnsRenamed({"column": "right", "share": "_r"}), ["right", "value"])
    one = both.groupBy("left", "right").agg(F.sum(F.least("_l", "_r")).alias("distribution"))
    return pairs.join(one, ["left", "right"], "left").withColumn("distribution", F.coalesce("distribution", F.lit(0.0)))


def pruning(left: DataFrame, right: DataFrame, pairs: DataFrame, ranks: DataFrame, assembled: DataFrame) -> DataFrame:
    """(step, pairs): how many column pairs there are, fit by type, are ranked, and are candidates."""
    steps = [left.agg(F.count("*").alias("a")).join(right.agg(F.count("*").alias("b")), F.lit(True)).select(F.lit("all").alias("step"), (F.col("a") * F.col("b")).alias("pairs"))]
    for name, rows in (("types_fit", pairs), ("ranked", ranks.select("left", "right").distinct()), ("candidates", assembled)):
        steps.append(rows.agg(F.count("*").alias("pairs")).select(F.lit(name).alias("step"), "pairs"))
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def evaluated(ranks: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """(matcher, truths, mrr, recall_<k>…): how high each matcher ranks the true partners; truth: (left, right). Pairs that aren't ranked count as missed."""
    matchers = ranks.select("matcher").distinct()
    wanted = truth.select("left", "right").distinct().join(F.broadcast(matchers))
    hit = wanted.join(ranks.select("matcher", "left", "right", "rank"), ["matcher", "left", "right"], "left")
    return hit.groupBy("matcher").agg(F.count("*").alias("truths"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), *[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks])
