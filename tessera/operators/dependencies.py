"""Keys, functional and inclusion dependencies, with their measures, from counts over the whole tables."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import settled

LOW_DISTINCT, LOW_RATIO = 8, 0.05
MAX_ARITY = 3
MAX_APPROXIMATE_ERROR = 0.2


@dataclass(frozen=True)
class Budget:
    """Bounds of a search. What they cut off is told as a reason, never silently."""

    columns: int = 64
    sets: int = 20_000  # column sets, over all levels
    arity: int = MAX_ARITY
    candidates: int = 500


@dataclass(frozen=True)
class Search:
    """What a search found, how many column sets it counted and skipped, and what its budget cut off."""

    found: DataFrame
    counted: int
    implied: int
    truncated: tuple[str, ...]

    @property
    def state(self) -> str:
        return "PARTIAL" if self.truncated else "COMPLETE"


def complete(rows: DataFrame, policy: str = "EXCLUDE", ref: str | None = None) -> DataFrame:
    """rows under a null policy: complete rows only, nulls equal, nulls unlike each other, or nulls as a text."""
    if policy == "EXCLUDE":
        return rows.dropna()
    if policy == "BREAK":
        unlike = F.concat(F.lit("null#"), F.col(ref).cast("string") if ref else F.uuid())
        return rows.select(*[F.coalesce(F.col(c).cast("string"), unlike).alias(c) if c != ref else F.col(c) for c in rows.columns])
    if policy == "LITERAL":
        return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in rows.columns])
    return rows


def key(columns: Iterable[str]) -> Column:
    """One value for a row's columns in which nulls are values as well."""
    return F.struct(*columns)


def distinct_counts(rows: DataFrame, sets: list[tuple[str, ...]], together: int = 64) -> dict[tuple[str, ...], int]:
    """Exact distinct counts of many column sets, so many sets a job: each set's own values are shuffled, without hashes, and no task holds more than one set's."""
    by: dict[tuple[str, ...], int] = {}
    for begin in range(0, len(sets), together):
        some = sets[begin : begin + together]
        parts = [rows.select(*[F.col(f"`{c}`") for c in s]).distinct().agg(F.count("*").alias("n")).select(F.lit(i).alias("s"), "n") for i, s in enumerate(some)]
        by |= {some[r.s]: r.n for r in reduce(DataFrame.unionByName, parts).collect()}
    return by


def unique_combinations(rows: DataFrame, columns: list[str] | None = None, max_arity: int = MAX_ARITY, policy: str = "EXCLUDE") -> DataFrame:
    """(columns, eligible, distinct_count, uniqueness, duplicates) of the minimal unique combinations, level by level."""
    names = columns or rows.columns
    eligible = complete(rows.select(*names), policy).persist()
    total = eligible.count()
    minimal: list[tuple[str, ...]] = []
    out = []
    for arity in range(1, max_arity + 1):
        level = [c for c in combinations(names, arity) if not any(set(m) <= set(c) for m in minimal)]
        for c, n in distinct_counts(eligible, level).items():
            if total and n == total:
                minimal.append(c)
                out.append((",".join(c), total, n, 1.0, 0))
    eligible.unpersist()
    return rows.sparkSession.createDataFrame(out, "columns string, eligible long, distinct_count long, uniqueness double, duplicates long")


def search_unique(rows: DataFrame, columns: list[str] | None = None, budget: Budget = Budget(), policy: str = "EXCLUDE") -> Search:
    """Minimal unique combinations within a budget, smaller sets first.

    A set can only be unique if the product of its columns' distinct counts reaches the row count; others aren't counted.
    """
    names, reasons = list(columns or rows.columns), []
    if len(names) > budget.columns:
        reasons.append(f"MAX_COLUMNS: {len(names)} > {budget.columns}")
        names = names[: budget.columns]
    eligible = complete(rows.select(*names), policy).persist()
    total = eligible.count()
    single: dict[str, int] = {}
    minimal: list[tuple[str, ...]] = []
    out, counted, implied = [], 0, 0
    for arity in range(1, budget.arity + 1):
        level = [c for c in combinations(names, arity) if not any(set(m) <= set(c) for m in minimal)]
        likely = [c for c in level if arity == 1 or math.prod(single[x] for x in c) >= total]
        implied += len(level) - len(likely)
        if counted + len(likely) > budget.sets:
            reasons.append(f"MAX_SETS: {counted + len(likely)} > {budget.sets} at {arity} columns")
            likely = likely[: budget.sets - counted]
        counts = distinct_counts(eligible, likely)
        counted += len(likely)
        single |= {c[0]: n for c, n in counts.items() if arity == 1}
        for c, n in counts.items():
            if total and n == total:
                minimal.append(c)
                out.append((",".join(c), total, n))
    eligible.unpersist()
    if len(out) > budget.candidates:
        reasons.append(f"MAX_CANDIDATES: {len(out)} > {budget.candidates}")
    found = rows.sparkSession.createDataFrame(out[: budget.candidates], "columns string, eligible long, distinct_count long")
    return Search(found, counted, implied, tuple(reasons))


def identity_candidates(rows: DataFrame, source: str, table: str, search: Search) -> DataFrame:
    """(identity, source, table, columns, eligible, nulls, scope, state) of a source's own keys, for review; the fewest columns first.

    A key with rows in which a column of it is null isn't an identity of all rows, and says so.
    """
    keys = search.found.collect()  # as many as the budget's candidates
    spark = rows.sparkSession
    if not keys:
        return spark.createDataFrame([], "identity string, source string, table string, columns string, eligible long, nulls long, scope string, state string")
    lacking = [F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in k.columns.split(",")])).alias(f"n{i}") for i, k in enumerate(keys)]
    nulls = rows.agg(*lacking).first()
    out = [(f"identity:{source}.{table}({k.columns})", source, table, k.columns, k.eligible, nulls[i], "SOURCE_LOCAL", "REVIEW_REQUIRED" if nulls[i] == 0 else "INCOMPLETE_NULL_KEYS") for i, k in enumerate(keys)]
    return spark.createDataFrame(sorted(out, key=lambda r: (r[3].count(","), r[3])), "identity string, source string, table string, columns string, eligible long, nulls long, scope string, state string")


def dependency_error(rows: DataFrame, left: list[str], right: str) -> DataFrame:
    """(eligible, violating_groups, error, support): what the left values leave open of the right one, per eligible row."""
    kinds = rows.groupBy(*left).agg(F.countDistinct(F.struct(right)).alias("d"), F.count("*").alias("n"))
    error = F.coalesce(F.try_divide(F.sum(F.greatest(F.col("d") - 1, F.lit(0))), F.sum("n")), F.lit(0.0))
    return kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("eligible"), F.count_if(F.col("d") > 1).alias("violating_groups"), error.alias("error")).withColumn("support", 1 - F.col("error"))


def violating_rows(rows: DataFrame, left: list[str], right: str, ref: str) -> DataFrame:
    """References of the rows whose left values stand with several right values."""
    bad = rows.groupBy(*left).agg(F.countDistinct(F.struct(right)).alias("_d")).where("_d > 1").drop("_d")
    return rows.join(bad, left, "left_semi").select(ref)


def functional_dependencies(rows: DataFrame, columns: list[str] | None = None, max_arity: int = 2, max_error: float = 0.0, policy: str = "EXCLUDE") -> DataFrame:
    """(lhs, rhs, error, exact) of the minimal dependencies with an error of max_error at most.

    With an error of 0 a level is one job: X determines A if X and X with A have as many distinct values.
    """
    names = columns or rows.columns
    eligible = complete(rows.select(*names), policy).persist()
    found: dict[str, list[tuple[str, ...]]] = {n: [] for n in names}
    out = []
    for arity in range(1, max_arity + 1):
        pairs = [(x, a) for x in combinations(names, arity) for a in names if a not in x and not any(set(m) <= set(x) for m in found[a])]
        counts = distinct_counts(eligible, sorted({s for x, a in pairs for s in (x, (*x, a))}))
        total = None
        for x, a in pairs:
            if counts[x] == counts[(*x, a)]:
                found[a].append(x)
                out.append((",".join(x), a, 0.0, True))
            elif max_error > 0:
                total = eligible.count() if total is None else total
                # distinct right values beyond one for each left value
                error = (counts[(*x, a)] - counts[x]) / total if total else 0.0
                if error <= max_error:
                    out.append((",".join(x), a, error, False))
    eligible.unpersist()
    return rows.sparkSession.createDataFrame(out, "lhs string, rhs string, error double, exact boolean")


def compatible(left: str, right: str) -> bool:
    """Whether columns of these families may stand for each other."""
    return left == right or {left, right} in ({"integer", "numeric"}, {"string", "unknown"})


def inclusion_measures(left: DataFrame, left_columns: list[str], right: DataFrame, right_columns: list[str]) -> DataFrame:
    """(left_rows, left_distinct, matched, coverage, orphans, orphan_ratio, right_rows, right_distinct, target_uniqueness, low_cardinality).

    Null keys are out on both sides. Left keys are counted before the join, so the join sees each key once.
    """
    keys = [f"k{i}" for i in range(len(left_columns))]
    lefts = left.select(*[F.col(c).alias(k) for c, k in zip(left_columns, keys, strict=True)]).dropna().groupBy(*keys).agg(F.count("*").alias("ln"))
    rights = right.select(*[F.col(c).alias(k) for c, k in zip(right_columns, keys, strict=True)]).dropna().groupBy(*keys).agg(F.count("*").alias("rn"))
    one = lefts.join(rights, keys, "full").agg(
        F.coalesce(F.sum("ln"), F.lit(0)).alias("left_rows"),
        F.count("ln").alias("left_distinct"),
        F.count_if(F.col("ln").isNotNull() & F.col("rn").isNotNull()).alias("matched"),
        F.coalesce(F.sum(F.when(F.col("rn").isNull(), F.col("ln"))), F.lit(0)).alias("orphans"),
        F.coalesce(F.sum("rn"), F.lit(0)).alias("right_rows"),
        F.count("rn").alias("right_distinct"),
    )
    one = one.withColumn("coverage", F.coalesce(F.try_divide("matched", "left_distinct"), F.lit(1.0))).withColumn("orphan_ratio", F.coalesce(F.try_divide("orphans", "left_rows"), F.lit(0.0)))
    one = one.withColumn("target_uniqueness", F.coalesce(F.try_divide("right_distinct", "right_rows"), F.lit(0.0)))
    return one.withColumn("low_cardinality", (F.col("right_distinct") <= LOW_DISTINCT) | (F.col("target_uniqueness") <= LOW_RATIO))


def marked(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """(marks, n): how many distinct keys stand in the same parts. marks has a bit for each part, 63 to a number; keys with a null stand in none.

    Bits are or-ed before and after one shuffle, so a key is shuffled once a task and part, as what it is.
    """
    words = range((len(parts) + 62) // 63)
    bits = [p.dropna(subset=keys).select(*keys, *[F.lit(1 << i % 63 if i // 63 == w else 0).cast("bigint").alias(f"w{w}") for w in words]) for i, p in enumerate(parts)]
    sets = reduce(DataFrame.union, bits).groupBy(*keys).agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in words])
    return sets.groupBy(F.array(*[f"w{w}" for w in words]).alias("marks")).agg(F.count("*").alias("n"))


def shared_counts(marks: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(a, b, n): how many keys stand in both parts of each pair; pairs that share none are left out."""

    def has(i: str) -> Column:
        return F.get("marks", F.floor(F.col(i) / 63).cast("int")).bitwiseAND(F.expr(f"shiftleft(1L, {i} % 63)")) != 0

    asked = marks.sparkSession.createDataFrame(pairs, "a int, b int")  # metadata: within a search's bounds
    return marks.join(F.broadcast(asked), has("a") & has("b")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def inclusion_candidates(tables: dict[str, DataFrame], min_coverage: float = 1.0) -> DataFrame:
    """(left, right, left_distinct, right_distinct, coverage) of single-column inclusions between all tables.

    Columns of one type are laid end to end once; each value keeps one bit for each column that has it, and pairs of columns
    are counted from those bits.
    """
    families: dict[str, list[tuple[str, DataFrame]]] = {}
    for table, rows in sorted(tables.items()):
        for name, kind in rows.dtypes:
            if kind.startswith(("array", "map", "struct", "binary")):
                continue
            tag = "integer" if kind in ("tinyint", "smallint", "int", "bigint") else kind
            # doubles stay as they are: shorter than their texts, and 0.0 equals -0.0
            value = F.col(f"`{name}`").cast("bigint" if tag == "integer" else tag if tag in ("double", "float") else "string")
            families.setdefault(tag, []).append((f"{table}.{name}", rows.select(value.alias("value"))))
    counts = None
    for columns in families.values():
        names = [c for c, _ in columns]
        marks = marked([rows for _, rows in columns], ["value"])
        one = shared_counts(marks, [(i, j) for i in range(len(names)) for j in range(len(names))])
        label = F.array(*map(F.lit, names))
        one = one.select(F.get(label, F.col("a")).alias("left"), F.get(label, F.col("b")).alias("right"), F.col("n").alias("both"))
        counts = one if counts is None else counts.unionByName(one)
    # as many rows as pairs of columns
    counts = settled(counts)
    own = counts.where("left = right")
    sizes = own.select(F.col("left").alias("c"), F.col("both").alias("n"))
    found = counts.where("left != right").join(sizes.select(F.col("c").alias("left"), F.col("n").alias("left_distinct")), "left").join(sizes.select(F.col("c").alias("right"), F.col("n").alias("right_distinct")), "right")
    return found.withColumn("coverage", F.col("both") / F.col("left_distinct")).where(F.col("coverage") >= min_coverage).select("left", "right", "left_distinct", "right_distinct", "coverage")


def relationship(measured: DataFrame, types_fit: bool = True) -> DataFrame:
    """The measures with `relationship_candidate`: a unique target that isn't of low cardinality, of a fitting type."""
    return measured.withColumn("relationship_candidate", ~F.col("low_cardinality") & F.lit(types_fit) & (F.col("target_uniqueness") >= 1))
