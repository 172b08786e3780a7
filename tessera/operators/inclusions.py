"""Inclusions of sequences of one to several columns between tables, level by level.

A sequence of column pairs is a candidate where all its parts were found on the level before. The candidates of a level are
measured by one job for each list of families: the sequences' values are laid end to end, each keeps a bit for every
sequence that has it, and shared values are counted for the candidate pairs alone.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.dependencies import marked, shared_counts

INTEGERS = ("tinyint", "smallint", "int", "bigint")
Pairs = tuple[tuple[str, str], ...]  # (left column, right column), in the order of the left table's columns
SCHEMA = "left string, right string, arity int, left_distinct long, right_distinct long, matched long, coverage double"


@dataclass(frozen=True)
class Budget:
    """Bounds of a search, told as reasons where they cut: tables, columns of a table, candidates of a level, seconds before another level is begun."""

    tables: int = 32
    columns: int = 64
    candidates: int = 20_000
    seconds: float | None = None


@dataclass(frozen=True)
class Search:
    """found: inclusions of all levels; candidates: how many each level had; truncated: what the budget cut off."""

    found: DataFrame
    candidates: tuple[int, ...]
    truncated: tuple[str, ...]

    @property
    def state(self) -> str:
        return "PARTIAL" if self.truncated else "COMPLETE"


def families(rows: DataFrame) -> dict[str, str]:
    """The comparable columns with the family of their values; values of different families are never equal."""
    return {c: "integer" if t in INTEGERS else t for c, t in rows.dtypes if not t.startswith(("array", "map", "struct", "binary", "variant"))}


def typed(kind: str) -> str:
    """The type in which values of a family are compared."""
    return "bigint" if kind == "integer" else "string"


def measured(spark: SparkSession, tables: dict[str, DataFrame], kinds: dict[str, dict[str, str]], candidates: list[tuple[str, str, Pairs]]) -> list[tuple[int, int, int]]:
    """(left distinct, right distinct, shared) for each candidate (left table, right table, pairs).

    Sequences of the same families are laid end to end, each with a bit of its own, and their values' bits are or-ed.
    """
    numbers: dict[tuple[str, ...], dict[tuple[str, tuple[str, ...]], int]] = {}
    both = []
    for t, u, p in candidates:
        family = tuple(kinds[t][a] for a, _ in p)
        own = numbers.setdefault(family, {})
        both.append((family, *(own.setdefault(s, len(own)) for s in ((t, tuple(a for a, _ in p)), (u, tuple(b for _, b in p))))))
    counts: dict[tuple[tuple[str, ...], int, int], int] = {}
    for family, sequences in numbers.items():
        keys = [f"v{i}" for i in range(len(family))]
        parts = [tables[t].select(*[F.col(f"`{c}`").cast(typed(kind)).alias(k) for c, kind, k in zip(columns, family, keys, strict=True)]) for t, columns in sequences]
        wanted = {(a, b) for f, a, b in both if f == family} | {(i, i) for i in sequences.values()}
        counts |= {(family, r.a, r.b): r.n for r in shared_counts(marked(parts, keys), sorted(wanted)).collect()}
    return [(counts.get((f, a, a), 0), counts.get((f, b, b), 0), counts.get((f, a, b), 0)) for f, a, b in both]


def next_level(found: set[tuple[str, str, Pairs]], order: dict[str, list[str]]) -> list[tuple[str, str, Pairs]]:
    """Sequences of one pair more, all of whose parts were found."""
    by: dict[tuple, list[tuple[str, str]]] = {}
    for t, u, p in found:
        by.setdefault((t, u, p[:-1]), []).append(p[-1])
    out = []
    for (t, u, head), tails in sorted(by.items()):
        for x, y in combinations(sorted(tails, key=lambda p: (order[t].index(p[0]), p[1])), 2):
            pairs = (*head, x, y)
            if x[0] == y[0] or len({b for _, b in pairs}) < len(pairs):
                continue
            if all((t, u, pairs[:i] + pairs[i + 1 :]) in found for i in range(len(pairs))):
                out.append((t, u, pairs))
    return out


def search_inclusions(tables: dict[str, DataFrame], max_arity: int = 3, min_coverage: float = 1.0, budget: Budget = Budget()) -> Search:
    """Inclusions between different tables whose coverage, the share of distinct left values that the right side has, is min_coverage or more.

    Below full coverage a longer sequence may cover more than its parts do; it is looked for only where its parts are
    found, as on full coverage, where that loses nothing. A side without values covers nothing and isn't listed.
    """
    began, reasons = time.monotonic(), []
    spark = next(iter(tables.values())).sparkSession
    if len(tables) > budget.tables:
        reasons.append(f"MAX_TABLES: {len(tables)} > {budget.tables}")
        tables = dict(list(tables.items())[: budget.tables])
    kinds = {t: families(rows) for t, rows in tables.items()}
    for t, columns in kinds.items():
        if len(columns) > budget.columns:
            reasons.append(f"MAX_COLUMNS: {t} has {len(columns)} > {budget.columns}")
            kinds[t] = dict(list(columns.items())[: budget.columns])
    order = {t: list(columns) for t, columns in kinds.items()}
    level = [(t, u, ((a, b),)) for t in tables for u in tables if t != u for a in order[t] for b in order[u] if kinds[t][a] == kinds[u][b]]
    out, sizes = [], []
    for arity in range(1, max_arity + 1):
        if not level:
            break
        if budget.seconds is not None and arity > 1 and time.monotonic() - began > budget.seconds:
            reasons.append(f"MAX_SECONDS: over {budget.seconds} before {arity} columns")
            break
        if len(level) > budget.candidates:
            reasons.append(f"MAX_CANDIDATES: {len(level)} > {budget.candidates} at {arity} columns")
            level = level[: budget.candidates]
        sizes.append(len(level))
        found = set()
        for (t, u, pairs), (left, right, shared) in zip(level, measured(spark, tables, kinds, level), strict=True):
            if left and shared >= min_coverage * left:
                found.add((t, u, pairs))
                out.append((f"{t}({','.join(a for a, _ in pairs)})", f"{u}({','.join(b for _, b in pairs)})", arity, left, right, shared, shared / left))
        level = next_level(found, order)
    return Search(spark.createDataFrame(out, SCHEMA), tuple(sizes), tuple(reasons))
