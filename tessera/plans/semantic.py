"""Governed metric queries: a request names metrics, attributes and filters; the plan is one lazy DataFrame."""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"SUM": F.sum, "MAX": F.max, "MIN": F.min, "COUNT": F.count}
MAX_LIMIT, MAX_IN = 10_000, 100
ADDITIVE, SEMI_ADDITIVE, NON_ADDITIVE = "ADDITIVE", "SEMI_ADDITIVE", "NON_ADDITIVE"
Value = str | int | float | bool | decimal.Decimal | datetime.date | datetime.datetime | None


class SemanticError(Exception):
    """A request that the model doesn't allow; the code says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Attribute:
    id: str
    column: str
    type: str = "STRING"
    nullable: bool = True
    exposed: bool = True


@dataclass(frozen=True)
class DimensionModel:
    id: str
    table: str
    key: str
    attributes: tuple[Attribute, ...]
    hierarchy: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relationship:
    """A fact column that refers to a dimension's key; several to one dimension are told apart by their time role."""

    dimension: str
    fact_column: str
    cardinality: str = "MANY_TO_ONE"
    time_role: str | None = None


@dataclass(frozen=True)
class Metric:
    id: str
    column: str | None
    additivity: str = ADDITIVE
    operations: tuple[str, ...] = ("SUM",)
    kind: str = "BASE"
    dimensions: tuple[str, ...] | None = None  # None: all of the fact's


@dataclass(frozen=True)
class FactModel:
    id: str
    table: str
    metrics: tuple[Metric, ...]
    relationships: tuple[Relationship, ...]


@dataclass(frozen=True)
class Model:
    dimensions: tuple[DimensionModel, ...]
    facts: tuple[FactModel, ...]


@dataclass(frozen=True)
class Filter:
    attribute: str
    operator: str  # EQUALS, IN, DATE_RANGE
    values: tuple[Value, ...]


@dataclass(frozen=True)
class Request:
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()  # (id, descending)
    limit: int = 1000
    time_role: str | None = None
    operations: dict[str, str] = field(default_factory=dict)


def operations_of(additivity: str, rule: str) -> tuple[str, ...]:
    """What a reviewed additivity rule allows: sums only if it says so, for semi-additive measures its first operation."""
    upper = rule.upper()
    if additivity == ADDITIVE:
        return ("SUM",) if "SUM(" in upper else ()
    if additivity == SEMI_ADDITIVE:
        found = sorted((upper.find(f"{op}("), op) for op in ("MAX", "MIN", "LAST", "FIRST") if f"{op}(" in upper)
        return (found[0][1],) if found else ()
    return ()


def fits(value: Value, kind: str) -> bool:
    kinds = {
        "STRING": (str,),
        "INTEGER": (int,),
        "BIGINT": (int,),
        "DECIMAL": (int, decimal.Decimal),
        "FLOAT": (int, float, decimal.Decimal),
        "BOOLEAN": (bool,),
        "DATE": (datetime.date,),
        "DATETIME": (datetime.datetime,),
    }
    if isinstance(value, bool):
        return kind == "BOOLEAN"
    return isinstance(value, kinds.get(kind, ()))


@dataclass(frozen=True)
class Plan:
    """What a request comes to; hashable by its canonical form, and run on the tables of a star."""

    fact: FactModel
    joins: tuple[tuple[DimensionModel, Relationship], ...]
    groups: tuple[tuple[str, Attribute], ...]  # dimension, attribute
    metrics: tuple[tuple[Metric, str], ...]
    filters: tuple[tuple[Filter, str, Attribute], ...]
    sort: tuple[tuple[str, bool], ...]
    limit: int

    def canonical(self) -> str:
        """The plan without its filters' values."""
        return repr((self.fact.id, [(d.id, r.fact_column) for d, r in self.joins], [a.id for _, a in self.groups], [(m.id, op) for m, op in self.metrics], [(f.operator, a.id, len(f.values)) for f, _, a in self.filters], self.sort, self.limit))

    def run(self, tables: dict[str, DataFrame]) -> DataFrame:
        """Left joins to the selected dimensions alone, filters, one aggregation, nulls last, and the limit."""
        out = tables[self.fact.table]
        wanted = {r.fact_column for _, r in self.joins} | {m.column for m, _ in self.metrics if m.column}
        out = out.select(*sorted(wanted)) if wanted else out
        for d, r in self.joins:
            used = [a.column for dim, a in [*self.groups, *((dim, a) for _, dim, a in self.filters)] if dim == d.id]
            side = tables[d.table].select(F.col(d.key).alias(f"_{d.id}_key"), *[F.col(c).alias(f"{d.id}.{c}") for c in dict.fromkeys(used)])
            out = out.join(side, F.col(r.fact_column) == F.col(f"_{d.id}_key"), "left")
        for f, dim, a in self.filters:
            column = F.col(f"`{dim}.{a.column}`")
            if f.operator == "EQUALS":
                out = out.where(column.isNull() if f.values[0] is None else column == F.lit(f.values[0]))
            elif f.operator == "IN":
                out = out.where(column.isin(*f.values))
            else:
                out = out.where(column.between(*f.values))
        groups = [F.col(f"`{dim}.{a.column}`").alias(a.id) for dim, a in self.groups]
        sums = [AGGREGATES[op](m.column if m.column else F.lit(1)).alias(m.id) for m, op in self.metrics]
        out = out.groupBy(*groups).agg(*sums) if groups else out.agg(*sums)
        if self.sort:
            out = out.orderBy(*[F.col(f"`{i}`").desc_nulls_last() if down else F.col(f"`{i}`").asc_nulls_last() for i, down in self.sort])
        return out.limit(self.limit)


def plan(model: Model, request: Request) -> Plan:
    """Resolve and check a request; each refusal has a code of its own."""
    if not request.metrics:
        raise SemanticError("EMPTY_SEMANTIC_SELECT")
    if not 1 <= request.limit <= MAX_LIMIT:
        raise SemanticError("INVALID_LIMIT", str(request.limit))
    by_metric = {m.id: (f, m) for f in model.facts for m in f.metrics}
    for m in request.metrics:
        if m not in by_metric:
            raise SemanticError("UNKNOWN_METRIC", m)
        if by_metric[m][1].kind == "DERIVED":
            raise SemanticError("DERIVED_METRIC_NOT_EXECUTABLE_V1", m)
    facts = {by_metric[m][0].id for m in request.metrics}
    if len(facts) != 1:
        raise SemanticError("INCOMPATIBLE_GRAIN", ",".join(sorted(facts)))
    fact = by_metric[request.metrics[0]][0]
    metrics = [by_metric[m][1] for m in request.metrics]
    dimensions = {d.id: d for d in model.dimensions}
    attributes = {a.id: (d.id, a) for d in model.dimensions for a in d.attributes}
    chosen = list(request.dimensions)

    def resolve(name: str, code: str) -> tuple[str, Attribute]:
        if name not in attributes:
            raise SemanticError(code, name)
        dim, a = attributes[name]
        if not a.exposed:
            raise SemanticError("IMPLEMENTATION_ONLY_ATTRIBUTE", name)
        if dim not in chosen:
            chosen.append(dim)
        return dim, a

    groups = [resolve(g, "UNKNOWN_ATTRIBUTE") for g in request.group_by]
    filters = []
    for f in request.filters:
        dim, a = resolve(f.attribute, "UNKNOWN_FILTER_ATTRIBUTE")
        sizes = {"EQUALS": (1, 1), "IN": (1, MAX_IN), "DATE_RANGE": (2, 2)}
        if f.operator not in sizes or not sizes[f.operator][0] <= len(f.values) <= sizes[f.operator][1]:
            raise SemanticError("INVALID_FILTER", f.attribute)
        if any(v is not None and not fits(v, a.type) for v in f.values) or f.operator == "DATE_RANGE" and None in f.values:
            raise SemanticError("FILTER_TYPE_MISMATCH", f.attribute)
        if f.operator == "EQUALS" and f.values[0] is None and not a.nullable:
            raise SemanticError("NULL_FILTER_ON_NON_NULLABLE_ATTRIBUTE", f.attribute)
        filters.append((f, dim, a))
    if any(d not in dimensions for d in chosen):
        raise SemanticError("UNKNOWN_DIMENSION")
    if any(m.dimensions is not None and d not in m.dimensions for m in metrics for d in chosen):
        raise SemanticError("INCOMPATIBLE_DIMENSION")
    roles = {r.time_role: r for r in fact.relationships if r.time_role}
    if request.time_role and request.time_role not in roles:
        raise SemanticError("INCOMPATIBLE_TIME_ROLE", request.time_role)
    joins = []
    for d in chosen:
        found = [r for r in fact.relationships if r.dimension == d]
        if request.time_role and roles[request.time_role].dimension == d:
            found = [roles[request.time_role]]
        if not found:
            raise SemanticError("INCOMPATIBLE_DIMENSION", d)
        if len(found) > 1:
            raise SemanticError("AMBIGUOUS_RELATIONSHIP", d)
        if found[0].cardinality != "MANY_TO_ONE":
            raise SemanticError("UNSAFE_FANOUT", d)
        joins.append((dimensions[d], found[0]))
    if any(m.additivity == SEMI_ADDITIVE for m in metrics):
        day = roles[request.time_role].dimension if request.time_role else None
        if day is None or not any(dim == day for dim, _ in [*groups, *((dim, a) for _, dim, a in filters)]):
            raise SemanticError("SEMI_ADDITIVE_TIME_SCOPE_REQUIRED")
    if chosen and not groups:
        for d in chosen:
            first = next((a for a in dimensions[d].attributes if a.exposed), None)
            if first is None:
                raise SemanticError("NO_EXPOSED_ATTRIBUTE", d)
            groups.append((d, first))
    if len({a.id for _, a in groups}) != len(groups):
        raise SemanticError("DUPLICATE_GROUP_ATTRIBUTE")
    resolved = []
    for m in metrics:
        op = request.operations.get(m.id, m.operations[0] if m.operations else "")
        if op not in m.operations or op not in AGGREGATES:
            raise SemanticError("UNSUPPORTED_AGGREGATION", f"{m.id} {op}")
        resolved.append((m, op))
    names = {a.id for _, a in groups} | set(request.metrics)
    for name, _ in request.sort:
        if name not in names:
            raise SemanticError("UNKNOWN_SORT_FIELD", name)
    return Plan(fact, tuple(joins), tuple(groups), tuple(resolved), tuple(filters), request.sort, request.limit)


def query(model: Model, tables: dict[str, DataFrame], request: Request) -> DataFrame:
    return plan(model, request).run(tables)


# The names of attribute types, by the start of a Spark type's name.
TYPES = (("bigint", "BIGINT"), ("int", "INTEGER"), ("smallint", "INTEGER"), ("tinyint", "INTEGER"), ("decimal", "DECIMAL"), ("double", "FLOAT"), ("float", "FLOAT"), ("boolean", "BOOLEAN"), ("date", "DATE"), ("timestamp", "DATETIME"))


def build_model(dimensions: dict[str, DataFrame], fact: str, table: str, keys: dict[str, str], dates: dict[str, str], measures: dict[str, tuple[str | None, str, str]], hierarchies: dict[str, tuple[str, ...]] | None = None) -> Model:
    """A model from a star's parts: dimension tables, whose first column is the key; the fact's keys by column, its date keys by role.

    measures: column, additivity and reviewed rule of each, which says what may be asked of it; a measure without an
    operation isn't queryable and left out. Canonical references are no attributes to be shown.
    """
    out = []
    for name, rows in dimensions.items():
        key = rows.columns[0]
        attributes = tuple(Attribute(f"{name}.{c}", c, next((t for start, t in TYPES if kind.startswith(start)), "STRING"), exposed=c != "canonical_ref") for c, kind in rows.dtypes if c != key)
        levels = tuple(f"{name}.{c}" for c in (hierarchies or {}).get(name, ()))
        unknown = sorted(set(levels) - {a.id for a in attributes})
        if unknown:
            raise SemanticError("UNKNOWN_HIERARCHY_LEVEL", ",".join(unknown))
        out.append(DimensionModel(name, f"dim_{name}", key, attributes, levels))
    lacking = sorted(set(keys.values()) - set(dimensions))
    if lacking or dates and "date" not in dimensions:
        raise SemanticError("UNKNOWN_DIMENSION", ",".join(lacking) or "date")
    relationships = tuple(Relationship(d, c) for c, d in keys.items()) + tuple(Relationship("date", c, time_role=role) for role, c in dates.items())
    metrics = []
    for name, (column, additivity, rule) in measures.items():
        operations = ("COUNT",) if column is None else operations_of(additivity, rule)
        if operations:
            metrics.append(Metric(name, column, additivity, operations))
    return Model(tuple(out), (FactModel(fact, table, tuple(metrics), relationships),))
