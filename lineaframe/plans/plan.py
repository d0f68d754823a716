"""Steps, plans, the fluent builder, and validation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from lineaframe.plans.expr import Expr, TypeProblem, Typed
from lineaframe.plans.types import Field, Kind, Schema


@dataclass(frozen=True)
class Agg:
    """One aggregate: ``fn`` of ``column`` (none for count), named ``name``; ``p`` for percentile only."""

    name: str
    fn: str
    column: str | None = None
    p: int | None = None


@dataclass(frozen=True)
class Key:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class Scan:
    """All rows of one snapshot; ``snapshot`` is its 64-digit hex name."""

    snapshot: str


@dataclass(frozen=True)
class Filter:
    input: int
    predicate: Expr


@dataclass(frozen=True)
class Map:
    input: int
    name: str
    expr: Expr


@dataclass(frozen=True)
class Project:
    input: int
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Aggregate:
    input: int
    group_by: tuple[str, ...]
    aggregates: tuple[Agg, ...]


@dataclass(frozen=True)
class Sort:
    input: int
    keys: tuple[Key, ...]


@dataclass(frozen=True)
class Limit:
    input: int
    count: int


Step = Scan | Filter | Map | Project | Aggregate | Sort | Limit
#: Names of the steps in JSON.
OP_NAMES: dict[type, str] = {Scan: "scan", Filter: "filter", Map: "map", Project: "project", Aggregate: "aggregate", Sort: "sort", Limit: "limit"}


@dataclass(frozen=True)
class Plan:
    """Steps, each after the one it reads, and the number of the step that is the result."""

    steps: tuple[Step, ...]
    output: int

    @staticmethod
    def scan(snapshot: str) -> Plan:
        return Plan((Scan(snapshot),), 0)

    def _then(self, step: Step) -> Plan:
        return Plan((*self.steps, step), len(self.steps))

    def filter(self, predicate: Expr) -> Plan:
        return self._then(Filter(self.output, predicate))

    def map(self, name: str, expr: Expr) -> Plan:
        return self._then(Map(self.output, name, expr))

    def project(self, *columns: str) -> Plan:
        return self._then(Project(self.output, columns))

    def aggregate(self, group_by: Iterable[str] = (), *aggregates: Agg) -> Plan:
        return self._then(Aggregate(self.output, tuple(group_by), aggregates))

    def sort(self, *keys: Key | str) -> Plan:
        """Column names sort ascending; one that starts with ``-`` sorts descending."""
        made = [k if isinstance(k, Key) else Key(k.removeprefix("-"), k.startswith("-")) for k in keys]
        return self._then(Sort(self.output, tuple(made)))

    def limit(self, count: int) -> Plan:
        return self._then(Limit(self.output, count))


class PlanProblem(Exception):
    """Why a plan is not valid, and at which step (None: the plan as a whole)."""

    def __init__(self, message: str, step: int | None = None) -> None:
        super().__init__(message if step is None else f"step {step}: {message}")
        self.message, self.step = message, step


@dataclass(frozen=True)
class SourceInfo:
    """What a plan needs to know of a snapshot: a short title and its schema."""

    title: str
    schema: Schema


Catalog = Mapping[str, SourceInfo]


@dataclass(frozen=True)
class ValidPlan:
    """A plan that passed validation, with the schema and hash of every step."""

    plan: Plan
    schemas: tuple[Schema, ...]
    source: SourceInfo
    hashes: tuple[str, ...]

    @property
    def steps(self) -> tuple[Step, ...]:
        return self.plan.steps

    @property
    def output(self) -> int:
        return self.plan.output

    @property
    def schema(self) -> Schema:
        return self.schemas[self.output]

    @property
    def plan_hash(self) -> str:
        return self.hashes[self.output]

    def input_schema(self, step: int) -> Schema:
        return self.schemas[self.steps[step].input]


_NUMBERS = frozenset((Kind.INTEGER, Kind.DECIMAL))
_RANKED = _NUMBERS | {Kind.TIMESTAMP}
_SAME = None
#: For each aggregate with a column: kinds it applies to, kind of its result (None: the same).
AGGREGATES: dict[str, tuple[frozenset[Kind], Kind | None]] = {
    "count_non_null": (frozenset(Kind), Kind.INTEGER),
    "sum": (_NUMBERS, _SAME),
    "mean": (_NUMBERS, Kind.DECIMAL),
    "median": (_NUMBERS, Kind.DECIMAL),
    "min": (_RANKED | {Kind.TEXT, Kind.BOOLEAN}, _SAME),
    "max": (_RANKED | {Kind.TEXT, Kind.BOOLEAN}, _SAME),
    "percentile": (_RANKED, _SAME),
}
#: Aggregates that are 0, not missing, over no values.
COUNTS = frozenset(("count", "count_non_null"))


def percentile_problem(p: object) -> str:
    return f"a percentile's p must be a whole number from 1 to 99, not {p}"


def _once(names: Iterable[str]) -> None:
    seen: set[str] = set()
    for name in names:
        if name in seen:
            raise TypeProblem(f'the column name "{name}" is used twice')
        seen.add(name)


def _field(schema: Schema, name: str) -> Field:
    found = schema.find(name)
    if found is None:
        raise TypeProblem(f'there is no column named "{name}"')
    return found


def _after_filter(step: Filter, schema: Schema) -> Schema:
    found = step.predicate.infer(schema)
    if found.kind is not Kind.BOOLEAN:
        raise TypeProblem(f"the filter condition must be true/false, not {_label(found)}")
    return schema


def _label(found: Typed) -> str:
    return found.kind.label if found.kind else "missing"


def _after_map(step: Map, schema: Schema) -> Schema:
    if not step.name:
        raise TypeProblem("the new column needs a name")
    if schema.find(step.name):
        raise TypeProblem(f'there is already a column named "{step.name}"; choose another name')
    found = step.expr.infer(schema)
    if found.kind is None:
        raise TypeProblem("a column can't be always missing")
    return Schema((*schema.fields, Field(step.name, found.kind, found.nullable)))


def _after_project(step: Project, schema: Schema) -> Schema:
    if not step.columns:
        raise TypeProblem("keep at least one column")
    _once(step.columns)
    return Schema.of(_field(schema, c) for c in step.columns)


def _aggregate_field(agg: Agg, schema: Schema) -> Field:
    if not agg.name:
        raise TypeProblem("every aggregate needs a name")
    if agg.fn == "percentile" and not (isinstance(agg.p, int) and 1 <= agg.p <= 99):
        raise TypeProblem(percentile_problem(agg.p))
    source = None if agg.column is None else _field(schema, agg.column)
    if agg.fn == "count":
        if source:
            raise TypeProblem("count counts rows and takes no column; use count_non_null")
        return Field(agg.name, Kind.INTEGER, False)
    if source is None:
        raise TypeProblem(f"{agg.fn} needs a column")
    kinds, result = AGGREGATES[agg.fn]
    if source.kind not in kinds:
        raise TypeProblem(f'can\'t take the {agg.fn} of "{agg.column}", a {source.kind.label} column')
    return Field(agg.name, result or source.kind, agg.fn not in COUNTS)


def _after_aggregate(step: Aggregate, schema: Schema) -> Schema:
    if not step.group_by and not step.aggregates:
        raise TypeProblem("group by at least one column or compute at least one aggregate")
    _once((*step.group_by, *(a.name for a in step.aggregates)))
    keys = []
    for name in step.group_by:
        keys.append(_field(schema, name))
        if keys[-1].kind is Kind.LOCATION:
            raise TypeProblem(f'can\'t group by the location column "{name}"')
    return Schema((*keys, *(_aggregate_field(a, schema) for a in step.aggregates)))


def _after_sort(step: Sort, schema: Schema) -> Schema:
    if not step.keys:
        raise TypeProblem("sort needs at least one column")
    for key in step.keys:
        if _field(schema, key.column).kind is Kind.LOCATION:
            raise TypeProblem(f'can\'t sort by the location column "{key.column}"')
    return schema


_AFTER: dict[type, Callable] = {
    Filter: _after_filter,
    Map: _after_map,
    Project: _after_project,
    Aggregate: _after_aggregate,
    Sort: _after_sort,
    Limit: lambda step, schema: schema,
}


def validate(plan: Plan, catalog: Catalog) -> ValidPlan:
    """Check structure, names and types; raises :class:`PlanProblem` at the first problem.

    As every step but a scan has one input and every step must lead to the
    output, a valid plan is a chain with one scan at its start.
    """
    from lineaframe.plans.planjson import step_hashes

    if not plan.steps:
        raise PlanProblem("the plan has no steps")
    if not 0 <= plan.output < len(plan.steps):
        raise PlanProblem(f"the output step {plan.output} doesn't exist")
    schemas: list[Schema] = []
    source: SourceInfo | None = None
    for i, step in enumerate(plan.steps):
        try:
            if isinstance(step, Scan):
                if step.snapshot not in catalog:
                    raise TypeProblem(f"snapshot {step.snapshot} is not loaded")
                info = catalog[step.snapshot]
                _once(info.schema.names)
                schemas.append(info.schema)
                source = info
            else:
                if step.input >= i:
                    raise TypeProblem(f"reads step {step.input}, which doesn't come before it")
                schemas.append(_AFTER[type(step)](step, schemas[step.input]))
        except TypeProblem as e:
            raise PlanProblem(str(e), i) from None
    leads, at = {plan.output}, plan.output
    while not isinstance(plan.steps[at], Scan):
        at = plan.steps[at].input
        leads.add(at)
    for i in range(len(plan.steps)):
        if i not in leads:
            raise PlanProblem("this step doesn't lead to the output", i)
    return ValidPlan(plan, tuple(schemas), source, tuple(step_hashes(plan)))
