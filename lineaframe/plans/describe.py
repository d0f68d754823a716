"""A sentence or two for every step, generated from the plan."""

from __future__ import annotations

from collections.abc import Sequence

from lineaframe.plans.plan import Agg, Aggregate, Filter, Key, Limit, Map, Project, Scan, Sort, ValidPlan
from lineaframe.plans.types import Kind, Schema

#: Wording by kind, ascending and descending, or least and greatest.
ORDERS = {Kind.TEXT: ("A to Z", "Z to A"), Kind.TIMESTAMP: ("earliest first", "latest first")}
EXTREMES = {Kind.TEXT: ("alphabetically first", "alphabetically last"), Kind.TIMESTAMP: ("earliest", "latest")}
PHRASES = {
    "count": "the number of rows",
    "count_non_null": "the number of rows with {c} present",
    "sum": "the total of {c}",
    "mean": "the average of {c}",
    "median": "the median of {c}",
    "min": "the {least} {c}",
    "max": "the {most} {c}",
    "percentile": "the {nth} percentile of {c} (the smallest value at least {p}% of rows are at or below)",
}


def _listed(items: Sequence[str]) -> str:
    return " and ".join(filter(None, (", ".join(items[:-1]), *items[-1:])))


def _nth(n: int) -> str:
    teen = n % 100 in (11, 12, 13)
    return f"{n}{'th' if teen else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def _measure(agg: Agg, schema: Schema) -> str:
    source = schema.find(agg.column) if agg.column else None
    least, most = EXTREMES.get(source.kind if source else None, ("smallest", "largest"))
    phrase = PHRASES[agg.fn].format(c=agg.column, p=agg.p, least=least, most=most, nth=_nth(agg.p or 0))
    return f"{phrase} (as {agg.name})"


def _sorted_by(key: Key, schema: Schema) -> str:
    words = ORDERS.get(schema.find(key.column).kind, ("smallest first", "largest first"))
    return f"{key.column} ({words[key.descending]})"


def describe_step(plan: ValidPlan, number: int) -> str:
    step = plan.steps[number]
    if isinstance(step, Scan):
        return f"Start from {plan.source.title} (snapshot {step.snapshot[:16]})."
    schema = plan.input_schema(number)
    may_miss = lambda names: any(schema.find(n).nullable for n in names)
    match step:
        case Filter(_, predicate):
            out = [f"Keep only rows where {predicate.words(schema)}."]
            if predicate.infer(schema).nullable:
                out.append("Rows where this can't be decided because a value is missing are dropped.")
        case Map(_, name, expr):
            out = [f"Add a column {name}: {expr.words(schema)}."]
            if expr.divides():
                out.append("Dividing by zero gives a missing value.")
        case Project(_, columns):
            out = [f"Keep only the columns {_listed(columns)}."]
        case Aggregate(_, keys, aggregates):
            measures = _listed([_measure(a, schema) for a in aggregates])
            if not keys:
                out = [f"Summarize all rows into one: {measures}."]
            elif not aggregates:
                out = [f"List each distinct combination of {_listed(keys)}."]
            else:
                out = [f"Group the rows by {_listed(keys)} and, for each group, compute {measures}."]
            if may_miss(a.column for a in aggregates if a.column):
                out.append("Missing values are left out of these calculations.")
            if may_miss(keys):
                out.append("Rows with a missing group value form their own group.")
        case Sort(_, keys):
            out = [f"Sort by {', then by '.join(_sorted_by(k, schema) for k in keys)}."]
            if may_miss(k.column for k in keys):
                out.append("Missing values count as the smallest.")
        case Limit(_, count):
            out = ["Keep only the first row." if count == 1 else f"Keep only the first {count:,} rows."]
    return " ".join(out)


def describe(plan: ValidPlan) -> list[str]:
    return [describe_step(plan, i) for i in range(len(plan.steps))]
