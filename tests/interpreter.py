"""A plain row interpreter of plans, written from their description, that also carries source rows."""

from __future__ import annotations

import datetime as dt
import math
from fractions import Fraction
from functools import cmp_to_key

from lineaframe.plans.expr import Call, Col, Lit
from lineaframe.plans.plan import Aggregate, Filter, Limit, Map, Project, Sort
from lineaframe.plans.types import Kind

DAY = 86_400_000_000
EPOCH = dt.datetime(1970, 1, 1)


class Overflow(Exception):
    pass


def checked(n):
    if not -(2**63) <= n < 2**63:
        raise Overflow
    return n


def finite(x):
    return x if x is not None and math.isfinite(x) else None


def order(a, b):
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    elif isinstance(a, float) or isinstance(b, float):
        a, b = Fraction(a), Fraction(b)
    return (a > b) - (a < b)


def null_first(a, b):
    if a is None or b is None:
        return (a is not None) - (b is not None)
    return order(a, b)


HOLDS = {"eq": lambda c: c == 0, "ne": lambda c: c != 0, "lt": lambda c: c < 0, "le": lambda c: c <= 0, "gt": lambda c: c > 0, "ge": lambda c: c >= 0}


def trunc(unit, t):
    day = (EPOCH + dt.timedelta(microseconds=t)).replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "week":
        day -= dt.timedelta(days=day.weekday())
    if unit in ("month", "year"):
        day = day.replace(day=1)
    if unit == "year":
        day = day.replace(month=1)
    return (day - EPOCH) // dt.timedelta(microseconds=1)


def evaluate(e, row, schema):
    if isinstance(e, Col):
        return row[e.name]
    if isinstance(e, Lit):
        return e.value.value
    assert isinstance(e, Call)
    args = [evaluate(a, row, schema) for a in e.args]
    if e.fn == "and":
        return False if False in args else None if None in args else True
    if e.fn == "or":
        return True if True in args else None if None in args else False
    if e.fn == "is_null":
        return args[0] is None
    if None in args:
        return None
    if e.fn == "not":
        return not args[0]
    if e.fn in HOLDS:
        return HOLDS[e.fn](order(*args))
    if e.fn == "in":
        return any(order(args[0], v.value) == 0 for v in e.values)
    if e.fn == "date_trunc":
        return trunc(e.unit, args[0])
    if e.fn in ("lat", "lon"):
        return args[0][e.fn == "lon"]
    kind = e.infer(schema).kind
    a, b = args
    if kind is Kind.DECIMAL:
        a, b = float(a), float(b)
        if e.fn == "div":
            return finite(a / b) if b else None
        try:
            return finite({"add": a + b, "sub": a - b, "mul": a * b}[e.fn])
        except OverflowError:
            return None
    return checked({"add": a + b, "sub": a - b, "mul": a * b}[e.fn])


def aggregate(a, rows, kind):
    if a.fn == "count":
        return len(rows)
    xs = [r[a.column] for r in rows if r[a.column] is not None]
    if a.fn == "count_non_null":
        return len(xs)
    if not xs:
        return None
    ranked = sorted(xs, key=cmp_to_key(order))
    if a.fn in ("min", "max"):
        return ranked[0 if a.fn == "min" else -1]
    if a.fn == "percentile":
        return ranked[-(-a.p * len(xs) // 100) - 1]
    if a.fn == "median":
        lo, hi = float(ranked[(len(xs) - 1) // 2]), float(ranked[len(xs) // 2])
        plain = (lo + hi) / 2
        return plain if math.isfinite(plain) else lo / 2 + hi / 2
    if kind is Kind.INTEGER:
        return checked(sum(xs)) if a.fn == "sum" else sum(xs) / len(xs)
    total = 0.0
    for x in xs:
        total += x
    return finite(total) if a.fn == "sum" else finite(total / len(xs))


def run(plan, rows):
    """Per step a list of (row, frozenset of source rows); ``rows`` is a list of dicts."""
    steps = [[(r, frozenset([i])) for i, r in enumerate(rows)]]
    for number, op in enumerate(plan.steps[1:], 1):
        schema, source = plan.input_schema(number), steps[op.input]
        match op:
            case Filter(_, predicate):
                out = [(r, s) for r, s in source if evaluate(predicate, r, schema) is True]
            case Map(_, name, expr):
                out = [({**r, name: evaluate(expr, r, schema)}, s) for r, s in source]
            case Project(_, columns):
                out = [({c: r[c] for c in columns}, s) for r, s in source]
            case Sort(_, keys):
                def compare(a, b, keys=keys):
                    for k in keys:
                        c = null_first(a[0][k.column], b[0][k.column])
                        if c:
                            return -c if k.descending else c
                    return 0

                out = sorted(source, key=cmp_to_key(compare))
            case Limit(_, count):
                out = source[:count]
            case Aggregate(_, keys, aggregates):
                groups: dict = {}
                for r, s in source:
                    groups.setdefault(tuple(0.0 if r[k] == 0 and isinstance(r[k], float) else r[k] for k in keys), []).append((r, s))
                if not keys and not groups:
                    groups[()] = []
                made = []
                for key, members in groups.items():
                    row = dict(zip(keys, key, strict=True))
                    for a in aggregates:
                        row[a.name] = aggregate(a, [r for r, _ in members], schema.find(a.column).kind if a.column else None)
                    made.append((row, frozenset().union(*[s for _, s in members])))

                def by_keys(a, b, keys=keys):
                    return next((c for c in (null_first(a[0][k], b[0][k]) for k in keys) if c), 0)

                out = sorted(made, key=cmp_to_key(by_keys))
        steps.append(out)
    return steps
