"""Plans as JSON, read strictly; canonical JSON; hashes of steps.

A hash covers a step and, through the hash of the step it reads, all before it.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable

from lineaframe.plans.expr import FUNCTIONS, UNITS, Call, Col, Expr, Lit
from lineaframe.plans.plan import (
    AGGREGATES, Agg, Aggregate, Filter, Key, Limit, Map, OP_NAMES, Plan, PlanProblem, Project, Scan, Sort, Step, percentile_problem,
)
from lineaframe.plans.types import INT_MAX, INT_MIN, MISSING, Kind, Value, format_number, format_stamp, parse_stamp

FORMAT = "lineaframe-plan/1"
#: Plans of other engines with the same language are read too.
_FORMATS = re.compile(r"[a-z]+-plan/1\Z")
_CONTEXT = b"lineaframe step v1"
_UINT = re.compile(r"(?:0|[1-9][0-9]*)\Z")
_INT = re.compile(r"(?:0|-?[1-9][0-9]*)\Z")


class _Bad(Exception):
    """What is wrong with a piece of JSON."""


# ---- writing


def value_json(v: Value) -> object:
    match v.kind:
        case None:
            return None
        case Kind.INTEGER:
            return {"i64": str(v.value)}
        case Kind.DECIMAL:
            return {"f64": v.value}
        case Kind.TIMESTAMP:
            return {"timestamp": format_stamp(v.value)}
        case Kind.BOOLEAN:
            return {"bool": v.value}
    return {"str": v.value}


def expr_json(e: Expr) -> dict:
    match e:
        case Col(name):
            return {"column": name}
        case Lit(value):
            return {"literal": value_json(value)}
    assert isinstance(e, Call)
    out: dict = {"call": e.fn, "args": [expr_json(a) for a in e.args]}
    if e.fn == "in":
        out["values"] = [value_json(v) for v in e.values]
    if e.unit is not None:
        out["unit"] = e.unit
    return out


def _agg_json(a: Agg) -> dict:
    out = {"name": a.name, "fn": a.fn, "p": a.p, "column": a.column}
    return {k: v for k, v in out.items() if v is not None}


def step_json(step: Step, reads: object = None) -> dict:
    """``reads`` stands under ``input``: a step number, or that step's hash."""
    head = {"op": OP_NAMES[type(step)]} | ({} if isinstance(step, Scan) else {"input": reads})
    match step:
        case Scan(snapshot):
            return head | {"snapshot": snapshot}
        case Filter(_, predicate):
            return head | {"predicate": expr_json(predicate)}
        case Map(_, name, expr):
            return head | {"name": name, "expr": expr_json(expr)}
        case Project(_, columns):
            return head | {"columns": list(columns)}
        case Aggregate(_, group_by, aggregates):
            return head | {"group_by": list(group_by), "aggregates": [_agg_json(a) for a in aggregates]}
        case Sort(_, keys):
            return head | {"keys": [{"column": k.column, "order": "desc" if k.descending else "asc"} for k in keys]}
        case Limit(_, count):
            return head | {"count": str(count)}
    raise TypeError(step)


def plan_json(plan: Plan) -> dict:
    steps = [step_json(s, getattr(s, "input", None)) for s in plan.steps]
    return {"format": FORMAT, "nodes": steps, "output": plan.output}


def canonical(x: object) -> str:
    """RFC 8785: keys in order of UTF-16 units, numbers as ECMAScript writes them, integers up to 2^53."""
    if isinstance(x, dict):
        keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(x[k])}" for k in keys) + "}"
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(canonical, x)) + "]"
    if isinstance(x, float):
        if not math.isfinite(x):
            raise ValueError("canonical JSON has no NaN or infinity")
        return format_number(x)
    if isinstance(x, int) and not isinstance(x, bool) and abs(x) > 2**53:
        raise ValueError(f"canonical JSON cannot represent {x} exactly (integer beyond 2^53)")
    return json.dumps(x, ensure_ascii=False)


def step_hashes(plan: Plan) -> list[str]:
    """64 hex digits for every step."""
    out: list[str] = []
    for step in plan.steps:
        reads = None if isinstance(step, Scan) else out[step.input]
        text = canonical(step_json(step, reads)).encode("utf-8", "surrogatepass")
        h = hashlib.blake2b(digest_size=32, person=_CONTEXT[:16])
        h.update(len(text).to_bytes(8, "little"))
        h.update(text)
        out.append(h.hexdigest())
    return out


# ---- reading


class _Object:
    """A JSON object with exactly the given keys."""

    def __init__(self, x: object, *keys: str) -> None:
        if not isinstance(x, dict):
            raise _Bad("expected an object")
        for k in sorted(x):
            if k not in keys:
                raise _Bad(f'unexpected key "{k}"')
        for k in keys:
            if k not in x:
                raise _Bad(f'missing key "{k}"')
        self.x = x

    def text(self, key: str) -> str:
        if not isinstance(self.x[key], str):
            raise _Bad(f'"{key}" must be a string')
        return self.x[key]

    def step(self, key: str) -> int:
        n = self.x[key]
        if not isinstance(n, int) or isinstance(n, bool) or not 0 <= n < 2**32:
            raise _Bad(f'"{key}" must be a step number')
        return n

    def items(self, key: str) -> list:
        if not isinstance(self.x[key], list):
            raise _Bad(f'"{key}" must be a list')
        return self.x[key]

    def texts(self, key: str) -> tuple[str, ...]:
        found = self.items(key)
        if not all(isinstance(s, str) for s in found):
            raise _Bad(f'"{key}" must be a list of strings')
        return tuple(found)


def _read_value(x: object) -> Value:
    if x is None:
        return MISSING
    if not isinstance(x, dict):
        raise _Bad("a literal must be null or a one-key object")
    if len(x) != 1:
        raise _Bad("a literal must have exactly one type key")
    ((name, v),) = x.items()
    if name in ("i64", "str", "timestamp") and not isinstance(v, str):
        raise _Bad(f"a {name} literal must be a string")
    match name:
        case "bool":
            if not isinstance(v, bool):
                raise _Bad("a bool literal must be true or false")
            return Value(Kind.BOOLEAN, v)
        case "i64":
            if not _INT.match(v) or not INT_MIN <= int(v) <= INT_MAX:
                raise _Bad(f'"{v}" is not an integer')
            return Value(Kind.INTEGER, int(v))
        case "f64":
            if not isinstance(v, int | float) or isinstance(v, bool):
                raise _Bad("an f64 literal must be a number")
            return Value(Kind.DECIMAL, float(v))
        case "str":
            return Value(Kind.TEXT, v)
        case "timestamp":
            if (at := parse_stamp(v)) is None:
                raise _Bad(f'"{v}" is not a YYYY-MM-DDTHH:MM:SS timestamp')
            return Value(Kind.TIMESTAMP, at)
    raise _Bad(f'unknown literal type "{name}"')


def _read_expr(x: object) -> Expr:
    fields = x if isinstance(x, dict) else {}
    if "column" in fields:
        return Col(_Object(x, "column").text("column"))
    if "literal" in fields:
        return Lit(_read_value(_Object(x, "literal").x["literal"]))
    fn = fields.get("call")
    if not isinstance(fn, str):
        raise _Bad('an expression needs "column", "literal" or "call"')
    o = _Object(x, "call", "args", *{"in": ("values",), "date_trunc": ("unit",)}.get(fn, ()))
    args = tuple(_read_expr(a) for a in o.items("args"))
    if fn not in FUNCTIONS:
        raise _Bad(f'unknown function "{fn}"')
    arity = FUNCTIONS[fn].arity
    if arity is not None and len(args) != arity:
        raise _Bad(f"{fn} takes {arity} argument(s), got {len(args)}")
    if fn == "in":
        return Call(fn, args, values=tuple(_read_value(v) for v in o.items("values")))
    if fn == "date_trunc":
        unit = o.text("unit")
        if unit not in UNITS:
            raise _Bad(f'unknown time unit "{unit}"')
        return Call(fn, args, unit=unit)
    return Call(fn, args)


def _read_agg(x: object) -> Agg:
    fields = x if isinstance(x, dict) else {}
    ranked = fields.get("fn") == "percentile"
    o = _Object(x, "name", "fn", *(["column"] if "column" in fields else []), *(["p"] if ranked else []))
    fn = o.text("fn")
    p = o.x["p"] if ranked else None
    if ranked and not (isinstance(p, int) and not isinstance(p, bool) and 1 <= p <= 99):
        raise _Bad(percentile_problem(json.dumps(p)))
    if fn != "count" and fn not in AGGREGATES:
        raise _Bad(f'unknown aggregate "{fn}"')
    return Agg(o.text("name"), fn, o.text("column") if "column" in o.x else None, p)


def _read_key(x: object) -> Key:
    o = _Object(x, "column", "order")
    order = o.text("order")
    if order not in ("asc", "desc"):
        raise _Bad(f'sort order must be asc or desc, not "{order}"')
    return Key(o.text("column"), order == "desc")


def _read_scan(o: _Object) -> Scan:
    name = o.text("snapshot")
    if not re.fullmatch(r"[0-9a-fA-F]{64}", name):
        raise _Bad(f'"{name}" is not a 64-digit hex snapshot hash')
    return Scan(name.lower())


def _read_limit(o: _Object) -> Limit:
    reads, text = o.step("input"), o.text("count")
    if not _UINT.match(text) or int(text) >= 2**64:
        raise _Bad(f'"{text}" is not a row count')
    return Limit(reads, int(text))


#: For each step: its keys besides ``op``, and how it is read.
_STEPS: dict[str, tuple[tuple[str, ...], Callable[[_Object], Step]]] = {
    "scan": (("snapshot",), _read_scan),
    "filter": (("input", "predicate"), lambda o: Filter(o.step("input"), _read_expr(o.x["predicate"]))),
    "map": (("input", "name", "expr"), lambda o: Map(o.step("input"), o.text("name"), _read_expr(o.x["expr"]))),
    "project": (("input", "columns"), lambda o: Project(o.step("input"), o.texts("columns"))),
    "aggregate": (
        ("input", "group_by", "aggregates"),
        lambda o: Aggregate(o.step("input"), o.texts("group_by"), tuple(_read_agg(a) for a in o.items("aggregates"))),
    ),
    "sort": (("input", "keys"), lambda o: Sort(o.step("input"), tuple(_read_key(k) for k in o.items("keys")))),
    "limit": (("input", "count"), _read_limit),
}


def _read_step(x: object) -> Step:
    op = x.get("op") if isinstance(x, dict) else None
    if not isinstance(op, str):
        raise _Bad('each step needs an "op"')
    if op not in _STEPS:
        raise _Bad(f'unknown op "{op}"')
    keys, read = _STEPS[op]
    return read(_Object(x, "op", *keys))


def read_expr(x: object) -> Expr:
    """An expression from JSON; raises :class:`PlanProblem`."""
    try:
        return _read_expr(x)
    except _Bad as e:
        raise PlanProblem(str(e)) from None


def read_plan(x: object) -> Plan:
    """A plan from JSON, as text or as parsed; raises :class:`PlanProblem`."""
    if isinstance(x, str | bytes):
        try:
            x = json.loads(x)
        except ValueError as e:
            raise PlanProblem(f"the plan isn't JSON: {e}") from None
    try:
        o = _Object(x, "format", "nodes", "output")
        if not _FORMATS.match(o.text("format")):
            raise _Bad(f'unsupported plan format "{o.text("format")}"')
        nodes = o.items("nodes")
        output = o.step("output")
    except _Bad as e:
        raise PlanProblem(str(e)) from None
    steps = []
    for i, node in enumerate(nodes):
        try:
            steps.append(_read_step(node))
        except _Bad as e:
            raise PlanProblem(str(e), i) from None
    return Plan(tuple(steps), output)
