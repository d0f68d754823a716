"""Scalar expressions: columns, constants and calls of a closed set of functions.

Every function is one entry of ``FUNCTIONS``: how many arguments it takes, how
its result is typed, and how a sentence shows it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from lineaframe.plans.types import Kind, Schema, Value, value_of


class TypeProblem(Exception):
    """Why an expression has no type, in plain English."""


class Typed(NamedTuple):
    """``kind`` is None for a bare missing value only."""

    kind: Kind | None
    nullable: bool


class Expr:
    """Base of all expressions, with operators to build them."""

    def infer(self, schema: Schema) -> Typed:
        raise NotImplementedError

    def words(self, schema: Schema, depth: int = 0) -> str:
        """``depth`` 0 at the top, 1 inside and/or, 2 as an operand."""
        raise NotImplementedError

    def parts(self) -> Sequence[Expr]:
        return ()

    def needs(self, schema: Schema) -> tuple[Kind, bool]:
        """Kind and nullability where a typed value is needed."""
        kind, nullable = self.infer(schema)
        if kind is None:
            raise TypeProblem("a bare null has no type here; use is_null to test for missing values")
        return kind, nullable

    def columns(self) -> list[str]:
        """Names of all columns read, in the order of first mention."""
        own = [self.name] if isinstance(self, Col) else []
        return list(dict.fromkeys(own + [c for p in self.parts() for c in p.columns()]))

    def divides(self) -> bool:
        return isinstance(self, Call) and self.fn == "div" or any(p.divides() for p in self.parts())

    def _with(self, fn: str, other: object) -> Call:
        return Call(fn, (self, as_expr(other)))

    def eq(self, other: object) -> Call:
        return self._with("eq", other)

    def ne(self, other: object) -> Call:
        return self._with("ne", other)

    def __lt__(self, other: object) -> Call:
        return self._with("lt", other)

    def __le__(self, other: object) -> Call:
        return self._with("le", other)

    def __gt__(self, other: object) -> Call:
        return self._with("gt", other)

    def __ge__(self, other: object) -> Call:
        return self._with("ge", other)

    def __add__(self, other: object) -> Call:
        return self._with("add", other)

    def __sub__(self, other: object) -> Call:
        return self._with("sub", other)

    def __mul__(self, other: object) -> Call:
        return self._with("mul", other)

    def __truediv__(self, other: object) -> Call:
        return self._with("div", other)

    def __invert__(self) -> Call:
        return Call("not", (self,))

    def is_null(self) -> Call:
        return Call("is_null", (self,))

    def is_in(self, *values: object) -> Call:
        return Call("in", (self,), values=tuple(value_of(v) for v in values))

    def trunc(self, unit: str) -> Call:
        return Call("date_trunc", (self,), unit=unit)

    def lat(self) -> Call:
        return Call("lat", (self,))

    def lon(self) -> Call:
        return Call("lon", (self,))


@dataclass(frozen=True)
class Col(Expr):
    name: str

    def infer(self, schema: Schema) -> Typed:
        found = schema.find(self.name)
        if found is None:
            raise TypeProblem(f'there is no column named "{self.name}"')
        return Typed(found.kind, found.nullable)

    def words(self, schema: Schema, depth: int = 0) -> str:
        return self.name


@dataclass(frozen=True)
class Lit(Expr):
    value: Value

    def infer(self, schema: Schema) -> Typed:
        if self.value.kind is Kind.DECIMAL and not math.isfinite(self.value.value):
            shown = "NaN" if math.isnan(self.value.value) else "inf" if self.value.value > 0 else "-inf"
            raise TypeProblem(f"{shown} is not a usable number")
        return Typed(self.value.kind, self.value.kind is None)

    def words(self, schema: Schema, depth: int = 0) -> str:
        return self.value.words()


@dataclass(frozen=True)
class Call(Expr):
    """``values`` for ``in`` and ``unit`` for ``date_trunc`` only."""

    fn: str
    args: tuple[Expr, ...]
    values: tuple[Value, ...] = field(default=())
    unit: str | None = None

    def parts(self) -> Sequence[Expr]:
        return self.args

    def infer(self, schema: Schema) -> Typed:
        return FUNCTIONS[self.fn].infer(self, schema)

    def words(self, schema: Schema, depth: int = 0) -> str:
        return FUNCTIONS[self.fn].words(self, schema, depth)


def as_expr(x: object) -> Expr:
    return x if isinstance(x, Expr) else Lit(value_of(x))


def col(name: str) -> Col:
    return Col(name)


def lit(x: object) -> Lit:
    return Lit(value_of(x))


def all_of(*args: Expr) -> Call:
    return Call("and", args)


def any_of(*args: Expr) -> Call:
    return Call("or", args)


@dataclass(frozen=True)
class Function:
    arity: int | None  # None: any number
    infer: Callable[[Call, Schema], Typed]
    words: Callable[[Call, Schema, int], str]


def comparable(a: Kind, b: Kind) -> bool:
    return a.numeric and b.numeric or a is b and a in (Kind.TIMESTAMP, Kind.TEXT, Kind.BOOLEAN)


def arithmetic(fn: str, a: Kind, b: Kind) -> Kind | None:
    """Kind of ``a fn b``; durations are integers, in microseconds."""
    i, t = Kind.INTEGER, Kind.TIMESTAMP
    if a.numeric and b.numeric:
        return i if fn != "div" and a is b is i else Kind.DECIMAL
    special = {("sub", t, t): i, ("add", t, i): t, ("sub", t, i): t, ("add", i, t): t}
    return special.get((fn, a, b))


def _wrapped(text: str, needed: bool) -> str:
    return f"({text})" if needed else text


#: Verbs of comparisons, of numbers and texts and of times; signs; names of units.
VERBS = {
    "eq": ("is", "is"),
    "ne": ("is not", "is not"),
    "lt": ("is less than", "is before"),
    "le": ("is at most", "is on or before"),
    "gt": ("is greater than", "is after"),
    "ge": ("is at least", "is on or after"),
}
SIGNS = {"add": "+", "sub": "−", "mul": "×", "div": "÷"}
UNITS = {"day": "day", "week": "week (starting Monday)", "month": "month", "year": "year"}


def _infer_compare(call: Call, schema: Schema) -> Typed:
    (a, na), (b, nb) = (x.needs(schema) for x in call.args)
    if not comparable(a, b):
        raise TypeProblem(f"can't compare {a.label} with {b.label} ({call.fn})")
    return Typed(Kind.BOOLEAN, na or nb)


def _words_compare(call: Call, schema: Schema, depth: int) -> str:
    a, b = call.args
    try:
        timely = a.infer(schema).kind is Kind.TIMESTAMP
    except TypeProblem:
        timely = False
    return _wrapped(f"{a.words(schema, 2)} {VERBS[call.fn][timely]} {b.words(schema, 2)}", depth >= 2)


def _truth(x: Expr, schema: Schema) -> bool:
    kind, nullable = x.needs(schema)
    if kind is not Kind.BOOLEAN:
        raise TypeProblem(f"expected true/false, got {kind.label}")
    return nullable


def _infer_logic(call: Call, schema: Schema) -> Typed:
    if not call.args:
        raise TypeProblem("and/or needs at least one argument")
    return Typed(Kind.BOOLEAN, any([_truth(x, schema) for x in call.args]))


def _words_logic(call: Call, schema: Schema, depth: int) -> str:
    if len(call.args) == 1:
        return call.args[0].words(schema, depth)
    return _wrapped(f" {call.fn} ".join(x.words(schema, 1) for x in call.args), depth >= 1)


def _words_not(call: Call, schema: Schema, depth: int) -> str:
    (inner,) = call.args
    if isinstance(inner, Call) and inner.fn == "is_null":
        return f"{inner.args[0].words(schema, 2)} is present"
    return f"not ({inner.words(schema)})"


def _infer_is_null(call: Call, schema: Schema) -> Typed:
    call.args[0].infer(schema)
    return Typed(Kind.BOOLEAN, False)


def _infer_in(call: Call, schema: Schema) -> Typed:
    kind, nullable = call.args[0].needs(schema)
    if not call.values:
        raise TypeProblem('"in" needs at least one value')
    for v in call.values:
        if v.kind is None:
            raise TypeProblem('"in" can\'t list a missing value; use is_null')
        if not comparable(kind, v.kind):
            raise TypeProblem(f"can't look for a {v.kind.label} value in a {kind.label} column")
    return Typed(Kind.BOOLEAN, nullable)


def _words_in(call: Call, schema: Schema, depth: int) -> str:
    subject, shown = call.args[0].words(schema, 2), [v.words() for v in call.values]
    verb = "is" if len(shown) == 1 else "is one of"
    return _wrapped(f"{subject} {verb} {', '.join(shown)}", depth >= 2)


def _infer_arithmetic(call: Call, schema: Schema) -> Typed:
    (a, na), (b, nb) = (x.needs(schema) for x in call.args)
    kind = arithmetic(call.fn, a, b)
    if kind is None:
        raise TypeProblem(f"can't {call.fn} {a.label} and {b.label}")
    return Typed(kind, na or nb or kind is Kind.DECIMAL)


def _words_arithmetic(call: Call, schema: Schema, depth: int) -> str:
    a, b = (x.words(schema, 2) for x in call.args)
    return _wrapped(f"{a} {SIGNS[call.fn]} {b}", depth >= 2)


def _infer_trunc(call: Call, schema: Schema) -> Typed:
    kind, nullable = call.args[0].needs(schema)
    if kind is not Kind.TIMESTAMP:
        raise TypeProblem(f"date_trunc needs a timestamp, not {kind.label}")
    return Typed(kind, nullable)


def _infer_coordinate(call: Call, schema: Schema) -> Typed:
    kind, nullable = call.args[0].needs(schema)
    if kind is not Kind.LOCATION:
        raise TypeProblem(f"lat/lon needs a location, not {kind.label}")
    return Typed(Kind.DECIMAL, nullable)


def _prefixed(prefix: Callable[[Call], str]) -> Callable[[Call, Schema, int], str]:
    return lambda call, schema, depth: f"{prefix(call)} of {call.args[0].words(schema, 2)}"


FUNCTIONS: dict[str, Function] = {
    **{fn: Function(2, _infer_compare, _words_compare) for fn in VERBS},
    **{fn: Function(2, _infer_arithmetic, _words_arithmetic) for fn in SIGNS},
    "and": Function(None, _infer_logic, _words_logic),
    "or": Function(None, _infer_logic, _words_logic),
    "not": Function(1, lambda c, s: Typed(Kind.BOOLEAN, _truth(c.args[0], s)), _words_not),
    "is_null": Function(1, _infer_is_null, lambda c, s, d: _wrapped(f"{c.args[0].words(s, 2)} is missing", d >= 2)),
    "in": Function(1, _infer_in, _words_in),
    "date_trunc": Function(1, _infer_trunc, _prefixed(lambda c: f"the {UNITS[c.unit]}")),
    "lat": Function(1, _infer_coordinate, _prefixed(lambda c: "the latitude")),
    "lon": Function(1, _infer_coordinate, _prefixed(lambda c: "the longitude")),
}
