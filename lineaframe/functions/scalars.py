"""Plan expressions as Spark columns.

All of it is built-in functions, so filters and maps stay in generated code and
filters on scan columns reach the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineaframe.plans.expr import Call, Col, Expr, Lit
from lineaframe.plans.types import Kind, Schema, Value, format_stamp

#: Spark types of the kinds.
SPARK_TYPES = {
    Kind.INTEGER: "bigint",
    Kind.DECIMAL: "double",
    Kind.BOOLEAN: "boolean",
    Kind.TIMESTAMP: "timestamp_ntz",
    Kind.TEXT: "string",
    Kind.LOCATION: "struct<lat:float,lon:float>",
}


def constant(v: Value) -> Column:
    if v.kind is None:
        return F.lit(None)
    shown = format_stamp(v.value).replace("T", " ") if v.kind is Kind.TIMESTAMP else v.value
    return F.lit(shown).cast(SPARK_TYPES[v.kind])


def finite(x: Column) -> Column:
    """``x``, or null where it is not a finite number."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def _mixed(fn: str, x: Column, y: Column) -> Column:
    """Integer ``x`` against decimal ``y`` as exact numbers: converting ``x`` would round it beyond 2^53."""
    negated = {"ne": "eq", "gt": "le", "ge": "lt"}
    if fn in negated:
        return ~_mixed(negated[fn], x, y)
    above, below, within = {
        "lt": (True, False, x < F.ceil(y)),
        "le": (True, False, x <= F.floor(y)),
        "eq": (False, False, (y == F.floor(y)) & (x == F.floor(y))),
    }[fn]
    limit = float(2**63)
    return (
        F.when(x.isNull() | y.isNull(), F.lit(None))
        .when(y >= limit, F.lit(above))
        .when(y < -limit, F.lit(below))
        .otherwise(within)
    )


_FLIPPED = {"eq": "eq", "ne": "ne", "lt": "gt", "le": "ge", "gt": "lt", "ge": "le"}
_PLAIN: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}
_SIGNED: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": F.try_divide,
}


def compare(fn: str, a: Column, ka: Kind, b: Column, kb: Kind) -> Column:
    if ka is kb:
        return _PLAIN[fn](a, b)
    return _mixed(fn, a, b) if ka is Kind.INTEGER else _mixed(_FLIPPED[fn], b, a)


def _arithmetic(fn: str, a: Column, ka: Kind, b: Column, kb: Kind) -> Column:
    if ka is Kind.TIMESTAMP and kb is Kind.TIMESTAMP:
        return F.timestamp_diff("MICROSECOND", b, a)
    if ka is Kind.TIMESTAMP:
        return F.timestamp_add("MICROSECOND", b if fn == "add" else -b, a)
    if kb is Kind.TIMESTAMP:
        return F.timestamp_add("MICROSECOND", a, b)
    if fn != "div" and ka is kb is Kind.INTEGER:
        return _SIGNED[fn](a, b)
    return finite(_SIGNED[fn](a.cast("double"), b.cast("double")))


def _truncated(unit: str, x: Column) -> Column:
    """Start of the day, ISO week, month or year, by way of dates: no time zone has a say in it."""
    day = x.cast("date")
    return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")


def _within(subject: Column, kind: Kind, values: tuple[Value, ...]) -> Column:
    if all(v.kind is kind for v in values):
        return subject.isin(*[constant(v) for v in values])
    return reduce(or_, [compare("eq", subject, kind, constant(v), v.kind) for v in values])


def to_column(e: Expr, schema: Schema, columns: Mapping[str, Column]) -> Column:
    """``columns`` has the Spark column of every name of ``schema``."""
    if isinstance(e, Col):
        return columns[e.name]
    if isinstance(e, Lit):
        return constant(e.value)
    assert isinstance(e, Call)
    args = [to_column(a, schema, columns) for a in e.args]
    kinds = [a.infer(schema).kind for a in e.args]
    match e.fn:
        case "and":
            return reduce(and_, args)
        case "or":
            return reduce(or_, args)
        case "not":
            return ~args[0]
        case "is_null":
            return args[0].isNull()
        case "in":
            return _within(args[0], kinds[0], e.values)
        case "date_trunc":
            return _truncated(e.unit, args[0])
        case "lat" | "lon":
            return args[0].getField(e.fn).cast("double")
        case "add" | "sub" | "mul" | "div":
            return _arithmetic(e.fn, args[0], kinds[0], args[1], kinds[1])
    return compare(e.fn, args[0], kinds[0], args[1], kinds[1])
