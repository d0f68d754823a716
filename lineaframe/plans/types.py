"""Types, fields, schemas and literals."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from enum import Enum


class Kind(Enum):
    """The closed set of column types; the value is the name that users read."""

    INTEGER = "integer"
    DECIMAL = "decimal"
    BOOLEAN = "true/false"
    TIMESTAMP = "timestamp"
    TEXT = "text"
    LOCATION = "location"

    @property
    def numeric(self) -> bool:
        return self in (Kind.INTEGER, Kind.DECIMAL)

    @property
    def label(self) -> str:
        return self.value


@dataclass(frozen=True)
class Field:
    name: str
    kind: Kind
    nullable: bool = True


@dataclass(frozen=True)
class Schema:
    """Ordered fields; names are compared exactly, so ``a`` and ``A`` are two columns."""

    fields: tuple[Field, ...]

    @staticmethod
    def of(fields: Iterable[Field]) -> Schema:
        return Schema(tuple(fields))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def find(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def __iter__(self) -> Iterator[Field]:
        return iter(self.fields)


INT_MIN, INT_MAX = -(2**63), 2**63 - 1
_EPOCH = dt.datetime(1970, 1, 1)
_STAMP = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,6}))?\Z")


def parse_stamp(text: str) -> int | None:
    """Microseconds since 1970 of a wall-clock time ``YYYY-MM-DDTHH:MM:SS[.1-6 digits]``; None if it is anything else."""
    found = _STAMP.match(text)
    if not found:
        return None
    *whole, fraction = found.groups()
    try:
        at = dt.datetime(*map(int, whole))
    except ValueError:
        return None
    return (at - _EPOCH) // dt.timedelta(microseconds=1) + int((fraction or "0").ljust(6, "0"))


def format_stamp(micros: int) -> str:
    """The inverse of :func:`parse_stamp`, always with six digits of fraction."""
    return (_EPOCH + dt.timedelta(microseconds=micros)).strftime("%Y-%m-%dT%H:%M:%S.%f").rjust(26, "0")


def format_number(x: float) -> str:
    """A finite decimal as ECMAScript writes it; minus zero is written ``0``."""
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = whole + ("" if part == "0" else part)
    point = len(whole) + int(exponent or 0)  # digits before the decimal point
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    digits = stripped.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return f"{sign}{digits}{'0' * (point - n)}"
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    tail = f".{digits[1:]}" if n > 1 else ""
    return f"{sign}{digits[0]}{tail}e{'+' if point > 0 else '-'}{abs(point - 1)}"


@dataclass(frozen=True)
class Value:
    """A constant. ``kind`` is None for the missing value; timestamps are microseconds since 1970."""

    kind: Kind | None
    value: object = None

    def __post_init__(self) -> None:
        if self.kind is Kind.INTEGER and not INT_MIN <= self.value <= INT_MAX:
            raise ValueError(f"{self.value} does not fit in 64 bits")

    def words(self) -> str:
        """How a sentence shows it."""
        if self.kind is None:
            return "missing"
        if self.kind is Kind.BOOLEAN:
            return "true" if self.value else "false"
        if self.kind is Kind.DECIMAL:
            return format_number(self.value)
        if self.kind is Kind.TEXT:
            return f'"{self.value}"'
        if self.kind is Kind.TIMESTAMP:
            shown = format_stamp(self.value).removesuffix(".000000")
            return shown.removesuffix("T00:00:00").replace("T", " ")
        return str(self.value)

    # -0.0 and 0.0 are different constants, though they hash alike in a plan
    def __eq__(self, other: object) -> bool:
        return isinstance(other, Value) and self.kind is other.kind and repr(self.value) == repr(other.value)

    def __hash__(self) -> int:
        return hash((self.kind, repr(self.value)))


MISSING = Value(None)


def value_of(x: object) -> Value:
    """A constant from a Python value: None, bool, int, float, str or a naive datetime."""
    match x:
        case Value():
            return x
        case None:
            return MISSING
        case bool():
            return Value(Kind.BOOLEAN, x)
        case int():
            return Value(Kind.INTEGER, x)
        case float():
            return Value(Kind.DECIMAL, x)
        case str():
            return Value(Kind.TEXT, x)
        case dt.datetime():
            return Value(Kind.TIMESTAMP, (x - _EPOCH) // dt.timedelta(microseconds=1))
    raise TypeError(f"no constant for {type(x).__name__}")


def stamp(text: str) -> Value:
    micros = parse_stamp(text)
    if micros is None:
        raise ValueError(f'"{text}" is not a YYYY-MM-DDTHH:MM:SS timestamp')
    return Value(Kind.TIMESTAMP, micros)
