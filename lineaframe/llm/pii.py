"""Personal data in texts, by DataFrame functions alone.

Regular expressions propose spans, validators (digit counts, octets, the Luhn
sum, the IBAN remainder modulo 97) confirm them, and words nearby adjust a
score. Kinds ``email ip card phone`` make up the base; ``iban`` and ``ssn`` are
added where their score reaches ``ACCEPT``.

Positions come without any Python: a text split by a pattern gives the pieces
between the matches, and running sums of the lengths of pieces and matches are
the starts and ends, in code points. Patterns use possessive repeats and start
at most once in a run of characters; sums run by blocks, and of a long
text only the pieces of ``CHUNK`` around a place are read. So a text takes time
in proportion to its length, however many spans it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")

#: The patterns, in Java's notation. ``\G`` lets a match start where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
IBAN = "(?:" + "|".join(f"{c}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + ")"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

#: Score of a confirmed span, and what a word nearby adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEARBY_ADDS = {"email": 0.1, "ip": 0.2, "card": 0.1, "phone": 0.2, "iban": 0.1, "ssn": 0.5}
NEARBY = {
    "email": r"mail|contact|kontakt|courriel|correo",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|credit|karte|carte|tarjeta",
    "phone": r"phone|call|tel|fax|mobile|anruf|appel",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "ssn": r"ssn|social security",
}
#: Characters on each side in which words count as nearby; least score of a span of an added kind.
REACH = 40
ACCEPT = 0.7
#: Code points of a piece of a long text, and the length up to which a text is one piece.
CHUNK = 256
ONE_PIECE = 4096

_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, joined: Callable[[Column, Column], Column], start: Column, levels: int = 1) -> Column:
    """``joined`` over ``values[0..i]`` for each i: by blocks, so that each i reads a block, and the blocks before are few."""
    block = 256
    total = lambda xs: F.aggregate(xs, start, joined)
    if not levels:
        return _let(values, lambda xs: F.transform(xs, lambda _, i: total(F.slice(xs, F.lit(1), i + 1))))
    at = lambda i: F.floor(i / block).cast("int")

    def by_blocks(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), at(F.size(xs) - 1))
        blocks = F.transform(numbers, lambda b: total(F.slice(xs, b * block + 1, block)))
        return _let(
            F.struct(xs.alias("xs"), _running(blocks, joined, start, levels - 1).alias("run")),
            lambda s: F.transform(
                s["xs"],
                lambda _, i: joined(
                    F.when(i < block, start).otherwise(F.get(s["run"], at(i) - 1)), total(F.slice(s["xs"], at(i) * block + 1, i % block + 1))
                ),
            ),
        )

    return _let(values, lambda xs: F.when(F.size(xs) > 0, by_blocks(xs)).otherwise(xs))


def _running_sums(lengths: Column) -> Column:
    """Sums of ``lengths[0..i]`` for each i."""
    return _running(lengths, lambda acc, x: acc + x, F.lit(0))


def _in_pieces(text: Column) -> Column:
    """``struct<size, pieces>`` of a text, for :func:`_part`."""
    long = F.length(text) > ONE_PIECE
    pieces = F.when(long, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(F.array(text))
    return F.struct(F.when(long, F.lit(CHUNK)).otherwise(F.greatest(F.length(text), F.lit(1))).alias("size"), pieces.alias("pieces"))


def _part(cut: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text cut by :func:`_in_pieces`, as far as it goes."""
    first, last = F.floor(start / cut["size"]).cast("int"), F.floor(F.greatest(start, end - 1) / cut["size"]).cast("int")
    around = F.array_join(F.slice(cut["pieces"], first + 1, last - first + 1), "")
    return F.substring(around, start - first * cut["size"] + 1, F.greatest(F.lit(0), end - start))


def proposals(text: Column, pattern: str, present: Column) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start,end,value>>``, of texts where ``present`` holds."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    found = _let(
        F.struct(matches.alias("m"), pieces.alias("p")),
        lambda s: _let(
            F.struct(
                s["m"].alias("m"),
                _running_sums(F.zip_with(s["m"], s["p"], lambda m, p: F.coalesce(F.length(m), F.lit(0)) + F.length(p))).alias("e"),
            ),
            lambda r: F.transform(
                r["m"],
                lambda m, i: F.struct(
                    (F.get(r["e"], i) - F.length(m)).alias("start"), F.get(r["e"], i).alias("end"), m.alias("value")
                ),
            ),
        ),
    )
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(present, found).otherwise(nothing)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` have a Luhn sum that is a multiple of ten."""
    figures = F.split(F.reverse(_digits(value)), "")
    added = F.aggregate(
        F.transform(
            F.filter(figures, lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                c.cast("int") * 2 - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))
            ),
        ),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return added % 10 == 0


def mod97(value: Column) -> Column:
    """Whether ``value`` is an IBAN whose check digits are right."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    remainder = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise(
            (acc * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return remainder == 1


def _octets(value: Column) -> Column:
    """Whether all parts are 255 at most; leading zeros count for nothing."""
    return F.forall(
        F.split(value, r"\."),
        lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 2) | ((F.length(q) == 3) & (q <= F.lit("255")))),
    )


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda value: F.length(_digits(value)).between(low, high)


_RULES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "email": (EMAIL, lambda v: F.lit(True)),
    "ip": (IP, _octets),
    "card": (CARD, lambda v: _between(13, 19)(v) & luhn(v)),
    "phone": (PHONE, _between(9, 15)),
    "iban": (r"(?=[A-Z]{2}[0-9]{2})" + IBAN, mod97),
    "ssn": (SSN, lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$")),
}


#: Quick tests that a text with spans of a kind passes, before its pattern is tried.
_CHEAP: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def find_spans(text: Column) -> Column:
    """All spans of a text as ``array<struct<kind,start,end,score>>``: base kinds first, each by start.

    Null and empty texts have none. ``start`` and ``end`` count code points,
    ``end`` is exclusive. Base spans are never dropped by their score.
    """
    text = F.coalesce(text, F.lit(""))
    kinds = []
    for kind, (pattern, confirmed) in _RULES.items():
        cheap = _CHEAP.get(kind)
        present = cheap(text) & text.rlike(pattern) if cheap else text.rlike(pattern)
        found = _let(_accepted(proposals(text, pattern, present), confirmed), _scored(text, kind))
        if kind in ADDED_KINDS:
            found = F.filter(found, lambda s: s["score"] >= ACCEPT)
        kinds.append(found.cast(_SPAN))
    return F.concat(*kinds)


def _accepted(spans: Column, confirmed: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: confirmed(s["value"]))


def _scored(text: Column, kind: str) -> Callable[[Column], Column]:
    """Spans with their scores; a text without spans is not cut."""
    return lambda spans: F.when(F.size(spans) > 0, _let(_in_pieces(text), lambda cut: F.transform(spans, _scorer(cut, kind)))).otherwise(
        F.array().cast(_SPAN)
    )


def _scorer(cut: Column, kind: str) -> Callable[[Column], Column]:
    def scored(s: Column) -> Column:
        around = F.lower(_part(cut, F.greatest(F.lit(0), s["start"] - REACH), s["end"] + REACH))
        outside = F.replace(around, F.lower(s["value"]), F.lit(" "))
        more = F.when(outside.rlike(NEARBY[kind]), F.lit(NEARBY_ADDS[kind])).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(F.lit(SCORES[kind]) + more, 2).alias("score"))

    return scored


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row of ``docs``, a narrow stage without a shuffle.

    Repeated rows and null ids stay as they are; an empty table gives no rows.
    """
    return docs.select(F.col(id_col).alias("doc_id"), find_spans(F.col(text_col)).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are replaced as one.

    A span that overlaps an earlier one is swallowed by the earlier one's
    replacement. Null texts stay null.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def replaced(cut: Column, sorted_spans: Column, reach: Column) -> Column:
        """``reach`` is the furthest end of each span and those before it."""
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
        marked = F.transform(
            sorted_spans,
            lambda s, i: F.when(s["start"] >= before(i), F.concat(_part(cut, before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")),
        )
        return F.concat(F.array_join(marked, ""), _part(cut, F.element_at(reach, -1), F.length(text)))

    done = _let(
        _let(ordered, lambda o: F.struct(o.alias("o"), _running(F.transform(o, lambda s: s["end"]), lambda acc, x: F.greatest(acc, x), F.lit(0)).alias("reach"))),
        lambda s: _let(_in_pieces(text), lambda cut: replaced(cut, s["o"], s["reach"])),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
