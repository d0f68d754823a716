"""Named questions about service requests, each a plan; and what is read out of their answers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from lineaframe.plans.expr import Call, Col, Expr, col
from lineaframe.plans.plan import Agg, Filter, Key, Plan

HOUR = 3_600_000_000
#: Percentile shown as "9 in 10 were closed within", and least number of closed requests to show it.
SLOW_P, SLOW_LEAST = 90, 10
#: Groups with fewer closed requests are not ranked.
MIN_RANKED = 20
#: Boroughs, greatest district number, columns of areas, and orders of lists.
BOROUGHS = ("BRONX", "BROOKLYN", "MANHATTAN", "QUEENS", "STATEN ISLAND")
MAX_DISTRICT = 18
AREA_COLUMNS = {"borough": "borough", "district": "community_board", "town": "town"}
ORDERS = {
    "slowest": (Key("hours_to_close", True),),
    "fastest": (Key("hours_to_close"),),
    "recent": (Key("created_date", True),),
}
_TIMES = (Agg("complaints", "count"), Agg("median_hours", "median", "hours_to_close"), Agg("p90_hours", "percentile", "hours_to_close", SLOW_P))


@dataclass(frozen=True)
class Area:
    """``kind``: city, borough, district or town."""

    kind: str = "city"
    value: str | None = None


@dataclass(frozen=True)
class Question:
    type: str | None = None
    area: Area = Area()


def complaints(snapshot: str, q: Question) -> Plan:
    plan = Plan.scan(snapshot)
    if q.type:
        plan = plan.filter(col("complaint_type").eq(q.type))
    if q.area.kind != "city":
        plan = plan.filter(col(AREA_COLUMNS[q.area.kind]).eq(q.area.value))
    return plan


def closed(snapshot: str, q: Question) -> Plan:
    """Closed requests with their hours; those closed before they were made go in a step of their own."""
    hours = (col("closed_date") - col("created_date")) / HOUR
    return complaints(snapshot, q).filter(~col("closed_date").is_null()).filter(col("closed_date") >= col("created_date")).map("hours_to_close", hours)


def wait(snapshot: str, q: Question) -> Plan:
    return closed(snapshot, q).aggregate([], *_TIMES)


def towns(snapshot: str, type: str | None = None) -> Plan:
    return closed(snapshot, Question(type)).aggregate(["town"], *_TIMES).sort("-median_hours")


def town_list(snapshot: str) -> Plan:
    return Plan.scan(snapshot).aggregate(["town"], Agg("n", "count")).sort("-n", "town")


def compare(snapshot: str, type: str | None = None, borough: str | None = None) -> Plan:
    """Districts of a borough, or boroughs, slowest first."""
    area = Area("borough", borough) if borough else Area()
    group = "community_board" if borough else "borough"
    return closed(snapshot, Question(type, area)).aggregate([group], *_TIMES).sort("-median_hours")


def counts(snapshot: str, q: Question) -> Plan:
    return complaints(snapshot, q).aggregate([], Agg("filed", "count"), Agg("closed", "count_non_null", "closed_date"))


def listing(snapshot: str, q: Question, order: str, n: int) -> Plan:
    if order not in ORDERS:
        raise ValueError(f"unknown order {order}")
    return closed(snapshot, q).sort(*ORDERS[order], Key("unique_key")).limit(n)


def by_key(snapshot: str, key: str | int) -> Plan:
    """One row whose trace is the row with this number."""
    if not re.fullmatch(r"[0-9]{1,18}", str(key)):
        raise ValueError(f'"{key}" is not a complaint number')
    return Plan.scan(snapshot).filter(col("unique_key").eq(int(key))).aggregate([], Agg("n", "count"))


def faster(snapshot: str, q: Question, hours: float) -> Plan:
    return closed(snapshot, q).filter(col("hours_to_close") < float(hours)).aggregate([], Agg("n", "count"))


def top_types(snapshot: str, n: int) -> Plan:
    present = Plan.scan(snapshot).filter(~col("complaint_type").is_null())
    return present.aggregate(["complaint_type"], Agg("n", "count")).sort("-n", "complaint_type").limit(n)


def districts(snapshot: str) -> Plan:
    return Plan.scan(snapshot).aggregate(["community_board"], Agg("n", "count")).sort("community_board")


def parse_district(code: str | None) -> tuple[str, int] | None:
    """``04 BRONX`` as ``("BRONX", 4)``; None for anything that is not a district."""
    found = re.fullmatch(r"([0-9]{2}) (.+)", code or "")
    if not found or found[2] not in BOROUGHS or not 1 <= int(found[1]) <= MAX_DISTRICT:
        return None
    return found[2], int(found[1])


def question_for(record: dict) -> Question:
    """The question a request belongs to: its type, in its district, else its borough, else the city."""
    if parse_district(record.get("community_board")):
        area = Area("district", record["community_board"])
    elif record.get("borough") in BOROUGHS:
        area = Area("borough", record["borough"])
    else:
        area = Area()
    return Question(record.get("complaint_type"), area)


def _is(e: Expr, fn: str, column: str | None = None) -> bool:
    return isinstance(e, Call) and e.fn == fn and (column is None or isinstance(e.args[0], Col) and e.args[0].name == column)


def why_not_counted(plan: Plan, dropped: dict | None) -> str | None:
    """In a word, why a request is not counted: open, backwards, elsewhere or other; None if it is."""
    if dropped is None:
        return None
    step = plan.steps[dropped["step"]]
    if dropped["reason"]["kind"] == "filter" and isinstance(step, Filter):
        p = step.predicate
        if _is(p, "not") and _is(p.args[0], "is_null", "closed_date"):
            return "open"
        if _is(p, "ge", "closed_date"):
            return "backwards"
        if _is(p, "eq"):
            return "elsewhere"
    return "other"


def rank_of(rows: Sequence[Sequence], key: str, by_district: bool) -> tuple[int, int] | None:
    """Place and number of the ranked groups among rows of ``compare`` (slowest first); None if ``key`` is not ranked."""
    real = (lambda g: parse_district(g) is not None) if by_district else (lambda g: g in BOROUGHS)
    ranked = [r[0] for r in rows if r[2] is not None and r[1] >= MIN_RANKED and real(r[0])]
    return (ranked.index(key) + 1, len(ranked)) if key in ranked else None


def shown_p90(row: Sequence) -> float | None:
    """The 90th percentile of a row of ``wait``, where there are enough requests to show it."""
    return row[2] if row[0] >= SLOW_LEAST else None


def sway(contribution: dict) -> float | None:
    """How far the answer moves at most if any one request is left out."""
    top = contribution["top"][:1]
    if not top or top[0]["without"] is None or contribution["current"] is None:
        return None
    return abs(top[0]["without"] - contribution["current"])
