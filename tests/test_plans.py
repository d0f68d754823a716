"""Validation, sentences, JSON and hashes of plans."""

import json
import math
import random

import pytest

from lineaframe.plans.describe import describe
from lineaframe.plans.expr import FUNCTIONS, UNITS, Call, Col, Lit, all_of, any_of, col, lit
from lineaframe.plans.plan import Agg, Limit, Plan, PlanProblem, SourceInfo, validate
from lineaframe.plans.planjson import canonical, expr_json, plan_json, read_expr, read_plan
from lineaframe.plans.types import MISSING, Field, Kind, Schema, Value, format_number, format_stamp, parse_stamp, stamp

SNAP = "5e" * 32
#: Parcels on their way.
SCHEMA = Schema.of(
    [
        Field("parcel", Kind.INTEGER, False),
        Field("sent", Kind.TIMESTAMP, False),
        Field("arrived", Kind.TIMESTAMP),
        Field("carrier", Kind.TEXT),
        Field("size", Kind.TEXT),
        Field("weight", Kind.DECIMAL),
        Field("spot", Kind.LOCATION),
    ]
)
PINNED = "e06d32a2414e766dbbc4c4992342b58b3878dc97ec4c2d6bf7359da410e9df93"
CATALOG = {SNAP: SourceInfo("Parcels", SCHEMA)}


def delays() -> Plan:
    return (
        Plan.scan(SNAP)
        .filter(any_of(col("size").is_in("letter", "box"), col("weight") < 0.5))
        .filter(col("arrived") > col("sent"))
        .map("days", (col("arrived") - col("sent")) / 86_400_000_000)
        .aggregate(["carrier"], Agg("parcels", "count"), Agg("slow", "percentile", "days", 95))
        .sort("-slow", "carrier")
        .limit(7)
    )


def problem(plan: Plan) -> str:
    with pytest.raises(PlanProblem) as e:
        validate(plan, CATALOG)
    return str(e.value)


def test_schemas_are_inferred():
    v = validate(delays(), CATALOG)
    assert v.schema == Schema.of([Field("carrier", Kind.TEXT), Field("parcels", Kind.INTEGER, False), Field("slow", Kind.DECIMAL)])
    assert v.schemas[3].find("days") == Field("days", Kind.DECIMAL, True)


# Fixed values in the tests below: the wording of sentences and problems is required.


def test_sentences():
    assert describe(validate(delays(), CATALOG)) == [
        "Start from Parcels (snapshot 5e5e5e5e5e5e5e5e).",
        'Keep only rows where size is one of "letter", "box" or weight is less than 0.5. '
        "Rows where this can't be decided because a value is missing are dropped.",
        "Keep only rows where arrived is after sent. Rows where this can't be decided because a value is missing are dropped.",
        "Add a column days: (arrived − sent) ÷ 86400000000. Dividing by zero gives a missing value.",
        "Group the rows by carrier and, for each group, compute the number of rows (as parcels) and the 95th percentile of days "
        "(the smallest value at least 95% of rows are at or below) (as slow). Missing values are left out of these calculations. "
        "Rows with a missing group value form their own group.",
        "Sort by slow (largest first), then by carrier (A to Z). Missing values count as the smallest.",
        "Keep only the first 7 rows.",
    ]


def test_more_sentences():
    scan = Plan.scan(SNAP)
    last = lambda p: describe(validate(p, CATALOG))[-1]
    assert last(scan.aggregate(["parcel"])) == "List each distinct combination of parcel."
    assert last(scan.limit(1)) == "Keep only the first row."
    assert last(scan.limit(9_876_543)) == "Keep only the first 9,876,543 rows."
    assert last(scan.project("size", "carrier", "parcel")) == "Keep only the columns size, carrier and parcel."
    assert last(scan.sort("-carrier", "sent")) == (
        "Sort by carrier (Z to A), then by sent (earliest first). Missing values count as the smallest."
    )
    assert last(scan.aggregate([], Agg("a", "max", "carrier"), Agg("b", "min", "sent"), Agg("c", "mean", "weight"))) == (
        "Summarize all rows into one: the alphabetically last carrier (as a), the earliest sent (as b) and the average of weight (as c). "
        "Missing values are left out of these calculations."
    )


def test_wording_of_times_and_negation():
    e = ~any_of(col("sent") < stamp("2024-07-01T00:00:00"), col("arrived") > stamp("2025-01-01T08:30:00"))
    assert e.words(SCHEMA) == "not (sent is before 2024-07-01 or arrived is after 2025-01-01 08:30:00)"
    assert col("sent").trunc("week").words(SCHEMA) == "the week (starting Monday) of sent"
    assert (col("spot").lat() * 2.5).words(SCHEMA) == "the latitude of spot × 2.5"


def test_problems_are_explained():
    scan = Plan.scan(SNAP)
    assert problem(scan.filter(col("carier").eq("Post"))) == 'step 1: there is no column named "carier"'
    assert problem(scan.filter(col("carrier").eq(1))) == "step 1: can't compare text with integer (eq)"
    assert problem(scan.filter(col("carrier").eq(None))) == "step 1: a bare null has no type here; use is_null to test for missing values"
    assert problem(scan.filter(col("parcel"))) == "step 1: the filter condition must be true/false, not integer"
    assert problem(scan.map("carrier", lit(1))) == 'step 1: there is already a column named "carrier"; choose another name'
    assert problem(scan.map("x", lit(None))) == "step 1: a column can't be always missing"
    assert problem(scan.aggregate(["carrier"], Agg("m", "mean", "carrier"))) == "step 1: can't take the mean of \"carrier\", a text column"
    assert problem(scan.aggregate([], Agg("n", "count", "carrier"))) == "step 1: count counts rows and takes no column; use count_non_null"
    assert problem(scan.aggregate([], Agg("n", "sum"))) == "step 1: sum needs a column"
    assert problem(scan.aggregate([], Agg("p", "percentile", "carrier", 90))) == "step 1: can't take the percentile of \"carrier\", a text column"
    assert problem(scan.aggregate([], Agg("p", "percentile", "parcel", 100))) == "step 1: a percentile's p must be a whole number from 1 to 99, not 100"
    assert problem(scan.aggregate(["spot"])) == 'step 1: can\'t group by the location column "spot"'
    assert problem(scan.sort("spot")) == 'step 1: can\'t sort by the location column "spot"'
    assert problem(scan.aggregate(["carrier"], Agg("carrier", "count"))) == 'step 1: the column name "carrier" is used twice'
    assert problem(scan.map("x", col("sent") + col("arrived"))) == "step 1: can't add timestamp and timestamp"
    assert problem(scan.filter(col("parcel") >= math.nan)) == "step 1: NaN is not a usable number"
    assert problem(Plan.scan("01" * 32)) == f"step 0: snapshot {'01' * 32} is not loaded"
    assert problem(Plan(scan.limit(5).steps, 0)) == "step 1: this step doesn't lead to the output"
    assert problem(Plan((Limit(0, 1),), 0)) == "step 0: reads step 0, which doesn't come before it"
    assert problem(Plan((), 0)) == "the plan has no steps"
    assert problem(Plan(scan.steps, 3)) == "the output step 3 doesn't exist"


def test_json_round_trip():
    assert read_plan(json.dumps(plan_json(delays()))) == delays()
    every = Plan.scan(SNAP).project("size").aggregate(["size"], Agg("p", "percentile", "size", 7)).sort("size").limit(2**63)
    assert read_plan(plan_json(every)) == every


def test_json_is_strict():
    def bad(change) -> str:
        x = plan_json(delays())
        change(x)
        with pytest.raises(PlanProblem) as e:
            read_plan(x)
        return str(e.value)

    assert bad(lambda x: x["nodes"][6].update(extra=1)) == 'step 6: unexpected key "extra"'
    assert bad(lambda x: x["nodes"][6].pop("count")) == 'step 6: missing key "count"'
    assert bad(lambda x: x["nodes"][6].update(count="010")) == 'step 6: "010" is not a row count'
    assert bad(lambda x: x.update(format="lineaframe-plan/2")) == 'unsupported plan format "lineaframe-plan/2"'
    assert bad(lambda x: x["nodes"][0].update(op="join")) == 'step 0: unknown op "join"'
    assert bad(lambda x: x["nodes"][4]["aggregates"][0].update(p=5)) == 'step 4: unexpected key "p"'
    assert bad(lambda x: x["nodes"][4]["aggregates"][0].update(fn="mode")) == 'step 4: unknown aggregate "mode"'
    assert bad(lambda x: x["nodes"][5]["keys"][0].update(order="up")) == 'step 5: sort order must be asc or desc, not "up"'
    for text, message in [
        ({"call": "eq", "args": [{"column": "a"}]}, "eq takes 2 argument(s), got 1"),
        ({"literal": {"i64": "01"}}, '"01" is not an integer'),
        ({"literal": {"i64": str(2**63)}}, f'"{2**63}" is not an integer'),
        ({"literal": {"date": "x"}}, 'unknown literal type "date"'),
        ({"call": "upper", "args": []}, 'unknown function "upper"'),
        ({"call": "date_trunc", "args": [{"column": "a"}], "unit": "hour"}, 'unknown time unit "hour"'),
    ]:
        with pytest.raises(PlanProblem, match="^" + __import__("re").escape(message) + "$"):
            read_expr(text)


def test_hashes():
    base = validate(delays(), CATALOG)
    assert base.plan_hash == PINNED  # a change here means that stored plan hashes no longer hold
    steps = delays().steps
    variants = [
        delays().limit(7),
        Plan((*steps[:6], Limit(5, 8)), 6),
        Plan(steps[:5], 4).sort("slow", "carrier").limit(7),
        Plan(steps[:3], 2).map("days", (col("arrived") - col("sent")) / 86_400_000_000.0),
    ]
    assert base.plan_hash not in {validate(v, CATALOG).plan_hash for v in variants}
    assert validate(delays().limit(3), CATALOG).hashes[:7] == base.hashes


def test_canonical_json():
    assert canonical({"b": 1, "a": [1.0, -0.0, 1e21, 1.5e-7, "é\n"], "\U0001f600": None, "דּ": True}) == (
        '{"a":[1,0,1e+21,1.5e-7,"é\\n"],"b":1,"\U0001f600":null,"דּ":true}'
    )
    with pytest.raises(ValueError):
        canonical(2**53 + 1)
    for x in [0.1, 123456789.125, 1e20, 123e-20, 5e-324, 1.7976931348623157e308, -2.5]:
        assert float(format_number(x)) == x


def test_stamps():
    assert parse_stamp("1970-01-01T00:00:00") == 0
    assert parse_stamp("2024-02-29T12:00:00.5") == parse_stamp("2024-02-29T12:00:00.500000")
    for bad in ["2024-02-30T00:00:00", "2024-1-01T00:00:00", "2024-01-01T00:00:60", "2024-01-01", "2024-01-01T00:00:00.", "2024-01-01T00:00:00Z"]:
        assert parse_stamp(bad) is None
    rng = random.Random(3)
    for _ in range(200):
        t = rng.randrange(-62_135_596_800_000_000, 253_402_300_799_000_000)
        assert parse_stamp(format_stamp(t)) == t


def random_value(rng):
    return rng.choice(
        [MISSING, Value(Kind.BOOLEAN, rng.random() < 0.5), Value(Kind.INTEGER, rng.randrange(-(2**63), 2**63)),
         Value(Kind.DECIMAL, rng.gauss(0, 1e6)), Value(Kind.TEXT, chr(rng.randrange(32, 0x2FFF))), Value(Kind.TIMESTAMP, rng.randrange(10**15))]
    )


def random_expr(rng, depth=4):
    if depth == 0 or rng.random() < 0.3:
        return Col(rng.choice("abc")) if rng.random() < 0.5 else Lit(random_value(rng))
    fn = rng.choice(sorted(FUNCTIONS))
    n = FUNCTIONS[fn].arity or rng.randrange(1, 4)
    args = tuple(random_expr(rng, depth - 1) for _ in range(n))
    values = tuple(random_value(rng) for _ in range(rng.randrange(1, 4))) if fn == "in" else ()
    return Call(fn, args, values=values, unit=rng.choice(sorted(UNITS)) if fn == "date_trunc" else None)


def test_any_expression_survives_canonical_json():
    rng = random.Random(11)
    for _ in range(300):
        e = random_expr(rng)
        assert read_expr(json.loads(canonical(expr_json(e)))) == e
