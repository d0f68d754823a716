"""Plans on Spark against the row interpreter: values, order, lineage, counterfactuals, contributions."""

import datetime as dt
import math
import random
import struct

import interpreter as ref
import pytest
from pyspark.sql import functions as F

from lineaframe.engine import Engine
from lineaframe.functions import aggregates
from lineaframe.operators import counterfactual
from lineaframe.operators.counterfactual import contributions, exclude
from lineaframe.operators.execution import execute
from lineaframe.operators.lineage import Lineage
from lineaframe.plans.expr import Call, Lit, all_of, any_of, col, lit
from lineaframe.plans.plan import Agg, Plan, SourceInfo, validate
from lineaframe.plans.types import Field, Kind, Schema, Value, stamp
from lineaframe.sources.tables import RID, Table, from_dataframe

SNAP = "5a" * 32
SCHEMA = Schema.of(
    [Field("k", Kind.INTEGER, False), Field("x", Kind.INTEGER), Field("f", Kind.DECIMAL), Field("t", Kind.TIMESTAMP, False), Field("u", Kind.TIMESTAMP),
     Field("s", Kind.TEXT), Field("b", Kind.BOOLEAN), Field("g", Kind.LOCATION)]
)
INFO = SourceInfo("test rows", SCHEMA)
CATALOG = {SNAP: INFO}
T0 = (dt.datetime(2024, 1, 1) - ref.EPOCH) // dt.timedelta(microseconds=1)


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def random_rows(rng, n):
    def maybe(x):
        return None if rng.random() < 0.2 else x

    return [
        {
            "k": rng.randrange(-5, 5), "x": maybe(rng.randrange(-20, 20)),
            "f": maybe(rng.choice([0.0, -0.0, 0.5, -1.25, 3.0, 7.0, 1e308, -1e308, 2.5e-7])),
            "t": T0 + rng.randrange(400) * ref.DAY + rng.randrange(ref.DAY), "u": maybe(T0 + 30 * ref.DAY + rng.randrange(-3, 4) * ref.DAY),
            "s": maybe(rng.choice(["", "A", "B", "b", "Noise", "Ñ"])), "b": maybe(rng.random() < 0.5),
            "g": maybe((f32(rng.uniform(40.5, 40.9)), f32(rng.uniform(-74.2, -73.7)))),
        }
        for _ in range(n)
    ]


def table_of(spark, rows):
    def wall(t):
        return None if t is None else ref.EPOCH + dt.timedelta(microseconds=t)

    data = [(i, r["k"], r["x"], r["f"], wall(r["t"]), wall(r["u"]), r["s"], r["b"], r["g"]) for i, r in enumerate(rows)]
    kind = "_rid bigint, c0 bigint, c1 bigint, c2 double, c3 timestamp_ntz, c4 timestamp_ntz, c5 string, c6 boolean, c7 struct<lat:float,lon:float>"
    return Table(INFO, spark.createDataFrame(data, kind).repartition(3))


def plain(x):
    if isinstance(x, dt.datetime):
        return (x - ref.EPOCH) // dt.timedelta(microseconds=1)
    return tuple(x) if isinstance(x, tuple) else x


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300)
    return a == b and type(a) is type(b)


def numeric(rng):
    pick = rng.randrange(6)
    simple = lambda: rng.choice([col("k"), col("x"), col("f"), lit(rng.randrange(-3, 4)), lit(rng.choice([0.5, -2.0, 0.0]))])
    if pick < 4:
        return Call(["add", "sub", "mul", "div"][pick], (simple(), simple()))
    return col("u") - col("t") if pick == 4 else col("g").lat()


def boolean(rng, depth=2):
    pick = rng.randrange(9 if depth else 6)
    cmp = lambda a, b: Call(rng.choice(["eq", "ne", "lt", "le", "gt", "ge"]), (a, b))
    if pick == 0:
        return cmp(rng.choice([col("k"), col("x"), col("f")]), rng.choice([col("x"), col("f"), lit(1), lit(0.5)]))
    if pick == 1:
        return cmp(col("s"), lit(rng.choice(["A", "b", "", "Ñ"])))
    if pick == 2:
        return cmp(col("t"), rng.choice([col("u"), Lit(stamp("2024-02-01T00:00:00"))]))
    if pick == 3:
        return col(rng.choice("xfusbg")).is_null()
    if pick == 4:
        return col("s").is_in("A", "Noise") if rng.random() < 0.5 else col("x").is_in(1, 2.0, -3, 4.5)
    if pick == 5:
        return col("b")
    if pick == 6:
        return ~boolean(rng, depth - 1)
    return (all_of if pick == 7 else any_of)(boolean(rng, depth - 1), boolean(rng, depth - 1))


def random_plan(rng):
    plan, made = Plan.scan(SNAP), 0
    for _ in range(rng.randrange(4)):
        pick = rng.randrange(11)
        if pick < 3:
            plan = plan.filter(boolean(rng))
        elif pick < 5:
            plan, made = plan.map(f"m{made}", numeric(rng)), made + 1
        elif pick < 6:
            plan, made = plan.map(f"m{made}", col("t").trunc(rng.choice(["day", "week", "month", "year"]))), made + 1
        elif pick < 7:
            plan, made = plan.map(f"m{made}", boolean(rng)), made + 1
        elif pick < 9:
            plan = plan.sort(*rng.sample(["k", "-k", "x", "-f", "s", "-u", "b"], 2))
        elif pick < 10:
            plan = plan.limit(rng.randrange(30))
        elif rng.random() < 0.5:
            plan = plan.limit(2**40)
    if rng.random() < 0.6:
        keys = rng.sample(["s", "b", "x", "k", "f", "u"], rng.randrange(3))
        choices = [
            Agg("a0", "count"), Agg("a1", "count_non_null", "g"), Agg("a2", "sum", "x"), Agg("a3", "mean", "x"), Agg("a4", "median", "f"),
            Agg("a5", "min", "t"), Agg("a6", "max", "s"), Agg("a7", "min", "b"), Agg("a8", "percentile", "x", rng.randrange(1, 100)),
            Agg("a9", "percentile", "u", 50), Agg("a10", "median", "x"), Agg("a11", "max", "f"),
        ]
        aggs = rng.sample(choices, rng.randrange(0 if keys else 1, 4))
        plan = plan.aggregate(keys, *aggs)
        if aggs and rng.random() < 0.5:
            plan = plan.sort(rng.choice(["", "-"]) + aggs[0].name)
        if rng.random() < 0.3:
            plan = plan.limit(rng.randrange(6))
    elif rng.random() < 0.5:
        plan = plan.project("s", "k", "t")
    return plan


def outcome(execution):
    return [tuple(plain(x) for x in row) for row in execution.result().collect()]


@pytest.mark.parametrize("seed", range(16))
def test_random_plans_agree_with_the_interpreter(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.randrange(41))
    valid = validate(random_plan(rng), CATALOG)
    want = ref.run(valid, rows)
    execution = execute(valid, table_of(spark, rows), gather_bytes=(0 if seed % 2 else 1 << 40))
    got = outcome(execution)
    expected = [tuple(r[n] for n in valid.schema.names) for r, _ in want[-1]]
    assert len(got) == len(expected) and all(same(a, b) for g, e in zip(got, expected, strict=True) for a, b in zip(g, e, strict=True)), (got, expected)
    assert execution.row_counts() == [len(s) for s in want]
    lineage = Lineage(execution)
    if got:
        place = rng.randrange(len(got))
        trace = lineage.backward_row(valid.output, place)
        assert {r[RID] for r in trace.source.collect()} == set(want[-1][place][1])
        assert len(trace.path) == len(valid.steps)
    if rows:
        source = rng.randrange(len(rows))
        reached = [i for i, (_, s) in enumerate(want[-1]) if source in s]
        assert lineage.place(valid.output, lineage.forward([source])) == (reached[0] if reached else None)


CF_AGGS = [
    Agg("n", "count"), Agg("c", "count_non_null", "x"), Agg("sx", "sum", "x"), Agg("mx", "mean", "x"), Agg("md", "median", "x"), Agg("mf", "median", "f"),
    Agg("lo", "min", "x"), Agg("hi", "max", "f"), Agg("p", "percentile", "x", 40), Agg("q", "percentile", "t", 90), Agg("sf", "sum", "f"),
]


def cf_rows(rng, n):
    return [
        {"k": rng.randrange(3), "x": None if rng.random() < 0.2 else rng.randrange(-5, 6), "f": None if rng.random() < 0.2 else rng.choice([0.1, 0.2, 0.3, 1e16, -1e16, 2.5, -0.0]),
         "t": rng.randrange(1_000_000), "u": None, "s": rng.choice([None, "A", "B", "C"]), "b": None, "g": None}
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(6))
def test_exclude_equals_a_run_over_the_rest(spark, seed):
    rng = random.Random(100 + seed)
    rows = cf_rows(rng, rng.randrange(1, 30))
    plan = Plan.scan(SNAP)
    if rng.random() < 0.5:
        plan = plan.filter(col("x") > -3)
    if rng.random() < 0.3:
        plan = plan.sort("-k")
    if rng.random() < 0.3:
        plan = plan.limit(rng.randrange(12))
    keys = rng.sample(["s", "k"], rng.randrange(3))
    plan = plan.aggregate(keys, *rng.sample(CF_AGGS, 3))
    if rng.random() < 0.5:
        plan = plan.limit(2)
    valid = validate(plan, CATALOG)
    table = table_of(spark, rows)
    gone = [rng.randrange(32) for _ in range(rng.randrange(6))]
    base = execute(valid, table, exact_order=True)
    found = exclude(base, gone, exact_order=True)
    again = execute(valid, table, sorted(set(gone)), exact_order=True)
    assert repr(outcome(found.execution)) == repr(outcome(again)), (found.method, gone)
    alive = [r for i, r in enumerate(rows) if i not in gone]
    want = [tuple(r[n] for n in valid.schema.names) for r, _ in ref.run(valid, alive)[-1]]
    assert all(same(a, b) for g, e in zip(outcome(found.execution), want, strict=True) for a, b in zip(g, e, strict=True))
    shape = {"filter", "sort", "aggregate"}
    if not gone:
        assert found.method == {"kind": "unchanged"}
    elif "limit" in [type(s).__name__.lower() for s in valid.steps[: [type(s).__name__ for s in valid.steps].index("Aggregate")]]:
        assert found.method == {"kind": "rerun"}
    else:
        assert found.method["kind"] in ("incremental", "unchanged") and shape


@pytest.mark.parametrize("seed", range(2))
def test_contributions_equal_single_exclusions(spark, seed):
    rng = random.Random(200 + seed)
    rows = cf_rows(rng, rng.randrange(1, 14))
    valid = validate(Plan.scan(SNAP).aggregate(["k"] if seed % 2 else [], *CF_AGGS), CATALOG)
    base = execute(valid, table_of(spark, rows))
    groups = ref.run(valid, rows)[-1]
    place = rng.randrange(len(groups))
    members = sorted(groups[place][1])
    for agg in CF_AGGS[seed % 2 :: 2] + CF_AGGS[4:5]:
        found = contributions(base, place, agg.name)
        got = {r["source_row"]: r for r in found.rows.collect()}
        assert sorted(got) == members
        assert found.exact == (agg.name not in ("sf",))
        for m in members:
            rest = [rows[i] for i in members if i != m]
            kind = SCHEMA.find(agg.column).kind if agg.column else None
            want = ref.aggregate(agg, rest, kind)
            value = plain(got[m]["without"])
            assert got[m]["removes_group"] == (seed % 2 == 1 and len(members) == 1)
            if agg.name == "sf":
                scale = sum(abs(rows[i]["f"] or 0) for i in members)
                assert (value is None) == (want is None) and (want is None or abs(value - want) <= 4 * (len(members) + 2) * 2.3e-16 * scale)
            else:
                assert same(value, want), (agg, m, value, want)


def test_group_vanishes_and_limit_pulls_rows_in(spark):
    rows = [{"k": i, "x": i, "f": None, "t": i, "u": None, "s": "A" if i % 2 == 0 else "B", "b": None, "g": None} for i in range(10)]
    table = table_of(spark, rows)
    base = execute(validate(Plan.scan(SNAP).aggregate(["s"], Agg("n", "count")), CATALOG), table)
    found = exclude(base, [0, 2, 4, 6, 8, 99])
    assert outcome(found.execution) == [("B", 5)] and found.method == {"kind": "incremental", "groups_recomputed": 1}
    limited = execute(validate(Plan.scan(SNAP).limit(3).aggregate([], Agg("n", "count")), CATALOG), table)
    found = exclude(limited, [0])
    assert outcome(found.execution) == [(3,)] and found.method == {"kind": "rerun"}


def test_exact_numbers(spark):
    big = 2**53 + 1
    rows = [{"k": k, "x": x, "f": f, "t": 0, "u": None, "s": None, "b": None, "g": None}
            for k, x, f in [(0, big, float(2**53)), (1, 2**63 - 1, 2.0**63), (2, -(2**63), -(2.0**63)), (3, 3, 3.0), (4, None, 1.0), (5, 6, None), (6, -2, -1.5), (7, big, 1e308)]]
    plan = Plan.scan(SNAP)
    for fn in ("eq", "ne", "lt", "le", "gt", "ge"):
        plan = plan.map(fn, Call(fn, (col("x"), col("f")))).map("r" + fn, Call(fn, (col("f"), col("x"))))
    valid = validate(plan.project(*[p + fn for fn in ("eq", "ne", "lt", "le", "gt", "ge") for p in ("", "r")]), CATALOG)
    got = outcome(execute(valid, table_of(spark, rows)))
    assert got == [tuple(r[n] for n in valid.schema.names) for r, _ in ref.run(valid, rows)[-1]]


def test_sum_overflows_only_in_the_total(spark):
    rows = [{"k": i, "x": x, "f": None, "t": 0, "u": None, "s": None, "b": None, "g": None} for i, x in enumerate([2**63 - 1, 2**63 - 1, -(2**63), -5])]
    engine = Engine(spark)
    engine.register(SNAP, table_of(spark, rows))
    total = engine.run(Plan.scan(SNAP).aggregate([], Agg("s", "sum", "x"), Agg("m", "mean", "x")))
    assert total["output"]["rows"] == [[str(2**63 - 7), (2**63 - 7) / 4]]
    failed = engine.run(Plan.scan(SNAP).limit(2).aggregate([], Agg("s", "sum", "x")))
    assert failed == {"ok": False, "error": f"the sum {2**64 - 2} doesn't fit in a 64-bit integer", "step": 2}
    # a column that nobody reads, and a condition that a false one precedes, are evaluated all the same
    failed = engine.run(Plan.scan(SNAP).map("y", (col("x") - 1) + 2).project("k"))
    assert failed == {"ok": False, "error": f"{-(2**63)} sub 1 overflows a 64-bit integer (row 2)", "step": 1}
    failed = engine.run(Plan.scan(SNAP).sort("-k").filter(all_of(col("k") < 0, (col("x") - 1) < 0)).aggregate([], Agg("n", "count")))
    assert failed == {"ok": False, "error": f"{-(2**63)} sub 1 overflows a 64-bit integer (row 1)", "step": 2}


def test_engine_end_to_end(spark):
    engine = Engine(spark)
    events = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1 + i % 5, i % 24), ["click", "view", None][i % 3], float(i) if i % 4 else None) for i in range(60)],
        "event_id bigint, ts timestamp_ntz, kind string, value double",
    )
    engine.register(SNAP, from_dataframe(events, "events", "event_id"))
    plan = Plan.scan(SNAP).filter(col("value") > 5).aggregate(["kind"], Agg("n", "count"), Agg("med", "median", "value")).sort("-n", "kind").limit(2)
    run = engine.run(plan)
    assert run["ok"] and run["steps"][0]["rows"] == 60 and run["output"]["total_rows"] == 2
    for place in range(2):
        back = engine.trace_back(run["execution"], place)
        assert back["source_rows"] == run["output"]["rows"][place][1] == len(list(engine.trace_back_rows(run["execution"], place)))
    ids = list(engine.trace_back_rows(run["execution"], 0))
    records = engine.source_records(SNAP, ids[:3][::-1])
    assert [r[0] for r in records["rows"]] == ids[:3][::-1]
    undecided = engine.trace_forward(run["execution"], 4)
    assert undecided["dropped"]["reason"] == {"kind": "filter", "value": None} and undecided["path"] == [{"step": 0, "row": 4}]
    assert engine.trace_forward(run["execution"], 3)["dropped"]["reason"] == {"kind": "filter", "value": False}
    kept = engine.trace_forward(run["execution"], ids[0])
    assert kept["reaches_output"] and kept["output_row"] == 0
    everywhere = {i for place in range(2) for i in engine.trace_back_rows(run["execution"], place)}
    cut = next(i for i in range(60) if i % 4 and i > 5 and i not in everywhere)
    assert engine.trace_forward(run["execution"], cut)["dropped"]["reason"] == {"kind": "limit", "position": 2, "count": "2"}
    one = engine.exclude(run["execution"], ids[:2])
    both = engine.exclude(one["execution"], ids[2:4])
    assert both["output"]["rows"] == engine.exclude(run["execution"], ids[:4])["output"]["rows"] and both["excluded"] == 4
    assert one["steps"][0]["rows"] == 60  # incremental: steps below the aggregate are the base's
    assert engine.trace_forward(one["execution"], ids[0])["dropped"]["reason"] == {"kind": "excluded"}
    assert set(engine.trace_back_rows(one["execution"], 0)).isdisjoint(ids[:2])
    moved = engine.contributions(run["execution"], 0, "med", 5)
    uncut = engine.run(Plan(plan.steps[:3], 2))
    fresh = engine.exclude(uncut["execution"], [moved["top"][0]["source_row"]])["output"]["rows"]
    assert moved["top"][0]["without"] in [r[2] for r in fresh]
    with pytest.raises(ValueError, match='"kind" is not an aggregate of step 2'):
        engine.contributions(run["execution"], 0, "kind", 5)
    with pytest.raises(ValueError, match="row 60 is past the snapshot's 60 rows"):
        engine.trace_forward(run["execution"], 60)
    assert engine.rows(run["execution"], 1, 5) == run["output"]["rows"][1:]
    assert engine.drop_execution(run["execution"]) and not engine.drop_execution(run["execution"])
    with pytest.raises(ValueError, match="was dropped"):
        engine.exclude(one["execution"], [1])
    assert engine.run({"format": "x"}) == {"ok": False, "error": 'missing key "nodes"', "step": None}
    assert engine.validate_plan(plan)["steps"][4]["op"] == "limit"


def test_order_statistics_inside_a_bracket(spark, monkeypatch):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 100), 7.0, -7.0]) for _ in range(800)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(4)
    want = sorted(values)
    ranks = [0, 1, 399, 400, 798, 799, 800, -1]
    expected = [want[r] if 0 <= r < 800 else None for r in ranks]
    assert counterfactual.order_values(rows, "v", ranks, 800) == expected
    monkeypatch.setattr(counterfactual, "SKETCH", 20)
    monkeypatch.setattr(counterfactual, "SORTED_AT_ONCE", 100)
    for some in ([0, 1], [399, 400], [798, 799], [600]):
        assert counterfactual.order_values(rows, "v", some, 800) == [want[r] for r in some]


@pytest.mark.parametrize("sketch", [40, 10_000])
def test_statistics_of_a_hot_group(spark, monkeypatch, sketch):
    """Most rows have one key; found by brackets, grouped and over all rows, they equal the gathered ones."""
    monkeypatch.setattr(aggregates, "SKETCH", sketch)
    rows = spark.range(6000, numPartitions=5).select(
        F.when(F.col("id") % 5 > 0, "hot").when(F.col("id") % 35 > 0, F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("s"),
        F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 1009).alias("x"),
        (F.col("id") * 104729 % 6007 / 7.0).alias("f"),
        F.timestamp_add("SECOND", F.col("id") * 31 % 4001, F.lit("2024-01-01").cast("timestamp_ntz")).alias("t"),
    )
    table = from_dataframe(rows.withColumn("n", F.monotonically_increasing_id()), "rows", "n")
    wanted = [Agg("n", "count")] + [Agg(f"{c}{p}", "percentile", c, p) for c in "xft" for p in (1, 37, 50, 99)] + [Agg("mx", "median", "x"), Agg("mf", "median", "f")]
    for keys in (["s"], []):
        plan = validate(Plan.scan(SNAP).aggregate(keys, *wanted), {SNAP: table.info})
        gathered, bracketed = (execute(plan, table, gather_bytes=g).result().collect() for g in (1 << 40, 0))
        assert sorted(map(tuple, gathered), key=repr) == sorted(map(tuple, bracketed), key=repr) and len(gathered) == (12 if keys else 1)


def test_stored_rows_keep_their_numbers(spark, tmp_path):
    """However Spark splits the files, and also where there is one."""
    spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(4).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/four")
    spark.range(3000).select(F.col("id").alias("v")).coalesce(1).write.parquet(f"{tmp_path}/one")
    for name in ("four", "one"):
        found = []
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            table = from_dataframe(spark.read.parquet(f"{tmp_path}/{name}"), "t", as_stored=True)
            found.append(sorted((r["c0"], r[RID]) for r in table.df.collect()))
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert found[0] == found[1] and len({n for _, n in found[0]}) == len(found[0])
    assert found[0] == [(i, i) for i in range(3000)]
    other = from_dataframe(spark.range(9).select((9 - F.col("id")).alias("v")), "t", as_stored=True)
    assert sorted(tuple(r) for r in other.df.collect()) == [(i, i + 1) for i in range(9)]


def test_rows_are_numbered_densely(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("A.b"))
    table = from_dataframe(df, "numbers", order=["v"])
    assert [r[0] for r in table.df.where("c0 != _rid").collect()] == []
    assert table.df.count() == 1000 and table.schema.names == ["v", "A.b"]
    assert Value(Kind.DECIMAL, -0.0) != Value(Kind.DECIMAL, 0.0)
