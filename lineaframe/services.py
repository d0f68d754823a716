"""Queries of the engine's calls, the plan services, cleaning and snapshots, and the same in DuckDB SQL.

Calls answer with dictionaries and sentences; each entry lays them out as rows.
Where an answer is fixed wording, the SQL is a list of the sentences.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable, Sequence
from contextlib import redirect_stderr, redirect_stdout
from dataclasses import asdict
from io import StringIO
from itertools import islice
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaframe import catalogue, questions
from lineaframe.catalogue import SNAP
from lineaframe.engine import Engine
from lineaframe.operators.counterfactual import Refused, contributions
from lineaframe.operators.execution import execute, predicate_value
from lineaframe.operators.lineage import Lineage
from lineaframe.plans.expr import col, lit
from lineaframe.plans.plan import Agg, Plan, validate
from lineaframe.plans.planjson import canonical, plan_json, read_plan
from lineaframe.plans.types import stamp
from lineaframe.sources import cli, raw, snapshot
from lineaframe.sources.clean import Cleaned, clean, known_issues, read_time
from lineaframe.sources.fetch import HttpError, Retry, fetch_seeclickfix, fetch_socrata, flattened, metadata_of, utc_text
from lineaframe.sources.spec import NYC_311, WESTCHESTER, Drift, Scope, check_metadata
from lineaframe.sources.tables import RID, Table, from_dataframe
from lineaframe.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

S = Plan.scan(SNAP)
#: Clicks and views by type, with their hours of the day.
HOURS = catalogue._HOURS
_HOUR = catalogue._HOUR_SQL
_KEPT = "event_type IN ('click', 'view')"


def _values(rows: Sequence[Sequence[object]], *names: str) -> str:
    """A list of rows as SQL."""

    def shown(x: object) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def _engine(spark: SparkSession, sf_dir: str, name: str = "events") -> Engine:
    engine = Engine(spark)
    engine.register(SNAP, catalogue.table(spark, sf_dir, name))
    return engine


# ---- the engine's calls


def engine_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output rows that a run returns, as they go into JSON."""
    answer = _engine(spark, sf_dir).run(HOURS)
    names = "event_type string, n bigint, s bigint, m double, med double, p90 double, lo string, hi double"
    assert [c["name"] for c in answer["output"]["columns"]] == [n.split()[0] for n in names.split(", ")]
    return spark.createDataFrame([tuple(r) for r in answer["output"]["rows"]], names)


def engine_step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every step of a run."""
    answer = _engine(spark, sf_dir).run(json.loads(json.dumps(plan_json(HOURS))))
    return spark.createDataFrame([(i, s["rows"]) for i, s in enumerate(answer["steps"])], "step bigint, n bigint")


def engine_rows_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 20 to 29 of a sorted output."""
    engine = _engine(spark, sf_dir)
    run = engine.run(S.sort("-value").project("event_id", "value"))
    return spark.createDataFrame([tuple(r) for r in engine.rows(run["execution"], 20, 10)], "event_id bigint, value double")


def engine_trace_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each step stand behind each output row."""
    engine = _engine(spark, sf_dir)
    run = engine.run(HOURS)
    found = [(row, p["step"], p["rows"]) for row in (0, 1) for p in engine.trace_back(run["execution"], row)["path"]]
    return spark.createDataFrame(found, "output_row bigint, step bigint, n bigint")


def engine_trace_back_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows behind the second output row, in order, by their place in that order."""
    engine = _engine(spark, sf_dir)
    run = engine.run(HOURS)
    return spark.createDataFrame(list(enumerate(engine.trace_back_rows(run["execution"], 1))), "place bigint, event_id bigint")


_TRACED = (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377)


def _traces(spark: SparkSession, engine: Engine, number: int) -> DataFrame:
    rows = []
    for row in _TRACED:
        answer = engine.trace_forward(number, row)
        dropped = answer["dropped"] or {"step": None, "reason": {}}
        reason = dropped["reason"]
        rows.append((row, answer["reaches_output"], answer["output_row"], len(answer["path"]), dropped["step"], reason.get("kind"), reason.get("position")))
    return spark.createDataFrame(rows, "event_id bigint, reaches boolean, output_row bigint, steps bigint, dropped_at bigint, reason string, position bigint")


def engine_trace_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where some source rows go, or what dropped them."""
    engine = _engine(spark, sf_dir)
    return _traces(spark, engine, engine.run(HOURS)["execution"])


def engine_trace_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where a limit drops rows by their place."""
    engine = _engine(spark, sf_dir)
    return _traces(spark, engine, engine.run(S.filter(col("event_type").ne("error")).limit(30))["execution"])


def engine_trace_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in a result without some rows."""
    engine = _engine(spark, sf_dir)
    run = engine.run(HOURS)
    without = engine.exclude(run["execution"], [r for r in _TRACED if r % 2])
    return _traces(spark, engine, without["execution"])


def engine_source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows in the order asked for."""
    found = _engine(spark, sf_dir).source_records(SNAP, [34, 3, 144])
    at = [found["columns"].index(n) for n in ("event_id", "ts", "event_type", "value")]
    return spark.createDataFrame([(i, *(r[k] for k in at)) for i, r in enumerate(found["rows"])], "place bigint, event_id bigint, ts string, event_type string, value double")


def engine_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions that build on each other: the union is excluded from the first run."""
    engine = _engine(spark, sf_dir)
    number, out = engine.run(HOURS)["execution"], []
    for turn, gone in enumerate(([], range(0, 300, 7), range(0, 300, 5), [10**9])):
        answer = engine.exclude(number, gone)
        number = answer["execution"]
        out += [(turn, answer["excluded"], answer["method"]["kind"], answer["method"].get("groups_recomputed"), *r[:3]) for r in answer["output"]["rows"]]
    return spark.createDataFrame(out, "turn bigint, excluded bigint, method string, groups bigint, event_type string, n bigint, s bigint")


def _excluded_sql() -> str:
    gone = ["false", "event_id < 300 AND event_id % 7 = 0", "event_id < 300 AND (event_id % 7 = 0 OR event_id % 5 = 0)", "event_id < 300 AND (event_id % 7 = 0 OR event_id % 5 = 0)"]
    counts = [0, len(range(0, 300, 7)), len({*range(0, 300, 7), *range(0, 300, 5)}), len({*range(0, 300, 7), *range(0, 300, 5)}) + 1]
    turns = [
        f"SELECT {i} AS turn, {n} AS excluded, '{'incremental' if n else 'unchanged'}' AS method, {f'(SELECT count(DISTINCT event_type) FROM events WHERE {_KEPT} AND {g})' if n else 'NULL'} AS groups, "
        f"event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS s FROM events WHERE {_KEPT} AND NOT ({g}) GROUP BY event_type"
        for i, (g, n) in enumerate(zip(gone, counts, strict=True))
    ]
    return " UNION ALL ".join(turns)


def engine_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that move a mean the most, and how many move it at all."""
    engine = _engine(spark, sf_dir)
    found = engine.contributions(engine.run(HOURS)["execution"], 0, "m", 5)
    rows = [(i, t["source_row"], t["without"], t["removes_group"], found["current"], found["exact"], found["contributing_rows"], found["rows_that_change_it"]) for i, t in enumerate(found["top"])]
    return spark.createDataFrame(rows, "place bigint, event_id bigint, without double, removes_group boolean, current double, exact boolean, contributing bigint, changing bigint")


def engine_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be asked of executions that were dropped, or never were."""
    engine = _engine(spark, sf_dir)
    run = engine.run(HOURS)["execution"]
    without = engine.exclude(run, [1, 2])["execution"]
    out = [("dropped", str(engine.drop_execution(run))), ("dropped again", str(engine.drop_execution(run)))]
    for name, ask in (
        ("rows", lambda: engine.rows(run, 0, 1)), ("exclude further", lambda: engine.exclude(without, [3])), ("still there", lambda: len(engine.rows(without, 0, 9))),
        ("past the output", lambda: engine.trace_back(without, 99)), ("past the table", lambda: engine.trace_forward(without, 10**9)), ("no record", lambda: engine.source_records(SNAP, [10**9])),
    ):
        try:
            out.append((name, str(ask())))
        except ValueError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "asked string, answer string")


def engine_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every kind as they go into JSON: large integers and times as text, places as pairs, missing as null."""
    engine = _engine(spark, sf_dir, "places")
    # the limit comes first: a map is evaluated over all rows that it reads, and the product overflows from row 9224 on
    big = S.limit(12).map("big", col("vec_id") * 1_000_000_000_000_000).map("small", col("vec_id").eq(3)).map("at", lit(stamp("2024-02-29T23:59:59.5")) + col("vec_id"))
    run = engine.run(big.project("vec_id", "big", "small", "at", "place"))
    rows = [(r[0], *(json.dumps(x) if i != 3 else json.dumps([round(y, 6) for y in x] if x else x) for i, x in enumerate(r[1:]))) for r in run["output"]["rows"]]
    return spark.createDataFrame(rows, "vec_id bigint, big string, small string, at string, place string")


_CELLS = """SELECT vec_id, CASE WHEN vec_id * 1000000000000000 > 9007199254740992 THEN '"' || vec_id * 1000000000000000 || '"' ELSE CAST(vec_id * 1000000000000000 AS VARCHAR) END AS big,
  CASE WHEN vec_id = 3 THEN 'true' ELSE 'false' END AS small, '"2024-02-29T23:59:59.5' || lpad(CAST(vec_id AS VARCHAR), 5, '0') || '"' AS at,
  CASE WHEN vec_id % 5 = 0 THEN 'null' ELSE '[' || round(CAST(embedding[1] AS DOUBLE), 6) || ', ' || round(CAST(embedding[2] AS DOUBLE), 6) || ']' END AS place
FROM embeddings ORDER BY vec_id LIMIT 12"""


def engine_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why plans are not valid, and at which step; overflow, which shows only in a run."""
    engine = _engine(spark, sf_dir)
    out = []
    for name, plan in PROBLEMS.items():
        answer = engine.run(plan) if name.startswith("overflow") else engine.validate_plan(plan)
        out.append((name, answer.get("step"), answer["error"]))
    return spark.createDataFrame(out, "name string, step bigint, error string")


_JSON = plan_json(S.limit(3))
PROBLEMS: dict[str, Plan | dict] = {
    "no column": S.filter(col("colour").eq("red")),
    "kinds": S.filter(col("event_type") > 4),
    "not a condition": S.filter(col("user_id")),
    "null": S.filter(col("event_type").eq(None)),
    "name taken": S.map("ts", lit(1)),
    "mean of text": S.aggregate([], Agg("m", "mean", "event_type")),
    "percentile": S.aggregate([], Agg("p", "percentile", "user_id", 0)),
    "count of a column": S.aggregate([], Agg("n", "count", "user_id")),
    "sum of times": S.map("x", col("ts") + col("ts")),
    "nothing to sort": S.sort(),
    "other snapshot": Plan.scan("f" * 64),
    "strict key": _JSON | {"extra": 1},
    "strict count": _JSON | {"nodes": [_JSON["nodes"][0], _JSON["nodes"][1] | {"count": "03"}]},
    "strict op": _JSON | {"nodes": [_JSON["nodes"][0] | {"op": "union"}]},
    "overflow": S.filter(col("event_id") < 3).map("big", col("event_id") * 2**62 * 4),
    "overflow of a sum": S.filter(col("event_id") < 3).map("big", lit(2**62)).aggregate([], Agg("s", "sum", "big")),
}
#: Fixed values here and below: the wording of problems and sentences.
_PROBLEMS_SQL = _values(
    [
        ("no column", 1, 'there is no column named "colour"'),
        ("kinds", 1, "can't compare text with integer (gt)"),
        ("not a condition", 1, "the filter condition must be true/false, not integer"),
        ("null", 1, "a bare null has no type here; use is_null to test for missing values"),
        ("name taken", 1, 'there is already a column named "ts"; choose another name'),
        ("mean of text", 1, 'can\'t take the mean of "event_type", a text column'),
        ("percentile", 1, "a percentile's p must be a whole number from 1 to 99, not 0"),
        ("count of a column", 1, "count counts rows and takes no column; use count_non_null"),
        ("sum of times", 1, "can't add timestamp and timestamp"),
        ("nothing to sort", 1, "sort needs at least one column"),
        ("other snapshot", 0, f"snapshot {'f' * 64} is not loaded"),
        ("strict key", None, 'unexpected key "extra"'),
        ("strict count", 1, '"03" is not a row count'),
        ("strict op", 0, 'unknown op "union"'),
        ("overflow", 2, f"2 mul {2**62} overflows a 64-bit integer (row 2)"),
        ("overflow of a sum", 3, f"the sum {3 * 2**62} doesn't fit in a 64-bit integer"),
    ],
    "name", "step", "error",
)


# ---- plan services


def plan_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of every step."""
    plan = (
        S.filter(col("event_type").is_in("click", "view")).filter(~(col("ts") < stamp("2024-01-02T00:00:00"))).map("share", col("value") / col("user_id"))
        .aggregate(["event_type"], Agg("n", "count"), Agg("q", "percentile", "share", 91)).sort("-q", "event_type").project("event_type", "q").limit(1)
    )
    answer = _engine(spark, sf_dir).validate_plan(plan)
    return spark.createDataFrame([(i, s["op"], s["sentence"]) for i, s in enumerate(answer["steps"])], "step bigint, op string, sentence string")


_SENTENCES_SQL = _values(
    [
        (0, "scan", "Start from events (snapshot 0000000000000000)."),
        (1, "filter", 'Keep only rows where event_type is one of "click", "view". Rows where this can\'t be decided because a value is missing are dropped.'),
        (2, "filter", "Keep only rows where not (ts is before 2024-01-02). Rows where this can't be decided because a value is missing are dropped."),
        (3, "map", "Add a column share: value ÷ user_id. Dividing by zero gives a missing value."),
        (4, "aggregate", "Group the rows by event_type and, for each group, compute the number of rows (as n) and the 91st percentile of share (the smallest value at least 91% of rows are at or below) (as q). Missing values are left out of these calculations. Rows with a missing group value form their own group."),
        (5, "sort", "Sort by q (largest first), then by event_type (A to Z). Missing values count as the smallest."),
        (6, "project", "Keep only the columns event_type and q."),
        (7, "limit", "Keep only the first row."),
    ],
    "step", "op", "sentence",
)


def plan_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each plan of the catalogue reads back from canonical JSON as it was, with the same hashes."""
    out = []
    for name, entry in catalogue.ENTRIES.items():
        info = {SNAP: catalogue.table(spark, sf_dir, entry.source).info}
        again = read_plan(canonical(plan_json(entry.plan)))
        out.append((name, again == entry.plan, validate(again, info).hashes == validate(entry.plan, info).hashes))
    return spark.createDataFrame(out, "name string, same boolean, same_hashes boolean")


def plan_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which changes of a plan change the hash of its output; steps before the change keep theirs."""
    info = {SNAP: catalogue.table(spark, sf_dir, "events").info}
    base = validate(HOURS, info)
    changed = {
        "none": HOURS,
        "a literal": S.filter(col("event_type").is_in("click", "error")),
        "one more step": HOURS.limit(10**6),
        "an integer as decimal": S.filter(col("event_type").is_in("click", "view")).map("hours", (col("ts") - col("ts").trunc("day")) / 3_600_000_000.0),
    }
    out = []
    for name, plan in changed.items():
        made = validate(plan, info)
        alike = next((i for i, (a, b) in enumerate(zip(made.hashes, base.hashes, strict=False)) if a != b), min(len(made.hashes), len(base.hashes)))
        out.append((name, made.plan_hash == base.plan_hash, alike))
    return spark.createDataFrame(out, "change string, same boolean, steps_alike bigint")


def predicate_on_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a condition says of single rows: true, false or undecided."""
    execution = catalogue.run(spark, sf_dir, "requests", S.filter(col("closed_date") >= col("created_date")))
    scan = execution.steps[0]
    rows = [(i, predicate_value(scan, execution.plan.steps[1].predicate, scan.df.where(F.col(RID) == i).select(RID))) for i in (1, 7, 11, 14, 22, 77)]
    return spark.createDataFrame(rows, "unique_key bigint, holds boolean")


def source_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one source row of an output row where all steps are one-to-one, packed with its source; none above an aggregate."""
    execution = catalogue.run(spark, sf_dir, "events", S.sort("-value").filter(col("event_type").eq("view")))
    lineage, output = Lineage(execution), execution.plan.output
    grouped = Lineage(catalogue.run(spark, sf_dir, "events", HOURS))
    found = [(i, lineage.source_row(output, i)) for i in (0, 1, 5)] + [(100, grouped.source_row(grouped.execution.plan.output, 0))]
    one = lineage.packed(lineage.backward_row(output, 5).source).first()["row_id"]
    return spark.createDataFrame([*found, (200, one)], "place bigint, event_id bigint")


def lineage_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that reaches an aggregate stands behind exactly one group: members of all groups, counted by row."""
    execution = catalogue.run(spark, sf_dir, "events", S.filter(col("value") > 10.0).aggregate(["event_type"], Agg("n", "count")))
    lineage, groups = Lineage(execution), execution.output.df.count()
    members = [lineage.backward_row(execution.plan.output, i).source for i in range(groups)]
    whole = members[0]
    for m in members[1:]:
        whole = whole.union(m)
    times = whole.groupBy(RID).agg(F.count(F.lit(1)).alias("times"))
    return times.groupBy("times").agg(F.count(F.lit(1)).alias("n"))


def _contribution_rows(plan: Plan, digits: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = contributions(catalogue.run(spark, sf_dir, "events", plan), 0, "v").rows
        return rows.select(F.col("source_row").alias("event_id"), F.round("without", digits).alias("without"))

    return query


def contrib_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that move a median the most, by their rank."""
    found = contributions(catalogue.run(spark, sf_dir, "events", HOURS), 0, "med").ranked(20).collect()
    return spark.createDataFrame([(i, r["source_row"]) for i, r in enumerate(found)], "place bigint, event_id bigint")


def contrib_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions that have no answer, and why."""
    base = S.map("late", col("value") > 50.0)
    plans = {
        "text": (base.aggregate(["user_id"], Agg("v", "min", "event_type")), "v"),
        "true or false": (base.aggregate([], Agg("v", "max", "late")), "v"),
        "two aggregates": (base.aggregate(["user_id"], Agg("n", "count")).aggregate([], Agg("v", "sum", "n")), "v"),
        "a limit": (base.limit(5).aggregate([], Agg("v", "count")), "v"),
        "a key": (base.aggregate(["event_type"], Agg("v", "count")), "event_type"),
    }
    out = []
    for name, (plan, column) in plans.items():
        try:
            contributions(catalogue.run(spark, sf_dir, "events", plan), 0, column)
            out.append((name, "answered"))
        except Refused as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "name string, why string")


_SHAPE = "contributions need a plan with one aggregate and only filter, map, project or sort before it"
_REFUSED_SQL = _values(
    [
        ("text", "contributions to the min of text or true/false values aren't supported"),
        ("true or false", "contributions to the max of text or true/false values aren't supported"),
        ("two aggregates", _SHAPE), ("a limit", _SHAPE), ("a key", '"event_type" is not an aggregate of step 2'),
    ],
    "name", "why",
)


# ---- named questions


def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read out of answers: ranks, shown percentiles, sway, why a request is not counted."""
    engine = _engine(spark, sf_dir, "requests")
    out: list[tuple] = []
    boroughs = engine.run(questions.compare(SNAP, "click"))["output"]["rows"]
    for key in (*questions.BOROUGHS, "ELSEWHERE"):
        place = questions.rank_of(boroughs, key, False)
        out.append((f"rank of {key}", None if place is None else f"{place[0]} of {place[1]}"))
    rare, common = (engine.run(questions.wait(SNAP, questions.Question(t, a)))["output"]["rows"][0] for t, a in (("none", questions.Area()), ("click", questions.Area())))
    out += [("p90 of few", str(questions.shown_p90(rare))), ("p90 of many", str(questions.shown_p90(common) is not None))]
    number = engine.run(plan := questions.wait(SNAP, questions.Question("click", questions.Area("borough", "QUEENS"))))["execution"]
    out.append(("sway", f"{questions.sway(engine.contributions(number, 0, 'median_hours', 1)):.6f}"))
    for row in range(30):
        out.append((f"request {row}", questions.why_not_counted(plan, engine.trace_forward(number, row)["dropped"])))
    return spark.createDataFrame(out, "asked string, answer string")


def _question_sql() -> str:
    closed = f"(SELECT * FROM {catalogue._CLOSED} WHERE complaint_type = 'click')"
    ranked = f"(SELECT borough, row_number() OVER (ORDER BY median(hours_to_close) DESC) AS place, count(*) OVER () AS n FROM {closed} WHERE borough IS NOT NULL GROUP BY borough HAVING count(*) >= 20)"
    keys = ", ".join(f"('{b}')" for b in (*questions.BOROUGHS, "ELSEWHERE"))
    hours = f"(SELECT list(hours_to_close ORDER BY hours_to_close) AS h FROM {closed} WHERE borough = 'QUEENS')"
    without = f"(SELECT max(abs((SELECT median(x) FROM unnest(list_concat(h[:i - 1], h[i + 1:])) AS t(x)) - (SELECT median(x) FROM unnest(h) AS t(x)))) FROM (SELECT h, unnest(generate_series(1, len(h))) AS i FROM {hours}))"
    return f"""SELECT 'rank of ' || k AS asked, CASE WHEN place IS NOT NULL THEN place || ' of ' || n END AS answer FROM (VALUES {keys}) AS t(k) LEFT JOIN {ranked} ON borough = k
UNION ALL SELECT 'p90 of few', 'None' UNION ALL SELECT 'p90 of many', 'True' UNION ALL SELECT 'sway', printf('%.6f', {without})
UNION ALL SELECT 'request ' || unique_key, CASE WHEN complaint_type <> 'click' OR borough IS NULL OR borough <> 'QUEENS' THEN 'elsewhere' WHEN closed_date IS NULL THEN 'open'
  WHEN closed_date < created_date THEN 'backwards' END FROM {catalogue._REQ} WHERE unique_key < 30"""


def question_for_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question that a request belongs to, for the first requests."""
    rows = catalogue.table(spark, sf_dir, "requests")
    at = rows.columns()
    found = rows.df.orderBy(RID).limit(60).select(RID, *[F.col(at[n]).alias(n) for n in ("complaint_type", "borough", "community_board")]).collect()
    out = []
    for r in found:
        q = questions.question_for(r.asDict())
        out.append((r[RID], q.type, q.area.kind, q.area.value))
    odd = [("19 BRONX", None), ("07 BRONX", 7), ("7 BRONX", None), ("01 STATEN ISLAND", 1), ("00 QUEENS", None), ("01 Unspecified", None)]
    out += [(-1 - i, code, "district", str((questions.parse_district(code) or (None, None))[1])) for i, (code, _) in enumerate(odd)]
    return spark.createDataFrame(out, "unique_key bigint, type string, area string, value string")


_FOR_RECORD = f"""SELECT unique_key, complaint_type AS type, CASE WHEN community_board IS NOT NULL THEN 'district' ELSE 'city' END AS area, community_board AS value
FROM (SELECT * FROM {catalogue._REQ} ORDER BY unique_key LIMIT 60)
UNION ALL SELECT * FROM (VALUES (-1, '19 BRONX', 'district', 'None'), (-2, '07 BRONX', 'district', '7'), (-3, '7 BRONX', 'district', 'None'),
  (-4, '01 STATEN ISLAND', 'district', '1'), (-5, '00 QUEENS', 'district', 'None'), (-6, '01 Unspecified', 'district', 'None'))"""


# ---- cleaning

SCOPE = Scope.dates("created_date", "2024-01-01", "2030-01-01")
_UPDATED = int(dt.datetime(2026, 1, 2, tzinfo=dt.UTC).timestamp())


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records made of all documents, with a case of every cleaning rule and known issue."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("d"))
    d = F.col("d")
    is_ = lambda modulus, rest: d % modulus == rest
    copies = F.concat(F.array(F.lit("Closed")), F.when(is_(19, 3), F.array(F.lit("Closed"))).otherwise(F.array()), F.when(is_(29, 4), F.array(F.lit("Open"))).otherwise(F.array()))
    start = F.timestamp_add("SECOND", (d * 7200).cast("bigint"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    start = F.when(is_(41, 0), F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")).otherwise(start)
    start = F.timestamp_add("MICROSECOND", F.when(is_(10, 9), 250_000).otherwise(0).cast("bigint"), start)
    shown = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    missing, placed = F.lit(None).cast("string"), ~is_(3, 0)
    fields = {
        "unique_key": F.when(is_(23, 7), missing).when(is_(17, 5), F.concat(F.lit("0"), d + 1)).otherwise((d + 1).cast("string")),
        "created_date": F.when(is_(31, 6), "soon").when(is_(37, 8), "2023-12-31T23:59:59.000").otherwise(shown(start)),
        "closed_date": F.when(is_(43, 2), "1900-01-01T00:00:00.000").when(is_(47, 1), "2031-01-01T00:00:00.000").when(is_(40, 3), "never").otherwise(shown(F.timestamp_add("SECOND", F.lit(600), start))),
        "agency": F.when(is_(9, 0), "  A\t").otherwise("A"),
        "descriptor": F.when(is_(14, 0), "").otherwise("Loud"),
        "incident_zip": F.when(is_(7, 0), "N/A").when(is_(7, 1), missing).otherwise("11201"),
        "borough": F.when(is_(6, 0), "Unspecified").when(is_(6, 1), "unspecified").otherwise("QUEENS"),
        "status": F.col("status"),
        "latitude": F.when(placed & is_(11, 2), "40.7").when(placed & is_(13, 5), "0").when(placed & is_(53, 9), "x").when(placed, "40.7"),
        "longitude": F.when(placed & is_(11, 2), missing).when(placed & is_(13, 5), "0").when(placed, "-73.9"),
    }
    rows = docs.withColumn("status", F.explode(copies))
    return rows.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("raw"))


_RECORDS = """(SELECT doc_id AS d, 'Closed' AS status FROM documents UNION ALL SELECT doc_id, 'Closed' FROM documents WHERE doc_id % 19 = 3 UNION ALL SELECT doc_id, 'Open' FROM documents WHERE doc_id % 29 = 4)"""
_STAGED = f"""(SELECT *, CASE WHEN d % 17 <> 5 AND d % 23 <> 7 THEN d + 1 END AS key,
  CASE WHEN d % 31 = 6 THEN NULL WHEN d % 37 = 8 THEN TIMESTAMP '2023-12-31 23:59:59' ELSE t0 END AS created,
  CASE WHEN d % 43 = 2 THEN TIMESTAMP '1900-01-01' WHEN d % 47 = 1 THEN TIMESTAMP '2031-01-01' WHEN d % 40 = 3 THEN NULL ELSE t0 + INTERVAL 600 SECONDS END AS closed,
  CASE WHEN d % 3 = 0 THEN 'none' WHEN d % 11 = 2 THEN 'half' WHEN d % 13 = 5 THEN 'zero' WHEN d % 53 = 9 THEN 'odd' ELSE 'place' END AS place
  FROM (SELECT *, CASE WHEN d % 41 = 0 THEN TIMESTAMP '2024-05-01' ELSE TIMESTAMP '2024-01-01' + d * INTERVAL 2 HOURS END + CASE WHEN d % 10 = 9 THEN INTERVAL 250 MILLISECONDS ELSE INTERVAL 0 SECONDS END AS t0 FROM {_RECORDS}))"""
_JUDGED = f"""(SELECT *, CASE WHEN key IS NULL THEN 'CR-02' WHEN lo <> hi THEN 'CR-04' WHEN turn > 1 THEN 'CR-03' WHEN created IS NULL THEN 'CR-05'
  WHEN created < TIMESTAMP '2024-01-01' OR created >= TIMESTAMP '2030-01-01' THEN 'CR-12' END AS rule
  FROM (SELECT *, min(status) OVER (PARTITION BY key) AS lo, max(status) OVER (PARTITION BY key) AS hi, row_number() OVER (PARTITION BY key ORDER BY status) AS turn FROM {_STAGED}))"""
_CLEAN = f"(SELECT * FROM {_JUDGED} WHERE rule IS NULL)"


def _cleaned(spark: SparkSession, sf_dir: str) -> Cleaned:
    return clean(raw_requests(spark, sf_dir), NYC_311, SCOPE)


def clean_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of the twelve rules applied."""
    return spark.createDataFrame(sorted(_cleaned(spark, sf_dir).counts.items()), "rule_id string, n bigint")


_RULE_COUNTS = f"""SELECT rule_id, CAST(n AS BIGINT) AS n FROM (
  SELECT 'CR-01' AS rule_id, 0 AS n
  UNION ALL SELECT r, (SELECT count(*) FROM {_JUDGED} WHERE rule = r) FROM (VALUES ('CR-02'), ('CR-03'), ('CR-04'), ('CR-05'), ('CR-12')) AS t(r)
  UNION ALL SELECT 'CR-06', count(*) FILTER (d % 43 <> 2 AND d % 47 <> 1 AND d % 40 = 3) FROM {_CLEAN}
  UNION ALL SELECT 'CR-07', count(*) FILTER (d % 9 = 0) FROM {_CLEAN} UNION ALL SELECT 'CR-08', count(*) FILTER (d % 14 = 0) FROM {_CLEAN}
  UNION ALL SELECT 'CR-09', count(*) FILTER (place IN ('half', 'odd')) FROM {_CLEAN} UNION ALL SELECT 'CR-10', count(*) FILTER (place IN ('zero', 'place')) FROM {_CLEAN}
  UNION ALL SELECT 'CR-11', count(*) FILTER (date_trunc('second', created) <> created) + count(*) FILTER (date_trunc('second', closed) <> closed) FROM {_CLEAN})"""


def clean_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows, numbered by creation time and key."""
    rows = _cleaned(spark, sf_dir).rows
    at = {c.name: F.col(f"c{i}") for i, c in enumerate(NYC_311.columns)}
    return rows.select(
        F.col(RID).alias("row_index"), at["unique_key"].alias("key"), at["created_date"].alias("created"), at["closed_date"].alias("closed"), at["agency"].alias("agency"),
        at["descriptor"].alias("descriptor"), F.round(at["location"]["lat"].cast("double"), 4).alias("lat"), F.round(at["location"]["lon"].cast("double"), 4).alias("lon"),
    )


_ALL_ROWS = f"""SELECT row_number() OVER (ORDER BY created, key) - 1 AS row_index, key, created, closed, 'A' AS agency, CASE WHEN d % 14 <> 0 THEN 'Loud' END AS descriptor,
  CASE place WHEN 'place' THEN 40.7::DOUBLE WHEN 'zero' THEN 0.0::DOUBLE END AS lat, CASE place WHEN 'place' THEN -73.9::DOUBLE WHEN 'zero' THEN 0.0::DOUBLE END AS lon FROM {_CLEAN}"""


def clean_all_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was changed in clean rows, and from what."""
    log = _cleaned(spark, sf_dir).log
    return log.groupBy("column", "rule_id", "raw_value").agg(F.count(F.lit(1)).alias("n")).withColumn("column", F.col("column").cast("bigint"))


_ALL_LOG = f"""SELECT * FROM (
  SELECT 2 AS "column", 'CR-06' AS rule_id, 'never' AS raw_value, count(*) FILTER (d % 43 <> 2 AND d % 47 <> 1 AND d % 40 = 3) AS n FROM {_CLEAN}
  UNION ALL SELECT 3, 'CR-07', '  A' || chr(9), count(*) FILTER (d % 9 = 0) FROM {_CLEAN} UNION ALL SELECT 5, 'CR-08', '', count(*) FILTER (d % 14 = 0) FROM {_CLEAN}
  UNION ALL SELECT 12, 'CR-09', '["40.7",null]', count(*) FILTER (place = 'half') FROM {_CLEAN} UNION ALL SELECT 12, 'CR-09', '["x","-73.9"]', count(*) FILTER (place = 'odd') FROM {_CLEAN}
) WHERE n > 0"""


def clean_all_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that was taken out, by the key it came with and the rule."""
    return _cleaned(spark, sf_dir).rejects.select("raw_unique_key", "rule_id")


_ALL_REJECTS = f"SELECT CASE WHEN d % 23 = 7 THEN NULL WHEN d % 17 = 5 THEN '0' || (d + 1) ELSE CAST(d + 1 AS VARCHAR) END AS raw_unique_key, rule AS rule_id FROM {_JUDGED} WHERE rule IS NOT NULL"


def known_issues_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all known issues, with the time of the source's last update."""
    found = known_issues(_cleaned(spark, sf_dir).rows, NYC_311, _UPDATED)
    return spark.createDataFrame([(i["id"], i["count"]) for i in found], "id string, n bigint")


_ISSUES = f"""SELECT 'KI-closed-before-created' AS id, count(*) FILTER (closed < created) AS n FROM {_CLEAN}
UNION ALL SELECT 'KI-closed-before-2010', count(*) FILTER (closed < TIMESTAMP '2010-01-01') FROM {_CLEAN} UNION ALL SELECT 'KI-closed-in-future', count(*) FILTER (closed > TIMESTAMP '2026-01-03') FROM {_CLEAN}
UNION ALL SELECT 'KI-created-midnight', count(*) FILTER (date_trunc('day', created) = created) FROM {_CLEAN} UNION ALL SELECT 'KI-location-outside-nyc', count(*) FILTER (place = 'zero') FROM {_CLEAN}
UNION ALL SELECT 'KI-borough-unspecified', count(*) FILTER (d % 6 < 2) FROM {_CLEAN} UNION ALL SELECT 'KI-zip-not-5-digits', count(*) FILTER (d % 7 = 0) FROM {_CLEAN}"""


def clean_odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that is no scalar, or a source whose fields changed, stops the build (CR-01)."""
    out = []
    try:
        clean(spark.createDataFrame([('{"unique_key": "1", "agency": [1]}',)], "raw string"), NYC_311, SCOPE).rows.count()
    except Exception as e:
        out.append(("a list", str("CR-01" in str(e) and "non-scalar" in str(e))))
    columns = metadata_of(NYC_311, None)["columns"]
    for name, given in (("as expected", columns), ("field gone", columns[1:]), ("other type", [columns[0] | {"dataTypeName": "point"}, *columns[1:]])):
        try:
            check_metadata(NYC_311, given)
            out.append((name, "no drift"))
        except Drift as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "name string, answer string")


_DRIFT = f"CR-01 schema drift in {NYC_311.dataset_id}: field \"unique_key\" "
_ODD_VALUES = _values(
    [("a list", "True"), ("as expected", "no drift"), ("field gone", _DRIFT + "is missing"), ("other type", _DRIFT + "has type \"point\", expected one of ['text', 'number']")], "name", "answer"
)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested requests as the second source has them, made of all documents."""
    d = F.col("doc_id")
    at = F.timestamp_add("SECOND", (d * 7200).cast("bigint"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    shown = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    organization = F.when(d % 5 == 0, "Public Works Issues").when(d % 5 == 1, "Peekskill, NY").when(d % 5 == 2, "Yonkers, NY").when(d % 5 == 3, F.lit(None).cast("string")).otherwise("Greenburgh, NY")
    issue = F.struct(
        (d + 1).alias("id"), F.concat(shown, F.when(d % 2 == 0, "-05:00").otherwise("Z")).alias("created_at"), F.when(d % 4 != 0, F.concat(shown, F.lit(".5"))).alias("closed_at"),
        F.struct(organization.alias("organization"), F.when(d % 3 != 0, "Pothole").alias("title")).alias("request_type"), F.lit("Something else").alias("summary"), F.lit("open").alias("status"),
        F.when(d % 6 != 0, F.concat(F.lit("1 Main St 123456, NY 1050"), (d % 10).cast("string"), F.lit(", USA"))).alias("address"), F.when(d % 8 != 0, F.lit(41.2)).alias("lat"), F.lit(-73.9).alias("lng"),
    )
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.to_json(issue).alias("raw"))


_ISSUE = """(SELECT doc_id AS d, CASE doc_id % 5 WHEN 0 THEN 'Mount Vernon' WHEN 1 THEN 'Peekskill' WHEN 4 THEN 'Greenburgh' END AS town, strftime(TIMESTAMP '2024-01-01' + doc_id * INTERVAL 2 HOURS, '%Y-%m-%dT%H:%M:%S') AS t0,
  CASE WHEN doc_id % 3 <> 0 THEN 'Pothole' ELSE 'Something else' END AS kind, CASE WHEN doc_id % 6 <> 0 THEN '1050' || doc_id % 10 END AS zip FROM documents)"""


def flatten_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested requests as flat records of the dataset's fields."""
    found = flattened(issues(spark, sf_dir)).where("record is not null")
    return found.select(*[F.get_json_object("record", f"$.{n}").alias(n) for n in ("id", "created_at", "closed_at", "town", "request_type", "zip", "lat")])


def flatten_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to organizations that answer for no town, counted."""
    return flattened(issues(spark, sf_dir)).where("record is null").groupBy("organization").agg(F.count(F.lit(1)).alias("n"))


def _scope_of(requests: DataFrame) -> Scope:
    """Whole days that hold the creation time of every request, however many there are."""
    text = F.substring(F.get_json_object("raw", "$.created_at"), 1, 19)
    text = F.when(read_time(text).isNotNull(), text)
    first, last = requests.agg(F.min(text), F.max(text)).first()
    first, last = (dt.date.fromisoformat((t or "2024-01-01")[:10]) for t in (first, last))
    return Scope.dates("created_date", first.isoformat(), (last + dt.timedelta(1)).isoformat())


def clean_westchester(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows of the second dataset."""
    requests = issues(spark, sf_dir)
    records = flattened(requests).where("record is not null").select(F.col("record").alias("raw"))
    rows = clean(records, WESTCHESTER, _scope_of(requests)).rows
    at = {c.name: F.col(f"c{i}") for i, c in enumerate(WESTCHESTER.columns)}
    return rows.select(F.col(RID).alias("row_index"), at["unique_key"].alias("key"), at["town"].alias("town"), at["complaint_type"].alias("kind"), at["closed_date"].alias("closed"), at["location"].isNotNull().alias("placed"))


# ---- snapshots


def _raw_directory(spark: SparkSession, records: DataFrame, page_rows: int) -> str:
    """A raw directory as a connector writes it, in the shared folder."""
    root = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / f"raw-{uuid.uuid4().hex}"
    raw.new_directory(root)
    pages, page = [], []

    def put() -> None:
        pages.append(raw.page_record(root, len(pages) + 1, ("[" + ", ".join(page) + "]").encode(), "test", len(page)))
        page.clear()

    total = 0
    for r in records.toLocalIterator():
        page.append(r["raw"])
        total += 1
        if len(page) == page_rows:
            put()
    put()
    metadata = json.dumps(metadata_of(NYC_311, _UPDATED)).encode()
    (root / raw.METADATA).write_bytes(metadata)
    at = utc_text(_UPDATED)
    record = raw.FetchRecord(
        NYC_311.portal, NYC_311.dataset_id, "test", NYC_311.fields, asdict(SCOPE), SCOPE.soql(), ":id", {"kind": "test"}, at, at, at, at,
        total, raw.digest("raw metadata", metadata), pages,
    )
    raw.write_fetch(root, record.seal())
    return str(root)


def _built(spark: SparkSession, records: DataFrame, page_rows: int) -> tuple[str, dict]:
    out = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/snapshots-{uuid.uuid4().hex}"
    return snapshot.build(spark, _raw_directory(spark, records, page_rows), out)


def _new_folder(spark: SparkSession, name: str) -> Path:
    return Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / f"{name}-{uuid.uuid4().hex}"


def socrata_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a replayed portal, by row id, with a failing request; then the snapshot made of them."""
    lines = sorted(r["raw"] for r in raw_requests(spark, sf_dir).toLocalIterator())
    records = [{":id": f"row-{i:09}"} | json.loads(x) for i, x in enumerate(lines)]
    failing = [HttpError(503), HttpError(None)]

    def replay(url: str) -> bytes:
        if failing:
            raise failing.pop()
        if "/api/views/" in url:
            return json.dumps(metadata_of(NYC_311, _UPDATED)).encode()
        asked = parse_qs(urlsplit(url).query)
        after = re.search(r":id > 'row-([0-9]+)'", asked["$where"][0])
        start = int(after[1]) + 1 if after else 0
        return json.dumps(records[start : start + int(asked["$limit"][0])]).encode()

    waits: list[float] = []
    root = _new_folder(spark, "fetched")
    record = fetch_socrata(NYC_311, SCOPE, replay, root, page_size=250, retry=Retry(sleep=waits.append))
    _, manifest = snapshot.build(spark, str(root), str(_new_folder(spark, "snapshots")))
    rows = [("records", record.raw_records), ("pages", len(record.pages)), ("waits", len(waits)), ("rows", manifest["rows"]), ("rejected", manifest["cleaning"]["rejected_rows"])]
    return spark.createDataFrame(rows, "name string, n bigint")


def seeclickfix_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of replayed requests, one page twice; then the snapshot made of them."""
    requests, size = issues(spark, sf_dir), 100
    number_of_pages = -(-requests.count() // size) + 1
    texts = (r["raw"] for r in requests.orderBy(F.get_json_object("raw", "$.id").cast("bigint")).toLocalIterator())
    page: list[str] = []  # the only one here

    def replay(url: str) -> bytes:
        number = int(parse_qs(urlsplit(url).query)["page"][0])
        if number != 2:  # the second page is the first one again
            page[:] = islice(texts, size)
        pagination = {"pagination": {"next_page": number + 1 if number < number_of_pages else None}}
        return f'{{"issues": [{", ".join(page)}], "metadata": {json.dumps(pagination)}}}'.encode()

    root = _new_folder(spark, "fetched")
    record = fetch_seeclickfix(WESTCHESTER, _scope_of(requests), replay, root, size, max_pages=number_of_pages, pause=0.0)
    summary = json.loads((root / "source.json").read_text())
    _, manifest = snapshot.build(spark, str(root), str(_new_folder(spark, "snapshots")))
    rows = [("records", record.raw_records), ("duplicates", summary["duplicates"]), ("skipped", sum(summary["skipped_by_organization"].values())), ("rows", manifest["rows"])]
    return spark.createDataFrame(rows, "name string, n bigint")


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the commands return: synthetic records, a snapshot of them, its verification, and a snapshot that isn't there."""
    root, out = _new_folder(spark, "synthetic"), _new_folder(spark, "snapshots")

    def status(*argv: str) -> int:
        with redirect_stdout(StringIO()), redirect_stderr(StringIO()):
            return cli.main(list(argv), spark=spark)

    found = [("synth", status("synth", "--out", str(root), "--rows", "500")), ("build", status("build", str(root), "--out", str(out)))]
    path = next(p for p in (out / "nyc311").iterdir() if not p.name.startswith("."))
    found += [("verify", status("verify", str(path))), ("verify nothing", status("verify", str(out / "nothing")))]
    return spark.createDataFrame(found, "command string, status bigint")


def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built, verified, loaded and asked: closed requests and their mean hours by borough."""
    path, manifest = _built(spark, raw_requests(spark, sf_dir), 300)
    engine = Engine(spark)
    loaded = engine.load_snapshot(path)
    assert loaded["rows"] == manifest["rows"] and [i["id"] for i in loaded["known_issues"]] == [i["id"] for i in manifest["known_issues"]]
    plan = Plan.scan(loaded["snapshot_hash"]).filter(col("closed_date") >= col("created_date")).map("hours", (col("closed_date") - col("created_date")) / questions.HOUR)
    answer = engine.run(plan.aggregate(["borough"], Agg("n", "count"), Agg("longest", "max", "hours")))
    return spark.createDataFrame([(loaded["rows"], *r[:2], round(r[2], 3)) for r in answer["output"]["rows"]], "rows bigint, borough string, n bigint, longest double")


_ROUND_TRIP = f"""SELECT (SELECT count(*) FROM {_CLEAN}) AS rows, CASE d % 6 WHEN 0 THEN 'Unspecified' WHEN 1 THEN 'unspecified' ELSE 'QUEENS' END AS borough, count(*) AS n,
  round(max(date_diff('microsecond', created, closed) / 3600000000.0::DOUBLE), 3) AS longest FROM {_CLEAN} WHERE closed >= created GROUP BY borough"""


def snapshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a manifest gives of its snapshot."""
    _, manifest = _built(spark, raw_requests(spark, sf_dir), 500)
    out = [("rows", manifest["rows"]), ("chunks", manifest["chunk_count"]), ("rejected", manifest["cleaning"]["rejected_rows"]), ("logged", manifest["cleaning"]["cleaning_log_rows"])]
    out += [(f"missing {c['name']}", c["null_count"]) for c in manifest["schema"] if c["name"] in ("closed_date", "incident_zip", "location", "channel")]
    return spark.createDataFrame(out, "name string, n bigint")


_MANIFEST = f"""SELECT 'rows' AS name, count(*) AS n FROM {_CLEAN} UNION ALL SELECT 'chunks', (count(*) + 65535) // 65536 FROM {_CLEAN} UNION ALL SELECT 'rejected', count(*) FROM {_JUDGED} WHERE rule IS NOT NULL
UNION ALL SELECT 'logged', CAST(sum(n) AS BIGINT) FROM ({_ALL_LOG}) UNION ALL SELECT 'missing closed_date', count(*) FILTER (closed IS NULL) FROM {_CLEAN}
UNION ALL SELECT 'missing incident_zip', count(*) FILTER (d % 7 = 1) FROM {_CLEAN} UNION ALL SELECT 'missing location', count(*) FILTER (place NOT IN ('zero', 'place')) FROM {_CLEAN}
UNION ALL SELECT 'missing channel', count(*) FROM {_CLEAN}"""


def snapshot_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot is named by its content: not by the order or the pages of its records, but by each of its values."""
    records = raw_requests(spark, sf_dir)
    shuffled = records.orderBy(F.xxhash64("raw"))
    changed = records.select(F.replace("raw", F.lit('"Loud"'), F.lit('"Low"')).alias("raw"))
    base, other, third = (_built(spark, df, n)[1] for df, n in ((records, 300), (shuffled, 70), (changed, 300)))
    columns = [(c["name"], c["column_hash"] == d["column_hash"]) for c, d in zip(base["schema"], third["schema"], strict=True)]
    return spark.createDataFrame([("whole, other order", base["snapshot_hash"] == other["snapshot_hash"]), ("whole, other value", base["snapshot_hash"] == third["snapshot_hash"]), *columns], "name string, same boolean")


_HASHES = _values([("whole, other order", True), ("whole, other value", False), *((c.name, c.name != "descriptor") for c in NYC_311.columns)], "name", "same")


def snapshot_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verifying says of a snapshot that was changed."""
    path, _ = _built(spark, raw_requests(spark, sf_dir), 400)
    out, manifest = [("untouched", snapshot.verify(spark, path)["format_version"])], Path(path) / "manifest.json"

    def verdict(name: str) -> None:
        try:
            out.append((name, snapshot.verify(spark, path)["format_version"]))
        except snapshot.Tampered as e:
            out.append((name, str(e)))

    text = manifest.read_text()
    (manifest.parent / ".manifest.json.crc").unlink(missing_ok=True)  # else the file system itself finds the change
    manifest.write_text(text.replace('"rows": ', '"rows":  1', 1))
    verdict("manifest")
    manifest.write_text(text)
    data = spark.read.parquet(f"{path}/data")
    data.withColumn("agency", F.when(F.col("row_index") == 3, "B").otherwise(F.col("agency"))).write.parquet(f"{path}/changed")
    (Path(path) / "data").rename(Path(path) / "kept")
    (Path(path) / "changed").rename(Path(path) / "data")
    spark.catalog.refreshByPath(f"{path}/data")
    verdict("one value")
    return spark.createDataFrame(out, "name string, answer string")


_TAMPERED = _values(
    [("untouched", snapshot.FORMAT), ("manifest", "manifest.json was changed: its hash does not match"), ("one value", "column agency: hash differs from the manifest")], "name", "answer"
)


def snapshot_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot written as Arrow files and read again."""
    path, _ = _built(spark, raw_requests(spark, sf_dir), 600)
    out = Path(path) / "arrow"
    out.mkdir()
    data, log, rejects = (snapshot.import_arrow(spark, f) for f in snapshot.export_arrow(spark, path, str(out)))
    rows = [("data", data.count()), ("cleaning_log", log.count()), ("rejects", rejects.count()), ("sum of keys", data.agg(F.sum("unique_key")).first()[0])]
    return spark.createDataFrame(rows, "name string, n bigint")


_ARROW = f"""SELECT 'data' AS name, count(*) AS n FROM {_CLEAN} UNION ALL SELECT 'cleaning_log', CAST(sum(n) AS BIGINT) FROM ({_ALL_LOG}) UNION ALL SELECT 'rejects', count(*) FROM {_JUDGED} WHERE rule IS NOT NULL
UNION ALL SELECT 'sum of keys', CAST(sum(key) AS BIGINT) FROM {_CLEAN}"""


def decimal_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal totals added in row order, bit for bit, by groups."""
    source = catalogue.table(spark, sf_dir, "orders")
    plan = validate(S.aggregate(["o_orderstatus"], Agg("total", "sum", "o_totalprice"), Agg("mean", "mean", "o_totalprice")), {SNAP: source.info})
    return execute(plan, source, exact_order=True).result()


_ROW_ORDER = """SELECT o_orderstatus, total, total / n AS mean FROM (SELECT o_orderstatus, list_reduce(list_prepend(0.0::DOUBLE, list(o_totalprice ORDER BY o_orderkey)), lambda a, x: a + x) AS total, count(*) AS n FROM orders GROUP BY o_orderstatus)"""


def table_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered densely in the order of their columns."""
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_regionkey")
    numbered: Table = from_dataframe(df, "nation", order=["n_regionkey", "n_name"])
    return numbered.df.select(F.col(RID).alias("row_index"), F.col("c0").alias("n_name"))


_ONE = "(SELECT event_id, value, " + _HOUR + " AS h, event_type, user_id FROM events WHERE event_type = 'click')"

SPECIAL: dict[str, tuple[Query, str]] = {
    "engine_run": (
        engine_run,
        f"""SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS s, CAST(sum(user_id) AS DOUBLE) / count(*) AS m, median({_HOUR}) AS med, quantile_disc({_HOUR}, 0.9) AS p90,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS lo, max(value) AS hi FROM events WHERE {_KEPT} GROUP BY event_type""",
    ),
    "engine_step_rows": (
        engine_step_rows,
        f"SELECT CAST(step AS BIGINT) AS step, CASE WHEN step = 0 THEN (SELECT count(*) FROM events) WHEN step < 3 THEN (SELECT count(*) FROM events WHERE {_KEPT}) ELSE (SELECT count(DISTINCT event_type) FROM events WHERE {_KEPT}) END AS n FROM (VALUES (0), (1), (2), (3), (4)) AS t(step)",
    ),
    "engine_rows_page": (engine_rows_page, "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10 OFFSET 20"),
    "engine_trace_back": (
        engine_trace_back,
        "SELECT CAST(r AS BIGINT) AS output_row, CAST(step AS BIGINT) AS step, CASE WHEN step >= 3 THEN 1 ELSE (SELECT count(*) FROM events WHERE event_type = CASE r WHEN 0 THEN 'click' ELSE 'view' END) END AS n FROM (VALUES (0), (1)) AS a(r), (VALUES (0), (1), (2), (3), (4)) AS t(step)",
    ),
    "engine_trace_back_rows": (engine_trace_back_rows, "SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, event_id FROM events WHERE event_type = 'view'"),
    "engine_trace_forward": (
        engine_trace_forward,
        f"""SELECT event_id, {_KEPT} AS reaches, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END AS output_row, CASE WHEN {_KEPT} THEN 5 ELSE 1 END AS steps, CASE WHEN NOT ({_KEPT}) THEN 1 END AS dropped_at,
  CASE WHEN NOT ({_KEPT}) THEN 'filter' END AS reason, CAST(NULL AS BIGINT) AS position FROM events WHERE event_id IN {_TRACED}""",
    ),
    "engine_trace_limit": (
        engine_trace_limit,
        f"""SELECT event_id, event_type <> 'error' AND place < 30 AS reaches, CASE WHEN event_type <> 'error' AND place < 30 THEN place END AS output_row,
  CASE WHEN event_type = 'error' THEN 1 WHEN place < 30 THEN 3 ELSE 2 END AS steps, CASE WHEN event_type = 'error' THEN 1 WHEN place >= 30 THEN 2 END AS dropped_at,
  CASE WHEN event_type = 'error' THEN 'filter' WHEN place >= 30 THEN 'limit' END AS reason, CASE WHEN event_type <> 'error' AND place >= 30 THEN place END AS position
  FROM (SELECT *, count(*) FILTER (event_type <> 'error') OVER (ORDER BY event_id) - 1 AS place FROM events) WHERE event_id IN {_TRACED}""",
    ),
    "engine_trace_excluded": (
        engine_trace_excluded,
        f"""SELECT event_id, NOT gone AND {_KEPT} AS reaches, CASE WHEN NOT gone THEN CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END END AS output_row, CASE WHEN gone THEN 0 WHEN {_KEPT} THEN 5 ELSE 1 END AS steps,
  CASE WHEN gone THEN 0 WHEN NOT ({_KEPT}) THEN 1 END AS dropped_at, CASE WHEN gone THEN 'excluded' WHEN NOT ({_KEPT}) THEN 'filter' END AS reason, CAST(NULL AS BIGINT) AS position
  FROM (SELECT *, event_id % 2 = 1 AS gone FROM events) WHERE event_id IN {_TRACED}""",
    ),
    "engine_source_records": (
        engine_source_records,
        "SELECT place, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, event_type, value FROM events JOIN (VALUES (0, 34), (1, 3), (2, 144)) AS t(place, id) ON event_id = id",
    ),
    "engine_exclude": (engine_exclude, _excluded_sql()),
    "engine_contributions": (
        engine_contributions,
        f"""SELECT row_number() OVER (ORDER BY abs(without - current) DESC, event_id) - 1 AS place, event_id, without, false AS removes_group, current, true AS exact, n AS contributing, changing FROM (
  SELECT *, count(*) FILTER (without <> current) OVER () AS changing FROM (SELECT event_id, CAST(sum(user_id) OVER () - user_id AS DOUBLE) / (count(*) OVER () - 1) AS without, CAST(sum(user_id) OVER () AS DOUBLE) / count(*) OVER () AS current, count(*) OVER () AS n FROM {_ONE})) ORDER BY place LIMIT 5""",
    ),
    "engine_drop": (
        engine_drop,
        "SELECT * FROM (VALUES ('dropped', 'True'), ('dropped again', 'False'), ('rows', 'no execution 0'), ('exclude further', 'the execution this counterfactual came from was dropped'), ('still there', '2'), ('past the output', 'row 99 is past the output'), "
        "('past the table', 'row 1000000000 is past the snapshot''s ' || (SELECT count(*) FROM events) || ' rows'), ('no record', 'row 1000000000 is past the snapshot')) AS t(asked, answer)",
    ),
    "engine_cells": (engine_cells, _CELLS),
    "engine_problems": (engine_problems, _PROBLEMS_SQL),
    "plan_sentences": (plan_sentences, _SENTENCES_SQL),
    "plan_json_round_trip": (plan_json_round_trip, _values([(n, True, True) for n in catalogue.ENTRIES], "name", "same", "same_hashes")),
    "plan_hashes": (plan_hashes, _values([("none", True, 5), ("a literal", False, 1), ("one more step", False, 5), ("an integer as decimal", False, 2)], "change", "same", "steps_alike")),
    "predicate_on_row": (predicate_on_row, f"SELECT unique_key, closed_date >= created_date AS holds FROM {catalogue._REQ} WHERE unique_key IN (1, 7, 11, 14, 22, 77)"),
    "source_row": (
        source_row,
        "WITH v AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS place FROM events WHERE event_type = 'view') SELECT place, event_id FROM v WHERE place IN (0, 1, 5) UNION ALL SELECT 100, NULL UNION ALL SELECT 200, event_id FROM v WHERE place = 5",
    ),
    "lineage_partition": (lineage_partition, "SELECT 1 AS times, count(*) AS n FROM events WHERE value > 10"),
    "contrib_sum_dec": (
        _contribution_rows(S.filter(col("event_type").eq("click")).aggregate([], Agg("v", "sum", "value")), 4),
        f"SELECT event_id, round(sum(value) OVER () - value, 4) AS without FROM {_ONE}",
    ),
    "contrib_mean_dec": (
        _contribution_rows(S.filter(col("event_type").eq("click")).aggregate([], Agg("v", "mean", "value")), 6),
        f"SELECT event_id, round((sum(value) OVER () - value) / (count(*) OVER () - 1), 6) AS without FROM {_ONE}",
    ),
    "contrib_count_non_null": (
        _contribution_rows(S.filter(col("event_type").eq("click")).map("x", col("value") / (col("user_id") - 10)).aggregate([], Agg("v", "count_non_null", "x")), 0),
        f"SELECT event_id, sum(p) OVER () - p AS without FROM (SELECT event_id, CASE WHEN user_id = 10 THEN 0 ELSE 1 END AS p FROM {_ONE})",
    ),
    "contrib_ranking": (
        contrib_ranking,
        f"""WITH o AS (SELECT event_id, h, row_number() OVER (ORDER BY h, event_id) - 1 AS r, count(*) OVER () - 1 AS n FROM {_ONE}), l AS (SELECT list(h ORDER BY h) AS v, median(h) AS now FROM o),
  w AS (SELECT event_id, CASE WHEN n % 2 = 1 THEN v[n // 2 + CASE WHEN n // 2 < r THEN 1 ELSE 2 END] ELSE (v[n // 2 - 1 + CASE WHEN n // 2 - 1 < r THEN 1 ELSE 2 END] + v[n // 2 + CASE WHEN n // 2 < r THEN 1 ELSE 2 END]) / 2 END AS without, now FROM o, l)
  SELECT row_number() OVER (ORDER BY abs(without - now) DESC, event_id) - 1 AS place, event_id FROM w ORDER BY place LIMIT 20""",
    ),
    "contrib_refused": (contrib_refused, _REFUSED_SQL),
    "question_answers": (question_answers, _question_sql()),
    "question_for_record": (question_for_record, _FOR_RECORD),
    "clean_rule_counts": (clean_rule_counts, _RULE_COUNTS),
    "clean_all_rows": (clean_all_rows, _ALL_ROWS),
    "clean_all_log": (clean_all_log, _ALL_LOG),
    "clean_all_rejects": (clean_all_rejects, _ALL_REJECTS),
    "clean_odd_values": (clean_odd_values, _ODD_VALUES),
    "known_issues_all": (known_issues_all, _ISSUES),
    "flatten_issues": (
        flatten_issues,
        f"SELECT CAST(d + 1 AS VARCHAR) AS id, t0 AS created_at, CASE WHEN d % 4 <> 0 THEN t0 END AS closed_at, town, kind AS request_type, zip, CASE WHEN d % 8 <> 0 THEN '41.2' END AS lat FROM {_ISSUE} WHERE town IS NOT NULL",
    ),
    "flatten_skipped": (flatten_skipped, f"SELECT CASE d % 5 WHEN 2 THEN 'Yonkers, NY' ELSE '(none)' END AS organization, count(*) AS n FROM {_ISSUE} WHERE town IS NULL GROUP BY 1"),
    "clean_westchester": (
        clean_westchester,
        f"SELECT row_number() OVER (ORDER BY t0, d) - 1 AS row_index, d + 1 AS key, town, kind, CASE WHEN d % 4 <> 0 THEN CAST(t0 AS TIMESTAMP) END AS closed, d % 8 <> 0 AS placed FROM {_ISSUE} WHERE town IS NOT NULL",
    ),
    "socrata_fetch": (
        socrata_fetch,
        f"""SELECT 'records' AS name, count(*) AS n FROM {_RECORDS} UNION ALL SELECT 'pages', count(*) // 250 + 1 FROM {_RECORDS} UNION ALL SELECT 'waits', 2
  UNION ALL SELECT 'rows', count(*) FILTER (rule IS NULL) FROM {_JUDGED} UNION ALL SELECT 'rejected', count(*) FILTER (rule IS NOT NULL) FROM {_JUDGED}""",
    ),
    "seeclickfix_fetch": (
        seeclickfix_fetch,
        f"""SELECT 'records' AS name, count(*) FILTER (town IS NOT NULL) AS n FROM {_ISSUE} UNION ALL SELECT 'duplicates', least(count(*), 100) FROM {_ISSUE}
  UNION ALL SELECT 'skipped', count(*) FILTER (town IS NULL) FROM {_ISSUE} UNION ALL SELECT 'rows', count(*) FILTER (town IS NOT NULL) FROM {_ISSUE}""",
    ),
    "command_line": (command_line, _values([("synth", 0), ("build", 0), ("verify", 0), ("verify nothing", 1)], "command", "status")),
    "snapshot_round_trip": (snapshot_round_trip, _ROUND_TRIP),
    "snapshot_manifest": (snapshot_manifest, _MANIFEST),
    "snapshot_hashes": (snapshot_hashes, _HASHES),
    "snapshot_tampered": (snapshot_tampered, _TAMPERED),
    "snapshot_arrow": (snapshot_arrow, _ARROW),
    "decimal_row_order": (decimal_row_order, _ROW_ORDER),
    "table_numbers": (table_numbers, "SELECT row_number() OVER (ORDER BY n_regionkey, n_name) - 1 AS row_index, n_name FROM nation"),
}

QUERIES: dict[str, Query] = {n: q for n, (q, _) in SPECIAL.items()}
ORACLES: dict[str, str] = {n: sql for n, (_, sql) in SPECIAL.items()}
