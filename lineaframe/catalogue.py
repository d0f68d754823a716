"""Queries of every operator over the driver's tables, and the same in DuckDB SQL.

Each plan entry is a plan over one table; the result is the output of its last
step. Lineage and counterfactual entries ask their question of such a run. The
SQL says the same without the engine. Decimal totals and means are rounded on
both sides, as the order in which decimals are added is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaframe import questions
from lineaframe.operators.counterfactual import contributions, exclude
from lineaframe.operators.execution import Execution, execute
from lineaframe.operators.lineage import Lineage
from lineaframe.plans.expr import Call, all_of, any_of, as_expr, col, lit
from lineaframe.plans.plan import Agg, Plan, validate
from lineaframe.plans.types import stamp
from lineaframe.sources.clean import clean, known_issues
from lineaframe.sources.spec import NYC_311, Scope
from lineaframe.sources.tables import RID, Table, from_dataframe

#: Name under which a query's table is scanned.
SNAP = "0" * 64
#: Unique integer columns that number the rows of a table.
NUMBERS = {"events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "documents": "doc_id", "part": "p_partkey", "embeddings": "vec_id"}
#: The tables in the shape the named questions ask for.
REQUESTS = {
    "unique_key": "event_id",
    "created_date": "ts",
    "closed_date": "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN ts - INTERVAL 2 HOURS ELSE ts + user_id * INTERVAL 1 MINUTE END",
    "complaint_type": "event_type",
    "borough": "CASE user_id % 6 WHEN 0 THEN 'BRONX' WHEN 1 THEN 'BROOKLYN' WHEN 2 THEN 'MANHATTAN' WHEN 3 THEN 'QUEENS' WHEN 4 THEN 'STATEN ISLAND' END",
    "community_board": "CASE WHEN user_id % 6 < 5 THEN CONCAT('0', CAST(user_id % 5 + 1 AS STRING), ' ', CASE user_id % 6 WHEN 0 THEN 'BRONX' WHEN 1 THEN 'BROOKLYN' WHEN 2 THEN 'MANHATTAN' WHEN 3 THEN 'QUEENS' ELSE 'STATEN ISLAND' END) END",
    "town": "CASE user_id % 4 WHEN 0 THEN 'Peekskill' WHEN 1 THEN 'Greenburgh' WHEN 2 THEN 'North Castle' END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    """A driver table; ``requests`` are events in the shape of service requests, ``places`` embeddings with a location."""
    if name == "requests":
        df = spark.read.parquet(f"{sf_dir}/events.parquet").select(*[F.expr(e).alias(n) for n, e in REQUESTS.items()])
        return from_dataframe(df, "requests", "unique_key")
    if name == "places":
        point = F.struct(F.col("embedding")[0].alias("lat"), F.col("embedding")[1].alias("lon"))
        df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.when(F.col("vec_id") % 5 != 0, point).alias("place"))
        return from_dataframe(df, "places", "vec_id")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    number = NUMBERS.get(name)
    return from_dataframe(df, name, number, as_stored=number is None)


def run(spark: SparkSession, sf_dir: str, name: str, plan: Plan) -> Execution:
    source = table(spark, sf_dir, name)
    return execute(validate(plan, {SNAP: source.info}), source)


@dataclass(frozen=True)
class Entry:
    source: str
    plan: Plan
    sql: str
    rounded: dict[str, int]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(spark, sf_dir, self.source, self.plan).result()
        return out.withColumns({c: F.round(c, digits) for c, digits in self.rounded.items()}) if self.rounded else out


ENTRIES: dict[str, Entry] = {}
S = Plan.scan(SNAP)


def _add(name: str, source: str, plan: Plan, sql: str, **rounded: int) -> None:
    ENTRIES[name] = Entry(source, plan, sql, rounded)


# ---- scan, project, filter

_add("scan_orders", "orders", S, "SELECT * FROM orders")
_add("project_reorder", "orders", S.project("o_totalprice", "o_orderkey"), "SELECT o_totalprice, o_orderkey FROM orders")
_add(
    "project_after_sort_limit", "orders", S.sort("-o_totalprice").project("o_orderkey").limit(50),
    "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
for _fn, _op in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _add(
        f"filter_{_fn}", "lineitem", S.filter(Call(_fn, (col("l_quantity"), as_expr(25)))).project("l_orderkey", "l_quantity"),
        f"SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity {_op} 25",
    )
_add(
    "filter_text_range", "events", S.filter(all_of(col("event_type") >= "error", col("event_type") < "signup")),
    "SELECT * FROM events WHERE event_type >= 'error' AND event_type < 'signup'",
)
_add(
    "filter_ts", "events", S.filter(all_of(col("ts") >= stamp("2024-01-10T00:00:00"), col("ts") < stamp("2024-01-10T12:30:00.5"))),
    "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-10 12:30:00.5'",
)
_add(
    "filter_and_or_not", "orders",
    S.filter(any_of(all_of(col("o_orderstatus").eq("F"), ~(col("o_totalprice") < 1000.0)), col("o_orderpriority").eq("1-URGENT"))),
    "SELECT * FROM orders WHERE (o_orderstatus = 'F' AND NOT (o_totalprice < 1000)) OR o_orderpriority = '1-URGENT'",
)
_RATIO = S.map("ratio", col("l_tax") / col("l_discount"))
_add(
    "filter_kleene_null", "lineitem", _RATIO.filter(~all_of(col("ratio") > 1.0, col("l_quantity") > 10.0)).project("l_orderkey", "ratio", "l_quantity"),
    "SELECT l_orderkey, l_tax / nullif(l_discount, 0) AS ratio, l_quantity FROM lineitem WHERE NOT (l_tax / nullif(l_discount, 0) > 1 AND l_quantity > 10)",
)
_add(
    "filter_is_null", "lineitem", _RATIO.filter(col("ratio").is_null()).project("l_orderkey", "l_discount"),
    "SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount = 0",
)
_add(
    "filter_in_text", "orders", S.filter(col("o_orderpriority").is_in("1-URGENT", "5-LOW")),
    "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')",
)
_add(
    "filter_in_mixed", "lineitem", S.filter(col("l_linenumber").is_in(1, 3.0, 4.5)).project("l_orderkey", "l_linenumber"),
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3)",
)

# ---- map

_add(
    "map_int_arith", "part", S.map("a", (col("p_size") + 3) * col("p_partkey") - 7).project("p_partkey", "a"),
    "SELECT p_partkey, (CAST(p_size AS BIGINT) + 3) * p_partkey - 7 AS a FROM part",
)
_add(
    "map_dec_arith", "lineitem", S.map("revenue", col("l_extendedprice") * (as_expr(1) - col("l_discount"))).project("l_orderkey", "revenue"),
    "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem",
)
_add("map_div_zero_null", "lineitem", _RATIO.project("l_orderkey", "ratio"), "SELECT l_orderkey, l_tax / nullif(l_discount, 0) AS ratio FROM lineitem")
_add(
    "map_ts_diff", "events", S.map("since", col("ts") - lit(stamp("2024-01-01T00:00:00"))).project("event_id", "since"),
    "SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS since FROM events",
)
_add(
    "map_ts_shift", "events", S.map("later", col("ts") + 90_000_000).map("sooner", col("ts") - col("user_id")).project("event_id", "later", "sooner"),
    "SELECT event_id, ts + INTERVAL 90 SECONDS AS later, ts - to_microseconds(user_id) AS sooner FROM events",
)
for _unit in ("day", "week", "month", "year"):
    _add(
        f"map_trunc_{_unit}", "orders", S.map("start", col("o_orderdate").trunc(_unit)).project("o_orderkey", "start"),
        f"SELECT o_orderkey, CAST(date_trunc('{_unit}', o_orderdate) AS TIMESTAMP) AS start FROM orders",
    )
_add(
    "map_bool", "orders", S.map("large", col("o_totalprice") > 100000.0).project("o_orderkey", "large"),
    "SELECT o_orderkey, o_totalprice > 100000 AS large FROM orders",
)
_add(
    "map_lat_lon", "places", S.map("lat", col("place").lat()).map("lon", col("place").lon()).project("vec_id", "lat", "lon"),
    "SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN CAST(embedding[1] AS DOUBLE) END AS lat, CASE WHEN vec_id % 5 <> 0 THEN CAST(embedding[2] AS DOUBLE) END AS lon FROM embeddings",
)
for _fn, _op in {"exact": ">", "eq": "=", "ne": "<>", "lt": "<", "le": "<=", "ge": ">="}.items():
    # 2 ** 53 + 1 and its neighbours, which a decimal can't tell apart
    _near = S.map("big", col("p_partkey") + 2**53).map("near", lit(float(2**53)) + col("p_size") * 2.0)
    _add(
        f"cmp_int_decimal_{_fn}", "part", _near.filter(Call("gt" if _fn == "exact" else _fn, (col("big"), col("near")))).project("p_partkey", "big"),
        f"SELECT p_partkey, p_partkey + {2**53} AS big FROM part WHERE CAST(p_partkey + {2**53} AS DECIMAL(38,0)) {_op} CAST({2**53}::DOUBLE + p_size * 2.0 AS DECIMAL(38,0))",
    )

# ---- aggregate

_G = "l_returnflag"


def _agg(name: str, agg: Agg, sql: str, source: str = "lineitem", key: str = _G, **rounded: int) -> None:
    _add(name, source, S.aggregate([key], agg), f"SELECT {key}, {sql} AS v FROM {source} GROUP BY {key}", **rounded)


_agg("agg_count", Agg("v", "count"), "count(*)")
_add(
    "agg_count_non_null", "lineitem", _RATIO.aggregate([_G], Agg("v", "count_non_null", "ratio")),
    f"SELECT {_G}, count(l_tax / nullif(l_discount, 0)) AS v FROM lineitem GROUP BY {_G}",
)
_agg("agg_sum_int", Agg("v", "sum", "l_partkey"), "CAST(sum(l_partkey) AS BIGINT)")
_agg("agg_sum_dec", Agg("v", "sum", "l_extendedprice"), "round(sum(l_extendedprice), 2)", v=2)
_agg("agg_mean_int", Agg("v", "mean", "l_partkey"), "CAST(sum(l_partkey) AS DOUBLE) / count(l_partkey)")
_agg("agg_mean_dec", Agg("v", "mean", "l_extendedprice"), "round(avg(l_extendedprice), 4)", v=4)
_agg("agg_median", Agg("v", "median", "l_extendedprice"), "median(l_extendedprice)")
for _kind, _source, _key, _column in (
    ("int", "lineitem", _G, "l_partkey"), ("dec", "lineitem", _G, "l_extendedprice"), ("ts", "events", "event_type", "ts"), ("text", "orders", "o_orderstatus", "o_orderpriority"),
):
    _add(
        f"agg_min_max_{_kind}", _source, S.aggregate([_key], Agg("lo", "min", _column), Agg("hi", "max", _column)),
        f"SELECT {_key}, min({_column}) AS lo, max({_column}) AS hi FROM {_source} GROUP BY {_key}",
    )
_add(
    "agg_min_max_bool", "orders",
    S.map("large", col("o_totalprice") > 400000.0).aggregate(["o_orderpriority"], Agg("lo", "min", "large"), Agg("hi", "max", "large")),
    "SELECT o_orderpriority, min(o_totalprice > 400000) AS lo, max(o_totalprice > 400000) AS hi FROM orders GROUP BY o_orderpriority",
)
for _p in (1, 28, 50, 90, 99):
    _agg(f"agg_p{_p}", Agg("v", "percentile", "l_partkey", _p), f"quantile_disc(l_partkey, {_p / 100})")
_agg("agg_percentile_ts", Agg("v", "percentile", "ts", 75), "quantile_disc(ts, 0.75)", "events", "event_type")
_add(
    "agg_global", "orders", S.aggregate([], Agg("n", "count"), Agg("most", "max", "o_totalprice")),
    "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders",
)
_add(
    "agg_global_empty", "orders", S.filter(col("o_totalprice") < -1.0).aggregate([], Agg("n", "count"), Agg("c", "count_non_null", "o_custkey"), Agg("s", "sum", "o_custkey")),
    "SELECT count(*) AS n, count(o_custkey) AS c, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_totalprice < -1",
)
_add("agg_distinct_keys", "lineitem", S.aggregate(["l_returnflag", "l_linestatus"]), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_add(
    "agg_null_group", "lineitem", _RATIO.map("steep", col("ratio") > 1.0).aggregate(["steep"], Agg("n", "count")),
    "SELECT l_tax / nullif(l_discount, 0) > 1 AS steep, count(*) AS n FROM lineitem GROUP BY 1",
)
_add(
    "agg_two_keys", "lineitem", S.aggregate(["l_returnflag", "l_linestatus"], Agg("n", "count"), Agg("q", "sum", "l_quantity")),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL", q=2,
)
_add(
    "agg_of_agg", "orders", S.aggregate(["o_custkey"], Agg("n", "count")).aggregate(["n"], Agg("customers", "count")),
    "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n",
)

# ---- sort and limit

_add(
    "sort_multi_nulls", "orders",
    S.map("urgent", col("o_orderpriority").eq("1-URGENT")).map("per", col("o_totalprice") / (col("o_custkey") - 5)).sort("-per", "urgent", "o_orderkey").project("o_orderkey", "per"),
    "SELECT o_orderkey, o_totalprice / nullif(o_custkey - 5, 0) AS per FROM orders ORDER BY per DESC NULLS LAST",
)
_add(
    "sort_stable", "events", S.sort("-value").sort("event_type").limit(100).project("event_id"),
    "SELECT event_id FROM events ORDER BY event_type, value DESC, event_id LIMIT 100",
)
_add("limit_zero", "orders", S.limit(0), "SELECT * FROM orders LIMIT 0")
_add("topk", "lineitem", S.sort("-l_extendedprice", "l_orderkey", "l_linenumber").limit(10).project("l_orderkey", "l_extendedprice"),
     "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
_add(
    "limit_then_agg", "orders", S.sort("-o_totalprice").limit(500).aggregate(["o_orderstatus"], Agg("n", "count")),
    "SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500) GROUP BY ALL",
)

# ---- named questions

_REQ = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in REQUESTS.items()) + " FROM events)"
_CLOSED = f"(SELECT *, date_diff('microsecond', created_date, closed_date) / 3600000000.0::DOUBLE AS hours_to_close FROM {_REQ} WHERE closed_date >= created_date)"
_TIMES = "count(*) AS complaints, median(hours_to_close) AS median_hours, quantile_disc(hours_to_close, 0.9) AS p90_hours"
_CLICK = questions.Question("click", questions.Area("borough", "QUEENS"))
_add(
    "q_wait", "requests", questions.wait(SNAP, _CLICK), f"SELECT {_TIMES} FROM {_CLOSED} WHERE complaint_type = 'click' AND borough = 'QUEENS'",
)
_add("q_towns", "requests", questions.towns(SNAP, "view"), f"SELECT town, {_TIMES} FROM {_CLOSED} WHERE complaint_type = 'view' GROUP BY town")
_add("q_town_list", "requests", questions.town_list(SNAP), f"SELECT town, count(*) AS n FROM {_REQ} GROUP BY town")
_add("q_compare", "requests", questions.compare(SNAP, "click"), f"SELECT borough, {_TIMES} FROM {_CLOSED} WHERE complaint_type = 'click' GROUP BY borough")
_add(
    "q_rank", "requests", questions.compare(SNAP, None, "BRONX"),
    f"SELECT community_board, {_TIMES} FROM {_CLOSED} WHERE borough = 'BRONX' GROUP BY community_board",
)
_add(
    "q_counts", "requests", questions.counts(SNAP, _CLICK),
    f"SELECT count(*) AS filed, count(closed_date) AS closed FROM {_REQ} WHERE complaint_type = 'click' AND borough = 'QUEENS'",
)
for _order, _by in {"slowest": "hours_to_close DESC", "fastest": "hours_to_close", "recent": "created_date DESC"}.items():
    _add(
        f"q_list_{_order}", "requests", questions.listing(SNAP, questions.Question("view"), _order, 25).project("unique_key", "hours_to_close"),
        f"SELECT unique_key, hours_to_close FROM {_CLOSED} WHERE complaint_type = 'view' ORDER BY {_by}, unique_key LIMIT 25",
    )
_add("q_key", "requests", questions.by_key(SNAP, 42), f"SELECT count(*) AS n FROM {_REQ} WHERE unique_key = 42")
_add(
    "q_faster", "requests", questions.faster(SNAP, _CLICK, 1.5),
    f"SELECT count(*) AS n FROM {_CLOSED} WHERE complaint_type = 'click' AND borough = 'QUEENS' AND hours_to_close < 1.5",
)
_add(
    "q_top_types", "requests", questions.top_types(SNAP, 3),
    f"SELECT complaint_type, count(*) AS n FROM {_REQ} GROUP BY complaint_type ORDER BY n DESC, complaint_type LIMIT 3",
)
_add("q_districts", "requests", questions.districts(SNAP), f"SELECT community_board, count(*) AS n FROM {_REQ} GROUP BY community_board")

# ---- lineage, counterfactuals, cleaning

_HOURS = (
    S.filter(col("event_type").is_in("click", "view")).map("hours", (col("ts") - col("ts").trunc("day")) / 3_600_000_000)
    .aggregate(["event_type"], Agg("n", "count"), Agg("s", "sum", "user_id"), Agg("m", "mean", "user_id"), Agg("med", "median", "hours"),
               Agg("p90", "percentile", "hours", 90), Agg("lo", "min", "ts"), Agg("hi", "max", "value"))
    .sort("event_type")
)
#: Source rows that the counterfactual queries leave out.
_GONE = [*range(0, 2000, 7), 10**9]
_GONE_SQL = "event_id % 7 = 0 AND event_id < 2000"
_HOUR_SQL = "date_diff('microsecond', date_trunc('day', ts), ts) / 3600000000.0::DOUBLE"


def _events(spark: SparkSession, sf_dir: str, plan: Plan = _HOURS) -> Execution:
    return run(spark, sf_dir, "events", plan)


def trace_back_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows behind the first output row."""
    execution = _events(spark, sf_dir)
    return Lineage(execution).backward_row(execution.plan.output, 0).source.select(F.col(RID).alias("event_id"))


def trace_back_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every step behind the first output row."""
    execution = _events(spark, sf_dir)
    trace = Lineage(execution).backward_row(execution.plan.output, 0)
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).cast("bigint").alias("step"), "n") for step, rows in trace.path]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def trace_forward_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output rows that some source rows reach."""
    execution = _events(spark, sf_dir)
    reached = Lineage(execution).forward(list(range(0, 400, 3)))
    output = execution.output
    return reached.select(F.col(output.columns["event_type"]).alias("event_type"))


def trace_forward_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some source rows pass a filter."""
    execution = _events(spark, sf_dir)
    return Lineage(execution).forward(list(range(0, 400, 3)), 1).select(F.col(RID).alias("event_id"))


def _without(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: exclude(_events(spark, sf_dir, plan), _GONE).execution.result()


def _exclude_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = S.aggregate(["event_type"], Agg("n", "count"))
    execution = _events(spark, sf_dir, plan)
    first = Lineage(execution).backward_row(execution.plan.output, 0).source
    return exclude(execution, first).execution.result()


def _contribution(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = contributions(_events(spark, sf_dir), 0, name).rows
        return rows.select(F.col("source_row").alias("event_id"), "without")

    return query


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records made of documents: keys that repeat, texts with spaces, times that can't be read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.floor(F.col("doc_id") / F.when(F.col("doc_id") % 10 == 1, 2).otherwise(1)).cast("bigint")
    shown = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    start = F.timestamp_add("SECOND", (F.col("doc_id") * 7200).cast("bigint"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    fields = {
        "unique_key": (key + 1).cast("string"),
        "created_date": F.when(F.col("doc_id") % 50 == 0, "soon").otherwise(shown(start)),
        "closed_date": F.when(F.col("doc_id") % 40 == 3, "never").otherwise(shown(F.timestamp_add("SECOND", F.lit(-600), start))),
        "agency": F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("  "), F.col("source"), F.lit("\t"))).otherwise(F.col("source")),
        "complaint_type": F.when(F.col("doc_id") % 13 == 0, " ").otherwise(F.col("lang")),
    }
    return docs.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("raw"))


_SCOPE = Scope.dates("created_date", "2024-01-01", "2024-03-01")
_RAW = """(SELECT doc_id, CAST(floor(doc_id / CASE WHEN doc_id % 10 = 1 THEN 2 ELSE 1 END) AS BIGINT) + 1 AS key, doc_id % 50 = 0 AS unreadable,
  TIMESTAMP '2024-01-01' + doc_id * INTERVAL 2 HOURS AS created, source, lang FROM documents)"""
_RULED = f"""(SELECT *, CASE WHEN count(*) OVER (PARTITION BY key) > 1 THEN 'CR-04' WHEN unreadable THEN 'CR-05'
  WHEN created >= TIMESTAMP '2024-03-01' THEN 'CR-12' END AS rule FROM {_RAW})"""


def clean_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each rule rejects."""
    return clean(_requests(spark, sf_dir), NYC_311, _SCOPE).rejects.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows with their numbers."""
    rows = clean(_requests(spark, sf_dir), NYC_311, _SCOPE).rows
    return rows.select(F.col(RID).alias("row_index"), F.col("c0").alias("key"), F.col("c3").alias("agency"), F.col("c4").alias("lang"))


def clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules changed in clean rows."""
    return clean(_requests(spark, sf_dir), NYC_311, _SCOPE).log.groupBy("rule_id", "raw_value").agg(F.count(F.lit(1)).alias("n"))


def known_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known issues of the clean rows."""
    rows = clean(_requests(spark, sf_dir), NYC_311, _SCOPE).rows
    found = [(i["id"], i["count"]) for i in known_issues(rows, NYC_311)]
    return spark.createDataFrame(found, "id string, n bigint")


_BASE_SQL = "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS s, CAST(sum(user_id) AS DOUBLE) / count(*) AS m, median({h}) AS med, quantile_disc({h}, 0.9) AS p90, min(ts) AS lo, max(value) AS hi FROM events WHERE event_type IN ('click', 'view') AND NOT ({gone}) GROUP BY event_type"
_ONE = "(SELECT event_id, user_id, ts, value, " + _HOUR_SQL + " AS h FROM events WHERE event_type = 'click')"


def _leave_one_out(ranked: str, value: str) -> str:
    """Order statistics of a group without each of its rows, by rank."""
    return f"SELECT a.event_id, {value} AS without FROM (SELECT event_id, {ranked} AS x, row_number() OVER (ORDER BY {ranked}, event_id) - 1 AS r, count(*) OVER () - 1 AS n FROM {_ONE}) a"


def _at(k: str, column: str) -> str:
    sorted_values = f"(SELECT list({column} ORDER BY {column}) FROM {_ONE})"
    return f"{sorted_values}[CAST(CASE WHEN {k} < r THEN {k} ELSE {k} + 1 END AS BIGINT) + 1]"


SPECIAL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "trace_back_rows": (trace_back_rows, "SELECT event_id FROM events WHERE event_type = 'click'"),
    "trace_back_counts": (
        trace_back_counts,
        "SELECT CAST(step AS BIGINT) AS step, CASE WHEN step >= 3 THEN 1 ELSE (SELECT count(*) FROM events WHERE event_type = 'click') END AS n FROM (VALUES (0), (1), (2), (3), (4)) AS t(step)",
    ),
    "trace_forward_groups": (
        trace_forward_groups,
        "SELECT DISTINCT event_type FROM events WHERE event_id % 3 = 0 AND event_id < 400 AND event_type IN ('click', 'view')",
    ),
    "trace_forward_filter": (
        trace_forward_filter,
        "SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_id < 400 AND event_type IN ('click', 'view')",
    ),
    "exclude_rows": (_without(_HOURS), _BASE_SQL.format(h=_HOUR_SQL, gone=_GONE_SQL)),
    "exclude_group_vanishes": (
        _exclude_group,
        "SELECT event_type, count(*) AS n FROM events WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY event_type",
    ),
    "exclude_limit_pulls_in": (
        _without(S.sort("event_id").limit(100).aggregate([], Agg("n", "count"), Agg("last", "max", "event_id"))),
        f"SELECT count(*) AS n, max(event_id) AS last FROM (SELECT event_id FROM events WHERE NOT ({_GONE_SQL}) ORDER BY event_id LIMIT 100)",
    ),
    "contrib_count": (_contribution("n"), f"SELECT event_id, count(*) OVER () - 1 AS without FROM {_ONE}"),
    "contrib_sum": (_contribution("s"), f"SELECT event_id, CAST(sum(user_id) OVER () - user_id AS BIGINT) AS without FROM {_ONE}"),
    "contrib_mean": (_contribution("m"), f"SELECT event_id, CAST(sum(user_id) OVER () - user_id AS DOUBLE) / (count(*) OVER () - 1) AS without FROM {_ONE}"),
    "contrib_median": (
        _contribution("med"),
        _leave_one_out("h", f"CASE WHEN n % 2 = 1 THEN {_at('n // 2', 'h')} ELSE ({_at('(n // 2 - 1)', 'h')} + {_at('n // 2', 'h')}) / 2 END"),
    ),
    "contrib_p90": (_contribution("p90"), _leave_one_out("h", _at("(greatest(1, (n * 90 + 99) // 100) - 1)", "h"))),
    "contrib_min": (_contribution("lo"), _leave_one_out("ts", _at("0", "ts"))),
    "contrib_max": (_contribution("hi"), _leave_one_out("value", _at("(n - 1)", "value"))),
    "clean_rejects": (clean_rejects, f"SELECT rule AS rule_id, count(*) AS n FROM {_RULED} WHERE rule IS NOT NULL GROUP BY rule"),
    "clean_rows": (
        clean_rows,
        f"SELECT row_number() OVER (ORDER BY created, key) - 1 AS row_index, key, source AS agency, CASE WHEN doc_id % 13 <> 0 THEN lang END AS lang FROM {_RULED} WHERE rule IS NULL",
    ),
    "clean_log": (
        clean_log,
        f"""SELECT rule_id, raw_value, count(*) AS n FROM (
  SELECT 'CR-06' AS rule_id, 'never' AS raw_value FROM {_RULED} WHERE rule IS NULL AND doc_id % 40 = 3
  UNION ALL SELECT 'CR-07', '  ' || source || chr(9) FROM {_RULED} WHERE rule IS NULL AND doc_id % 9 = 0
  UNION ALL SELECT 'CR-08', ' ' FROM {_RULED} WHERE rule IS NULL AND doc_id % 13 = 0) GROUP BY ALL""",
    ),
    "known_issue_counts": (
        known_issue_counts,
        f"""SELECT 'KI-closed-before-created' AS id, count(*) FILTER (doc_id % 40 <> 3) AS n FROM {_RULED} WHERE rule IS NULL
  UNION ALL SELECT 'KI-closed-before-2010', 0 UNION ALL SELECT 'KI-location-outside-nyc', 0
  UNION ALL SELECT 'KI-created-midnight', count(*) FROM {_RULED} WHERE rule IS NULL AND doc_id % 12 = 0
  UNION ALL SELECT 'KI-borough-unspecified', 0 UNION ALL SELECT 'KI-zip-not-5-digits', 0""",
    ),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**ENTRIES, **{n: q for n, (q, _) in SPECIAL.items()}}
ORACLES: dict[str, str] = {**{n: e.sql for n, e in ENTRIES.items()}, **{n: sql for n, (_, sql) in SPECIAL.items()}}
