"""Valid plans as chains of lazy DataFrames, one for each step.

Tables of the engine are ordered, DataFrames are not: each step carries its
order as a list of columns. A sort puts its keys before the order it finds,
which makes it stable without sorting anything; a limit sorts and takes, which
Spark does as one top-k; an aggregate's order is its keys. Columns never change
once made, so order columns stay right after a projection drops their names,
and Catalyst prunes what nobody reads.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from lineaframe.functions import aggregates as agg_fns
from lineaframe.functions.scalars import to_column
from lineaframe.plans.expr import Call, Expr
from lineaframe.plans.plan import Aggregate, Filter, Limit, Map, Project, Scan, Sort, ValidPlan
from lineaframe.plans.types import INT_MAX, INT_MIN, Kind, Schema
from lineaframe.sources.tables import RID, Table, number_rows
from lineaframe.storage import ship

#: Spark's largest row count for a limit; more rows than this are left as they are.
MAX_LIMIT = 2**31 - 1
#: Row numbers up to this many are excluded by a list in the filter, more by an anti-join.
INLINE_ROWS = 1000
#: Estimated input above which medians and percentiles are found by brackets, not by gathering groups; a group, which
#: may be the whole input, is held by one task up to it.
GATHER_BYTES = 128 << 20


def known(value: object, kind: DataType) -> Column:
    """A value that was read from a DataFrame, as a constant; no time zone touches a wall-clock time."""
    return F.lit(value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value).cast(kind)


def narrowed(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` with (or, for ``left_anti``, without) a row of ``right`` that is equal on all ``names``.

    Two missing values are equal. The right side is renamed, as both often stem
    from one DataFrame.
    """
    other = right.select(*[F.col(n).alias(f"__{n}") for n in names])
    return left.join(other, reduce(and_, [left[n].eqNullSafe(other[f"__{n}"]) for n in names]), how)


@dataclass(frozen=True)
class StepTable:
    """The rows of a step.

    ``columns`` maps its names to columns of ``df``; ``order`` lists order
    columns and whether they descend; ``identity`` names the columns that tell
    its rows apart: the row number below the first aggregate, the group keys
    from there on.
    """

    df: DataFrame
    schema: Schema
    columns: Mapping[str, str]
    order: tuple[tuple[str, bool], ...]
    identity: tuple[str, ...]

    def refs(self) -> dict[str, Column]:
        return {name: F.col(c) for name, c in self.columns.items()}

    def order_columns(self) -> list[Column]:
        """Missing is smallest: first ascending, last descending."""
        return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first() for c, desc in self.order]

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order_columns()) if self.order else self.df

    def visible(self, ordered: bool = True) -> DataFrame:
        """The step's own columns under their own names."""
        df = self.ordered() if ordered else self.df
        return df.select(*[F.col(c).alias(name) for name, c in self.columns.items()])

    def matching(self, rows: DataFrame) -> DataFrame:
        """The rows of this step whose identity is among ``rows``."""
        if not self.identity:
            return self.df if not rows.isEmpty() else self.df.where("false")
        return narrowed(self.df, rows, self.identity)

    def idents(self, df: DataFrame | None = None) -> DataFrame:
        """Identity columns under new names, for joins with this step's tables."""
        return (self.df if df is None else df).select(*self.identity)

    def before(self, row: Mapping[str, object]) -> Column:
        """Whether a row comes before ``row`` (values of the order columns)."""
        cases, same = [], F.lit(True)
        for c, desc in self.order:
            value = known(row[c], self.df.schema[c].dataType)
            x = F.col(c)
            if desc:
                first = x.isNotNull() if row[c] is None else x > value
            else:
                first = F.lit(False) if row[c] is None else x.isNull() | (x < value)
            cases.append(same & F.coalesce(first, F.lit(False)))
            same = same & x.eqNullSafe(value)
        return reduce(or_, cases, F.lit(False))


@dataclass
class Execution:
    """All steps of a run; nothing is computed until something is read."""

    plan: ValidPlan
    table: Table
    steps: list[StepTable]
    excluded: DataFrame | None = None
    pinned: list[DataFrame] = field(default_factory=list)

    @property
    def output(self) -> StepTable:
        return self.steps[self.plan.output]

    def result(self) -> DataFrame:
        """The output in its order, under its own names."""
        return self.output.visible()

    def arithmetic(self, number: int) -> list[Call]:
        """Parts of a step's expression that can overflow, inner ones first."""
        op = self.plan.steps[number]
        if not isinstance(op, Map | Filter):
            return []
        schema, found = self.plan.input_schema(number), []

        def visit(e: Expr) -> None:
            for part in e.parts():
                visit(part)
            if isinstance(e, Call) and e.fn in ("add", "sub", "mul") and e.infer(schema).kind in (Kind.INTEGER, Kind.TIMESTAMP):
                found.append(e)

        visit(op.expr if isinstance(op, Map) else op.predicate)
        return found

    def row_counts(self) -> list[int]:
        """Rows of every step, in one job.

        The job also evaluates all whole-number arithmetic of the plan over all
        rows of its step's input, so an overflow is an error even where Spark
        would not have needed the value.
        """
        keeps = (Map, Project, Sort)  # these have as many rows as what they read
        tested: dict[int, list[Column]] = {}
        for i in range(1, len(self.plan.steps)):
            reads = self.plan.steps[i].input
            source = self.steps[reads]
            tested.setdefault(reads, []).extend(F.count(to_column(e, source.schema, source.refs())) for e in self.arithmetic(i))
        counted = [i for i, op in enumerate(self.plan.steps) if not isinstance(op, keeps) or tested.get(i)]
        one = F.count(F.lit(1)).alias("n")
        counts = [self.steps[i].df.agg(one, F.array(*tested.get(i, [])).cast("array<bigint>").alias("tested")).withColumn("i", F.lit(i)) for i in counted]
        found = {r["i"]: r["n"] for r in reduce(DataFrame.union, counts).collect()}
        out: list[int] = []
        for i, op in enumerate(self.plan.steps):
            out.append(found[i] if i in found else out[op.input])
        return out

    def overflow(self) -> tuple[int, str] | None:
        """The first step whose whole-number arithmetic or sum overflows, and the first place where it does."""
        for i in range(1, len(self.plan.steps)):
            op = self.plan.steps[i]
            source = self.steps[op.input]
            for e in self.arithmetic(i):
                a, b = (to_column(x, source.schema, source.refs()) for x in e.args)
                if e.infer(source.schema).kind is not Kind.INTEGER or any(x.infer(source.schema).kind is not Kind.INTEGER for x in e.args):
                    continue
                tried = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[e.fn](a, b)
                rows = source.df.where(tried.isNull() & a.isNotNull() & b.isNotNull()).withColumns({"__a": a, "__b": b})
                row = rows.orderBy(*source.order_columns()).first()
                if row is not None:
                    place = source.df.where(source.before(row.asDict())).count()
                    return i, f"{row['__a']} {e.fn} {row['__b']} overflows a 64-bit integer (row {place})"
            if isinstance(op, Aggregate):
                for agg in op.aggregates:
                    if agg.fn == "sum" and source.schema.find(agg.column).kind is Kind.INTEGER:
                        total = agg_fns.exact_total(F.col(source.columns[agg.column])).alias("total")
                        sums = source.df.groupBy(*[source.columns[g] for g in op.group_by]).agg(total)
                        bad = sums.where(~F.col("total").between(INT_MIN, INT_MAX)).orderBy("total").first()
                        if bad is not None:
                            return i, f"the sum {bad['total']} doesn't fit in a 64-bit integer"
        return None

    def aggregates(self) -> list[int]:
        return [i for i, s in enumerate(self.plan.steps) if isinstance(s, Aggregate)]

    def pin(self) -> Execution:
        """Keep the results of aggregates, which later questions start from; spills to disk, recomputed if lost."""
        for i in self.aggregates():
            self.steps[i].df.persist()
            self.pinned.append(self.steps[i].df)
        return self

    def release(self) -> None:
        for df in self.pinned:
            df.unpersist()
        self.pinned.clear()


def scan_table(table: Table, without: DataFrame | list[int] | None = None) -> StepTable:
    """All rows, or all but those with the given row numbers; numbers that don't exist do no harm."""
    df = table.df
    if isinstance(without, list):
        df = df.where(~F.col(RID).isin(without)) if without else df
    elif without is not None:
        df = df.join(without.select(F.col(RID)), RID, "left_anti")
    return StepTable(df, table.schema, table.columns(), ((RID, False),), (RID,))


def aggregate_step(step: Aggregate, number: int, source: StepTable, schema: Schema, exact_order: bool, gather_bytes: int) -> StepTable:
    keys = [source.columns[g] for g in step.group_by]
    made = {a.name: f"s{number}_{i}" for i, a in enumerate(step.aggregates)}
    columns = {g: source.columns[g] for g in step.group_by} | made
    order = tuple((k, False) for k in keys)
    if not step.aggregates:
        return StepTable(source.df.select(*keys).distinct(), schema, columns, order, tuple(keys))
    size = int(source.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    gather = size <= gather_bytes
    simple, counted, in_order = [], {}, {}
    for a in step.aggregates:
        if a.fn in agg_fns.ORDERED and not gather:
            counted.setdefault(a.column, []).append((made[a.name], a))
            continue
        c = F.col(source.columns[a.column]) if a.column else None
        kind = source.schema.find(a.column).kind if a.column else None
        if exact_order and a.fn in ("sum", "mean") and kind is Kind.DECIMAL:
            in_order[made[a.name]] = a
            simple.append(F.count(c).alias(made[a.name]))
        else:
            simple.append(agg_fns.simple(a, c, kind).alias(made[a.name]))
    df = source.df.groupBy(*keys).agg(*(simple or [F.count(F.lit(1)).alias(f"s{number}_n")]))
    if in_order:
        df = _with_row_order_totals(df, source, keys, in_order)
    for column, wanted in counted.items():
        found = agg_fns.order_statistics(source.df, keys, source.columns[column], wanted)
        renamed = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[n for n, _ in wanted])
        on = reduce(and_, [df[k].eqNullSafe(renamed[f"__{k}"]) for k in keys], F.lit(True))
        df = df.join(renamed, on, "left").drop(*[f"__{k}" for k in keys])
    return StepTable(df, schema, columns, order, tuple(keys))


def _with_row_order_totals(df: DataFrame, source: StepTable, keys: list[str], wanted: Mapping[str, agg_fns.Agg]) -> DataFrame:
    """``df`` with counts of present values replaced by totals or means that were added in row order."""
    ship(df.sparkSession)
    numbered = number_rows(source.df, source.order_columns(), "__at")  # one number instead of several order columns
    found = agg_fns.row_order_totals(numbered, keys, "__at", {f"__{n}": source.columns[a.column] for n, a in wanted.items()})
    df = df.withColumn("__group", agg_fns.encoded(keys)).join(found, F.col("__group") == F.col("__key"), "left")
    for name, a in wanted.items():
        total = F.col(f"__{name}") if a.fn == "sum" else F.col(f"__{name}") / F.col(name)
        df = df.withColumn(name, agg_fns.finite(F.when(F.col(name) > 0, total)))
    return df.drop("__group", "__key", *[f"__{n}" for n in wanted])


def _apply(step: object, number: int, source: StepTable, schema: Schema, exact_order: bool, gather_bytes: int) -> StepTable:
    match step:
        case Filter(_, predicate):
            return replace(source, df=source.df.where(to_column(predicate, source.schema, source.refs())))
        case Map(_, name, expr):
            made = f"s{number}_0"
            df = source.df.withColumn(made, to_column(expr, source.schema, source.refs()))
            return replace(source, df=df, schema=schema, columns={**source.columns, name: made})
        case Project(_, names):
            return replace(source, schema=schema, columns={n: source.columns[n] for n in names})
        case Sort(_, keys):
            order = tuple((source.columns[k.column], k.descending) for k in keys)
            return replace(source, order=(*order, *source.order))
        case Limit(_, count):
            return source if count > MAX_LIMIT else replace(source, df=source.ordered().limit(count))
        case Aggregate():
            return aggregate_step(step, number, source, schema, exact_order, gather_bytes)
    raise TypeError(step)


def run_from(
    plan: ValidPlan, start: int, first: StepTable, before: list[StepTable], exact_order: bool = False, gather_bytes: int = GATHER_BYTES
) -> list[StepTable]:
    """Tables of all steps, where ``before`` has those up to ``start`` and ``first`` stands for step ``start``."""
    steps = [*before, first]
    for number in range(start + 1, len(plan.steps)):
        step = plan.steps[number]
        steps.append(_apply(step, number, steps[step.input], plan.schemas[number], exact_order, gather_bytes))
    return steps


def execute(
    plan: ValidPlan,
    table: Table,
    without: DataFrame | list[int] | None = None,
    exact_order: bool = False,
    gather_bytes: int = GATHER_BYTES,
) -> Execution:
    """Compile a plan over the table its scan names.

    ``exact_order`` adds decimals in row order, so that totals are the same to
    the last bit however the rows are spread; a group then goes through one
    task, so it is for checks rather than for speed. Integer overflow is an error; as
    Spark evaluates lazily, it shows where the value is read, or in
    :meth:`Execution.row_counts`, which evaluates all of it.
    """
    spark = table.df.sparkSession
    if spark.conf.get("spark.sql.ansi.enabled") != "true":
        raise RuntimeError("integer overflow must be an error: set spark.sql.ansi.enabled to true")
    assert isinstance(plan.steps[0], Scan)
    steps = run_from(plan, 0, scan_table(table, without), [], exact_order, gather_bytes)
    frame = without
    if isinstance(without, list):
        frame = spark.createDataFrame([(r,) for r in without], f"{RID} bigint")
    return Execution(plan, table, steps, frame)


def predicate_value(source: StepTable, predicate: object, rows: DataFrame) -> bool | None:
    """TRUE, FALSE or None (can't be decided) for the first of ``rows``, identities of ``source``."""
    value = to_column(predicate, source.schema, source.refs())
    found = source.matching(rows).select(value.alias("value")).first()
    return found["value"]
