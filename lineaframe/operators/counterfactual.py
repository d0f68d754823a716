"""Results without chosen source rows, and what each row does to a cell."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from lineaframe.functions.aggregates import halfway
from lineaframe.functions.scalars import finite
from lineaframe.operators.execution import GATHER_BYTES, INLINE_ROWS, Execution, StepTable, aggregate_step, execute, known, narrowed, run_from
from lineaframe.operators.lineage import Lineage
from lineaframe.plans.plan import Agg, Aggregate, Filter, Map, Project, Sort, ValidPlan
from lineaframe.plans.types import Kind
from lineaframe.sources.tables import RID

#: Relative error of the quantile sketch that brackets an order statistic; the statistic itself is exact.
SKETCH = 10_000
#: Values that one task sorts without a sketch.
SORTED_AT_ONCE = 100_000


class Refused(Exception):
    """A question that has no answer, in plain English."""


@dataclass(frozen=True)
class Counterfactual:
    execution: Execution
    method: dict


def incremental_step(plan: ValidPlan) -> int | None:
    """The one aggregate of a plan with only one-to-one steps, filters and sorts below it; else None."""
    found = [i for i, s in enumerate(plan.steps) if isinstance(s, Aggregate)]
    if len(found) != 1:
        return None
    below = plan.steps[1 : found[0]]
    return found[0] if all(isinstance(s, Filter | Map | Project | Sort) for s in below) else None


def exclude(base: Execution, rows: Iterable[int] | DataFrame, exact_order: bool = False) -> Counterfactual:
    """The execution without the given source rows, and how it was found.

    ``unchanged``: no row reaches the aggregate. ``incremental``: only the
    groups the rows were in are computed again, the others are the base's.
    ``rerun``: everything is. All give what a run over the remaining rows
    gives. Rows that don't exist, or are named twice, do no harm.
    """
    listed = None if isinstance(rows, DataFrame) else sorted(set(rows))
    if listed == []:
        return Counterfactual(base, {"kind": "unchanged"})
    number = incremental_step(base.plan)
    inline = listed is not None and len(listed) <= INLINE_ROWS
    gone = rows.select(RID).distinct() if listed is None else base.table.df.sparkSession.createDataFrame([(r,) for r in listed], f"{RID} bigint")
    if number is None:
        return Counterfactual(execute(base.plan, base.table, listed if inline else gone, exact_order), {"kind": "rerun"})
    step = base.plan.steps[number]
    assert isinstance(step, Aggregate)
    source, whole = base.steps[step.input], base.steps[number]
    removed = source.df.where(F.col(RID).isin(listed)) if inline else source.df.join(gone, RID, "left_semi")
    keys = whole.identity
    held: list[DataFrame] = []
    if not keys:
        if removed.isEmpty():
            return Counterfactual(replace(base, excluded=gone), {"kind": "unchanged"})
        groups, left = 1, source.df.join(gone, RID, "left_anti")
        after = _recomputed(step, number, source, left, base, exact_order).df
    else:
        hit = removed.select(*keys).distinct().persist()
        groups = hit.count()
        held.append(hit)
        if not groups:
            hit.unpersist()
            return Counterfactual(replace(base, excluded=gone), {"kind": "unchanged"})
        left = narrowed(source.df, hit, keys).join(gone, RID, "left_anti")
        again = _recomputed(step, number, source, left, base, exact_order).df
        kept = narrowed(whole.df, hit, keys, "left_anti")
        after = kept.unionByName(again)
    first = replace(whole, df=after)
    steps = run_from(base.plan, number, first, base.steps[:number], exact_order)
    execution = Execution(base.plan, base.table, steps, gone, held)
    return Counterfactual(execution, {"kind": "incremental", "groups_recomputed": groups})


def _recomputed(step: Aggregate, number: int, source: StepTable, left: DataFrame, base: Execution, exact_order: bool) -> StepTable:
    return aggregate_step(step, number, replace(source, df=left), base.plan.schemas[number], exact_order, GATHER_BYTES)


@dataclass(frozen=True)
class Contributions:
    """``rows`` has ``source_row, without, removes_group`` for every contributing row."""

    aggregate: int
    column: str
    current: object
    exact: bool
    rows: DataFrame
    count: int

    def ranked(self, top: int) -> DataFrame:
        """Rows by how far the cell moves without them, then by row number; a value that comes or goes moves furthest."""
        return self.rows.withColumn("moves", self._moves()).orderBy(F.col("moves").desc(), "source_row").limit(top)

    def _moves(self) -> Column:
        kind = self.rows.schema["without"].dataType
        zero = F.lit("1970-01-01").cast("timestamp_ntz")
        number = lambda c: F.timestamp_diff("MICROSECOND", zero, c) if isinstance(kind, TimestampNTZType) else c
        now = number(known(self.current, kind)).cast("double")
        then = number(F.col("without")).cast("double")
        return (
            F.when(then.isNull() & now.isNull(), F.lit(0.0)).when(then.isNull() | now.isNull(), F.lit(float("inf"))).otherwise(F.abs(then - now))
        )

    def changing(self) -> int:
        """Rows without which the cell changes or its row goes."""
        return self.rows.where(F.col("removes_group") | (self._moves() > 0)).count()


def order_values(rows: DataFrame, name: str, ranks: list[int], n: int) -> list[object]:
    """Values at 0-based ranks of the ``n`` present values of a column, exactly; None for ranks that don't exist.

    Equal values are counted, and running counts over the sorted distinct values
    find the ranks. Of more than ``SORTED_AT_ONCE`` values a quantile sketch
    brackets the ranks first and only values inside the bracket are sorted, so
    the task that sorts sees a few of every ``SKETCH`` rows.
    """
    real = sorted({r for r in ranks if 0 <= r < n})
    if not real:
        return [None] * len(ranks)
    present = rows.where(F.col(name).isNotNull())
    if n > SORTED_AT_ONCE:
        kind, slack = rows.schema[name].dataType, 2 / SKETCH
        lo, hi = max(0.0, real[0] / n - slack), min(1.0, (real[-1] + 1) / n + slack)
        bounds = present.agg(F.percentile_approx(name, [lo, hi], SKETCH).alias("b"), F.min(name).alias("least"), F.max(name).alias("most")).first()
        low = known(bounds["least"] if lo == 0.0 else bounds["b"][0], kind)
        high = known(bounds["most"] if hi == 1.0 else bounds["b"][1], kind)
        # what lies below the bracket is counted as one missing value, which comes first
        present = present.where(F.col(name) <= high).withColumn(name, F.when(F.col(name) >= low, F.col(name)))
    counted = present.groupBy(name).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.orderBy(F.col(name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select(name, upto.alias("upto"), "k")
    at = lambda r: F.max(F.when((F.col("upto") - F.col("k") <= r) & (F.col("upto") > r), F.col(name)))
    found = ranked.agg(*[at(r).alias(f"r{r}") for r in real]).first()
    if any(found[f"r{r}"] is None for r in real):
        raise RuntimeError("the quantile sketch missed a rank")
    return [found[f"r{r}"] if r in real else None for r in ranks]


def contributions(base: Execution, row: int, column: str) -> Contributions:
    """What the cell ``column`` of an output row would be without each row behind it.

    Every answer is exact but those for decimal totals and means, which are
    "total minus value". With one row gone, the k-th smallest of the rest is the
    (k+1)-th of all for a row at or below the k-th, else the k-th; so medians,
    percentiles and extremes need two or four order statistics of the group and
    one comparison a row.
    """
    number = incremental_step(base.plan)
    if number is None:
        raise Refused("contributions need a plan with one aggregate and only filter, map, project or sort before it")
    step = base.plan.steps[number]
    assert isinstance(step, Aggregate)
    spec = next((a for a in step.aggregates if a.name == column), None)
    if spec is None:
        raise Refused(f'"{column}" is not an aggregate of step {number}')
    whole = base.steps[number]
    cell = whole.columns[column]
    trace = Lineage(base).backward_row(base.plan.output, row, cell)  # steps after the aggregate keep its columns
    current = trace.values[cell]
    rows = _members(base, step.input, whole, trace.values)
    source = base.steps[step.input]
    kind = source.schema.find(spec.column).kind if spec.column else None
    x = F.col(source.columns[spec.column]) if spec.column else None
    summed = spec.fn in ("sum", "mean")
    total = F.sum(x.cast("decimal(38,0)") if kind is Kind.INTEGER else x) if summed else F.lit(None)
    facts = rows.agg(F.count(F.lit(1)).alias("rows"), (F.lit(0) if x is None else F.count(x)).alias("present"), total.alias("total")).first()
    without, exact = _without(spec, kind, x, rows, facts, current)
    gone = F.lit(bool(step.group_by) and facts["rows"] == 1)
    out = rows.select(F.col(RID).alias("source_row"), without.alias("without"), gone.alias("removes_group"))
    return Contributions(number, column, current, exact, out, facts["rows"])


def _members(base: Execution, number: int, whole: StepTable, values: Mapping[str, object]) -> DataFrame:
    """All columns of the rows of step ``number`` that are in the group with these key values."""
    table = Lineage(base).table(number)
    keys = whole.identity
    return table.df.where(reduce(and_, [F.col(k).eqNullSafe(known(values[k], table.df.schema[k].dataType)) for k in keys])) if keys else table.df


def _without(spec: Agg, kind: Kind | None, x: Column | None, rows: DataFrame, facts: Row, current: object) -> tuple[Column, bool]:
    """The cell without a row, as a column of the group's rows, and whether it is exact."""
    n, total = facts["present"], facts["total"]
    if spec.fn == "count":
        return F.lit(facts["rows"] - 1).cast("bigint"), True
    present = F.when(x.isNotNull(), F.lit(1)).otherwise(F.lit(0))
    if spec.fn == "count_non_null":
        return (F.lit(n).cast("bigint") - present), True
    if kind in (Kind.TEXT, Kind.BOOLEAN):
        raise Refused(f"contributions to the {spec.fn} of text or true/false values aren't supported")
    if spec.fn in ("sum", "mean"):
        left = F.lit(n) - present
        if kind is Kind.INTEGER:
            rest = F.lit(total).cast("decimal(38,0)") - F.coalesce(x, F.lit(0)).cast("decimal(38,0)")
            return F.when(left > 0, rest.try_cast("bigint") if spec.fn == "sum" else rest.cast("double") / left), True
        rest = F.lit(total).cast("double") - F.coalesce(x, F.lit(0.0))
        return F.when(left > 0, finite(rest if spec.fn == "sum" else rest / left)), False
    name, m = "__x", n - 1
    typed = x.cast("double") if spec.fn == "median" else x
    valued = rows.select("*", typed.alias(name))
    if spec.fn == "median":
        wanted = [m // 2] if m % 2 else [m // 2 - 1, m // 2]
    else:
        wanted = [{"min": 0, "max": m - 1}.get(spec.fn, max(1, (m * (spec.p or 0) + 99) // 100) - 1)]
    kind_now = valued.schema[name].dataType
    if m <= 0:
        return F.when(x.isNull(), known(current, kind_now)), True
    stats = order_values(valued, name, [r for k in wanted for r in (k, k + 1)], n)
    rest = []
    for i in range(len(wanted)):
        here, after = (known(v, kind_now) for v in stats[2 * i : 2 * i + 2])
        rest.append(F.when(typed <= here, after).otherwise(here))
    value = rest[0]
    if len(rest) == 2:
        value = halfway(*rest)
    return F.when(x.isNull(), known(current, kind_now)).otherwise(value), True
