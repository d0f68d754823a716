"""Which source rows stand behind a result row, and where a source row ends up.

Nothing is recorded while a plan runs. Up to the first aggregate a row is known
by its row number, beyond it by its group's keys; so to go back over an
aggregate is a null-safe semi-join of its input on the keys, or a filter that
reaches the scan where the keys are those of one row, and all other steps keep
what identifies a row. Rows are DataFrames of identity columns; groups are never
gathered into lists. A question takes one job to find the row it is about, and
one to answer.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineaframe.operators.execution import INLINE_ROWS, Execution, StepTable, known, narrowed
from lineaframe.plans.plan import Aggregate, Scan
from lineaframe.sources.tables import RID

#: Backward traces of single rows that are remembered.
REMEMBERED = 256


@dataclass(frozen=True)
class Trace:
    """Rows at every step from the one asked about down to the scan; ``single`` holds the steps at which they are one row."""

    path: list[tuple[int, DataFrame]]
    single: frozenset[int] = frozenset()
    values: Mapping[str, object] = field(default_factory=dict)

    @property
    def source(self) -> DataFrame:
        """Row numbers of the source rows."""
        return self.path[-1][1]

    def counts(self) -> list[tuple[int, int]]:
        """Rows of every step, in one job; steps that share their rows are counted once."""
        frames = {id(rows): rows for step, rows in self.path if step not in self.single}
        counted = [rows.agg(F.count(F.lit(1)).alias("n")).withColumn("frame", F.lit(i)) for i, rows in enumerate(frames.values())]
        found = {r["frame"]: r["n"] for r in reduce(DataFrame.union, counted).collect()} if counted else {}
        place = {key: i for i, key in enumerate(frames)}
        return [(step, 1 if step in self.single else found[place[id(rows)]]) for step, rows in self.path]


class Lineage:
    """Traces through one execution."""

    def __init__(self, execution: Execution) -> None:
        self.execution = execution
        self._remembered: OrderedDict[tuple, Trace] = OrderedDict()

    def table(self, step: int) -> StepTable:
        """The step's table without rows that a counterfactual has excluded.

        An incremental counterfactual keeps the tables of its base below the
        aggregate, as its step counts do; the excluded rows trace to nothing.
        """
        found = self.execution.steps[step]
        if found.identity == (RID,) and self.execution.excluded is not None:
            df = found.df.join(self.execution.excluded.select(RID), RID, "left_anti")
            return StepTable(df, found.schema, found.columns, found.order, found.identity)
        return found

    def nth(self, step: int, row: int, *more: str) -> dict | None:
        """Identity and order columns (and ``more``) of the row at a place of a step; None past its end."""
        table = self.execution.steps[step]
        names = list(dict.fromkeys([*table.identity, *(c for c, _ in table.order), *more]))
        found = table.ordered().select(*[F.col(n) for n in names] or [F.lit(0).alias("one")]).offset(row).limit(1).collect()
        return found[0].asDict() if found else None

    def found(self, step: int, row: int, *more: str) -> dict:
        """The same; past the end is an error."""
        values = self.nth(step, row, *more)
        if values is None:
            raise IndexError(f"row {row} is past the output" if step == self.execution.plan.output else f"row {row} is past step {step}")
        return values

    def row(self, step: int, row: int) -> DataFrame:
        """One row of a step, by its place, as identities."""
        return self._one(self.execution.steps[step], self.execution.steps[step].identity, self.found(step, row))

    def _one(self, table: StepTable, keys: Sequence[str], values: Mapping[str, object]) -> DataFrame:
        """Identities of the rows of ``table`` whose ``keys`` have these values."""
        if not keys:
            return table.idents()
        return table.idents(table.df.where(reduce(and_, [F.col(n).eqNullSafe(known(values[n], table.df.schema[n].dataType)) for n in keys])))

    def place(self, step: int, rows: DataFrame) -> int | None:
        """Place of the first of ``rows`` in a step; None if there is none."""
        table = self.execution.steps[step]
        names = [c for c, _ in table.order]
        there = StepTable(table.matching(rows), table.schema, table.columns, table.order, table.identity)
        found = there.ordered().select(*[F.col(n) for n in dict.fromkeys(names)] or [F.lit(0).alias("one")]).first()
        if found is None:
            return None
        return table.df.where(table.before(found.asDict())).count() if names else 0

    def backward(self, step: int, rows: DataFrame, values: Mapping[str, object] | None = None) -> Trace:
        """Rows at every step that stand behind ``rows`` of ``step``: all members of a group, also those without a value.

        ``values`` are the identity columns of ``rows``, where they are one row.
        """
        path, single = [(step, rows)], {step} if values is not None else set()
        while not isinstance(op := self.execution.plan.steps[step], Scan):
            source = self.table(op.input)
            if isinstance(op, Aggregate):
                keys = self.execution.steps[step].identity
                if values is not None or not keys:
                    rows, values = self._one(source, keys, values or {}), None
                else:
                    rows = source.idents(narrowed(source.df, rows.distinct(), keys))
            step = op.input
            path.append((step, rows))
            if values is not None:
                single.add(step)
        return Trace(path, frozenset(single))

    def backward_row(self, step: int, row: int, *more: str) -> Trace:
        """The trace of one row, by its place, with the values of its columns; the latest are remembered."""
        key = (step, row, *more)
        if key not in self._remembered:
            values = self.found(step, row, *more)
            table = self.execution.steps[step]
            trace = self.backward(step, self._one(table, table.identity, values), values)
            self._remembered[key] = replace(trace, values=values)
        self._remembered.move_to_end(key)
        if len(self._remembered) > REMEMBERED:
            self._remembered.popitem(last=False)
        return self._remembered[key]

    def numbers(self, rows: Iterable[int] | DataFrame) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows.select(RID)
        spark = self.execution.table.df.sparkSession
        return spark.createDataFrame([(r,) for r in rows], f"{RID} bigint")

    def forward_path(self, rows: Iterable[int] | DataFrame, step: int | None = None) -> list[tuple[int, DataFrame]]:
        """Rows of every step, from the scan on, that come from the given source rows."""
        target = self.execution.plan.output if step is None else step
        listed = None if isinstance(rows, DataFrame) else sorted(set(rows))
        scan = self.table(0)
        inline = listed is not None and len(listed) <= INLINE_ROWS
        found = scan.df.where(F.col(RID).isin(listed)).select(RID) if inline else scan.df.join(self.numbers(rows), RID, "left_semi").select(RID)
        path = [(0, found)]
        for number in range(1, target + 1):
            op = self.execution.plan.steps[number]
            table = self.table(number)
            if inline and table.identity == (RID,):
                found = table.df.where(F.col(RID).isin(listed)).select(RID)  # a filter, which reaches the scan
            elif isinstance(op, Aggregate):
                source = self.table(op.input)
                members = source.df.where(F.col(RID).isin(listed)) if inline and source.identity == (RID,) else source.matching(found)
                reached = members.select(*table.identity).distinct()
                found = reached if table.identity else table.df.where(F.lit(not found.isEmpty())).select()
            else:
                found = table.idents(table.matching(found))
            path.append((number, found))
        return path

    def places(self, rows: Sequence[int], path: Sequence[tuple[int, DataFrame]]) -> dict[int, int]:
        """For each step of the path of some source rows, the place of its first row; steps without a row are left out.

        Two jobs: the first rows of all steps, then how many rows come before each.
        """
        firsts = []
        for step, found in path:
            table = self.table(step)
            names = list(dict.fromkeys(c for c, _ in table.order))
            if table.identity == (RID,):
                there = table.df.where(F.col(RID).isin(list(rows)))
            else:  # the path of an aggregate holds its keys, which are its order
                there = found if isinstance(self.execution.plan.steps[step], Aggregate) else table.matching(found)
            if len(rows) > 1:
                there = StepTable(there, table.schema, table.columns, table.order, table.identity).ordered().limit(1)
            firsts.append(there.select(F.lit(step).alias("__step"), *names))
        at = {r["__step"]: r.asDict() for r in reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), firsts).collect()}
        before = []
        for step, row in at.items():
            table = self.execution.steps[step]
            ahead = table.df.where(table.before(row)) if table.order else table.df.where("false")
            before.append(ahead.agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(step)))
        return {r["step"]: r["n"] for r in reduce(DataFrame.union, before).collect()} if before else {}

    def forward(self, rows: Iterable[int] | DataFrame, step: int | None = None) -> DataFrame:
        """Rows of ``step`` (the output) that the given source rows reach; dropped rows reach nothing."""
        return self.forward_path(rows, step)[-1][1]

    def source_row(self, step: int, row: int) -> int | None:
        """The one source row of a row, where all steps are one-to-one; else None."""
        if self.execution.steps[step].identity != (RID,):
            return None
        found = self.nth(step, row)
        return None if found is None else found[RID]

    def packed(self, rows: DataFrame) -> DataFrame:
        """64-bit row ids: the number of the source, 16 bits kept free, 32 bits of row number.

        Row numbers beyond 32 bits have no packed id; they raise an error.
        """
        wide = F.raise_error(F.lit("a packed row id has 32 bits for the row number"))
        packed = F.shiftleft(F.lit(self.execution.table.source_id).cast("bigint"), 48).bitwiseOR(F.col(RID))
        return rows.select(F.when(F.col(RID) < 2**32, packed).otherwise(wide.cast("bigint")).alias("row_id"))
