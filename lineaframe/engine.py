"""The engine as callers see it: snapshots in, checked answers out.

Answers are plain dictionaries, ready for JSON. An invalid plan is an answer
(``ok`` false, with the reason and the step); a wrong call raises ``ValueError``.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaframe.operators.counterfactual import Refused, contributions, exclude
from lineaframe.operators.execution import Execution, StepTable, execute, predicate_value
from lineaframe.operators.lineage import Lineage
from lineaframe.plans.describe import describe
from lineaframe.plans.plan import OP_NAMES, Filter, Limit, Plan, PlanProblem, Scan, ValidPlan, validate
from lineaframe.plans.planjson import read_plan
from lineaframe.plans.types import Kind, Schema
from lineaframe.sources.tables import RID, Table

#: Output rows that a run returns at once.
INLINE_ROWS = 500
#: Names of the kinds in answers.
TYPE_NAMES = {
    Kind.INTEGER: "I64",
    Kind.DECIMAL: "F64",
    Kind.BOOLEAN: "Bool",
    Kind.TIMESTAMP: "Timestamp",
    Kind.TEXT: "DictUtf8",
    Kind.LOCATION: "Geo",
}


def cell(x: object) -> object:
    """A value for JSON: integers beyond 2^53 as text, times as text, locations as pairs."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return x if abs(x) <= 2**53 else str(x)
    if isinstance(x, dt.datetime):
        return x.strftime("%Y-%m-%dT%H:%M:%S.%f").rjust(26, "0")
    if isinstance(x, tuple):
        return list(x)
    return x


def schema_json(schema: Schema) -> list[dict]:
    return [{"name": f.name, "type": TYPE_NAMES[f.kind], "nullable": f.nullable} for f in schema]


@dataclass
class Live:
    """An execution that callers can ask about; ``base`` is the run a counterfactual came from."""

    execution: Execution
    lineage: Lineage
    base: int | None = None
    excluded: frozenset[int] = frozenset()
    output: DataFrame | None = field(default=None)


class Engine:
    """Holds snapshots and executions of one Spark session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.live: dict[int, Live] = {}
        self.next_id = 0
        self._sizes: dict[str, int] = {}

    # ---- snapshots

    def register(self, snapshot: str, table: Table) -> None:
        """Make a table that needs no verifying scannable under a 64-digit hex name."""
        self.tables[snapshot] = table

    def load_snapshot(self, path: str) -> dict:
        """Verify a snapshot directory, all hashes included, then make it scannable under its hash."""
        from lineaframe.sources.snapshot import open_snapshot

        began = time.monotonic()
        snapshot, table, manifest = open_snapshot(self.spark, path)
        self.tables[snapshot] = table
        return {
            "snapshot_hash": snapshot,
            "title": table.info.title,
            "rows": manifest["rows"],
            "columns": schema_json(table.schema),
            "known_issues": manifest["known_issues"],
            "verify_ms": _ms(began),
        }

    def _size(self, snapshot: str) -> int:
        if snapshot not in self._sizes:
            self._sizes[snapshot] = self.tables[snapshot].df.agg(F.coalesce(F.max(RID) + 1, F.lit(0))).first()[0]
        return self._sizes[snapshot]

    # ---- plans

    def _valid(self, plan: Plan | str | dict) -> ValidPlan:
        made = plan if isinstance(plan, Plan) else read_plan(plan)
        return validate(made, {name: t.info for name, t in self.tables.items()})

    def validate_plan(self, plan: Plan | str | dict) -> dict:
        try:
            valid = self._valid(plan)
        except PlanProblem as e:
            return {"ok": False, "error": e.message, "step": e.step}
        steps = [
            {"op": OP_NAMES[type(s)], "sentence": words, "node_hash": h, "columns": schema_json(schema)}
            for s, words, h, schema in zip(valid.steps, describe(valid), valid.hashes, valid.schemas, strict=True)
        ]
        return {"ok": True, "plan_hash": valid.plan_hash, "steps": steps}

    def run(self, plan: Plan | str | dict) -> dict:
        began = time.monotonic()
        try:
            valid = self._valid(plan)
        except PlanProblem as e:
            return {"ok": False, "error": e.message, "step": e.step}
        return self._register(Live(execution := execute(valid, self._table(valid)).pin(), Lineage(execution)), began)

    def _table(self, valid: ValidPlan) -> Table:
        scan = valid.steps[0]
        assert isinstance(scan, Scan)
        return self.tables[scan.snapshot]

    def _register(self, live: Live, began: float, **more: object) -> dict:
        execution = live.execution
        try:
            counts = execution.row_counts()
            rows = self._cells(execution.output, 0, INLINE_ROWS)
        except Exception as e:  # overflow and the like surface when rows are computed
            if getattr(e, "getCondition", lambda: None)() in _OVERFLOWS:
                step, why = execution.overflow() or (None, "a number is too large for 64 bits")
                execution.release()
                return {"ok": False, "error": why, "step": step}
            raise
        number = self.next_id
        self.next_id += 1
        self.live[number] = live
        return {
            "ok": True,
            "execution": number,
            "plan_hash": execution.plan.plan_hash,
            "ms": _ms(began),
            "steps": [{"sentence": s, "rows": n} for s, n in zip(describe(execution.plan), counts, strict=True)],
            "output": {"columns": schema_json(execution.output.schema), "total_rows": counts[execution.plan.output], "rows": rows},
            **more,
        }

    def _cells(self, table: StepTable, start: int, count: int) -> list[list]:
        found = table.visible()
        if start:
            found = found.offset(start)
        return [[cell(tuple(x) if isinstance(x, tuple) else x) for x in row] for row in found.limit(count).collect()]

    def _live(self, number: int) -> Live:
        if number not in self.live:
            raise ValueError(f"no execution {number}")
        return self.live[number]

    def rows(self, number: int, start: int, count: int) -> list[list]:
        """A page of the output."""
        return self._cells(self._live(number).execution.output, start, count)

    def result(self, number: int) -> DataFrame:
        """The whole output as a DataFrame."""
        return self._live(number).execution.result()

    def drop_execution(self, number: int) -> bool:
        """Forget an execution; counterfactuals that came from it can't be taken further."""
        found = self.live.pop(number, None)
        if found:
            found.execution.release()
        return found is not None

    # ---- lineage

    def _backward(self, number: int, row: int):  # noqa: ANN202
        live = self._live(number)
        try:
            return live.lineage.backward_row(live.execution.plan.output, row)
        except IndexError as e:
            raise ValueError(str(e)) from None

    def trace_back(self, number: int, row: int) -> dict:
        """How many rows of each step stand behind one output row."""
        began = time.monotonic()
        counts = self._backward(number, row).counts()
        return {
            "source": 0,
            "ms": _ms(began),
            "path": [{"step": s, "rows": n} for s, n in counts],
            "source_rows": counts[-1][1],
        }

    def trace_back_frame(self, number: int, row: int) -> DataFrame:
        """Numbers of the source rows behind an output row; a group can be most of the table."""
        return self._backward(number, row).source

    def trace_back_rows(self, number: int, row: int) -> Iterator[int]:
        """The same, in order, fetched part by part."""
        return (r[RID] for r in self.trace_back_frame(number, row).orderBy(RID).toLocalIterator())

    def trace_forward(self, number: int, source_row: int) -> dict:
        """Where one source row goes, step by step, and if it doesn't reach the output, what dropped it and why."""
        live = self._live(number)
        plan, lineage = live.execution.plan, live.lineage
        scan = plan.steps[0]
        assert isinstance(scan, Scan)
        if scan.snapshot not in self.tables:
            raise ValueError("that execution's snapshot is no longer loaded")
        if not 0 <= source_row < (size := self._size(scan.snapshot)):
            raise ValueError(f"row {source_row} is past the snapshot's {size} rows")
        sentences = describe(plan)
        answer = {"source_row": source_row, "reaches_output": False, "output_row": None, "path": [], "dropped": None}
        if source_row in live.excluded:
            return answer | {"dropped": {"step": 0, "sentence": sentences[0], "reason": {"kind": "excluded"}}}
        path: list[dict] = []
        frames = lineage.forward_path([source_row])
        places = lineage.places([source_row], frames)
        for step, _ in frames:
            if step not in places:
                op = plan.steps[step]
                reason: dict = {"kind": "other"}
                if isinstance(op, Filter):
                    before = live.execution.steps[op.input]
                    reason = {"kind": "filter", "value": predicate_value(before, op.predicate, frames[step - 1][1])}
                elif isinstance(op, Limit):
                    reason = {"kind": "limit", "position": path[-1]["row"], "count": str(op.count)}
                return answer | {"path": path, "dropped": {"step": step, "sentence": sentences[step], "reason": reason}}
            path.append({"step": step, "row": places[step]})
        return answer | {"reaches_output": True, "output_row": path[-1]["row"], "path": path}

    def source_records(self, snapshot: str, rows: Iterable[int]) -> dict:
        """Source rows, all columns, in the order asked for."""
        if snapshot not in self.tables:
            raise ValueError("snapshot not loaded")
        table, wanted = self.tables[snapshot], list(rows)
        columns = table.columns()
        found = {
            r[RID]: [cell(tuple(r[c]) if isinstance(r[c], tuple) else r[c]) for c in columns.values()]
            for r in table.df.where(F.col(RID).isin(wanted)).select(RID, *columns.values()).collect()
        }
        for r in wanted:
            if r not in found:
                raise ValueError(f"row {r} is past the snapshot")
        return {"columns": list(columns), "rows": [found[r] for r in wanted]}

    # ---- counterfactuals

    def exclude(self, number: int, rows: Iterable[int]) -> dict:
        """The result without source rows. Excluding from a counterfactual excludes the union from its base."""
        began = time.monotonic()
        live = self._live(number)
        base_number = number if live.base is None else live.base
        gone = live.excluded | frozenset(rows)
        if base_number not in self.live:
            raise ValueError("the execution this counterfactual came from was dropped")
        found = exclude(self.live[base_number].execution, gone)
        made = Live(found.execution, Lineage(found.execution), base_number, gone)
        return self._register(made, began, method=found.method, excluded=len(gone))

    def contributions(self, number: int, row: int, column: str, top: int) -> dict:
        """What a cell would be without each row behind it; the rows that move it most come first."""
        began = time.monotonic()
        live = self._live(number)
        try:
            found = contributions(live.execution, row, column)
        except (Refused, IndexError) as e:
            raise ValueError(str(e)) from None
        ranked = found.ranked(top).collect()
        return {
            "column": column,
            "current": _number(found.current),
            "exact": found.exact,
            "contributing_rows": found.count,
            "rows_that_change_it": found.changing(),
            "ms": _ms(began),
            "top": [
                {"source_row": r["source_row"], "without": _number(r["without"]), "removes_group": r["removes_group"]} for r in ranked
            ],
        }


_OVERFLOWS = frozenset(("ARITHMETIC_OVERFLOW", "CAST_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "DATETIME_OVERFLOW"))
_EPOCH = dt.datetime(1970, 1, 1)


def _number(x: object) -> object:
    """Contributions give times as microseconds."""
    return (x - _EPOCH) // dt.timedelta(microseconds=1) if isinstance(x, dt.datetime) else x


def _ms(began: float) -> float:
    return round((time.monotonic() - began) * 1000, 3)
