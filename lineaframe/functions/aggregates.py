"""Plan aggregates as Spark columns, and order statistics of groups of any size."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineaframe.functions.scalars import finite
from lineaframe.plans.plan import Agg
from lineaframe.plans.types import Kind

#: Aggregates that need the values of a group in order.
ORDERED = frozenset(("median", "percentile"))
#: Relative error of the quantile sketches that bracket order statistics; the statistics themselves are exact.
SKETCH = 10_000


def exact_total(c: Column) -> Column:
    """Sum of integers, in wide arithmetic: an overflow shows in the final total only, wherever rows are."""
    return F.sum(c.cast("decimal(38,0)"))


def encoded(keys: Sequence[str]) -> Column:
    """Group keys as one text that tells any two groups apart."""
    shown = [F.col(k).cast("string") for k in keys]
    return F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in shown])


def row_order_totals(df: DataFrame, keys: Sequence[str], position: str, totals: Mapping[str, str]) -> DataFrame:
    """``__key`` (of :func:`encoded`) and decimal totals, each value added in the order of ``position``, bit for bit.

    ``totals`` maps names to columns. A group is streamed through one task in
    sorted order, batch by batch, and never held in memory; adding in a fixed
    order can't be shared out.
    """
    names = list(totals)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sums = None, np.zeros(len(names))
        for batch in batches:
            if not len(batch):
                continue
            changes = np.flatnonzero(batch["__key"].to_numpy()[1:] != batch["__key"].to_numpy()[:-1]) + 1
            done = []
            for lo, hi in zip([0, *changes], [*changes, len(batch)], strict=True):
                if batch["__key"].iloc[lo] != key:
                    if key is not None:
                        done.append((key, *sums))
                    key, sums = batch["__key"].iloc[lo], np.zeros(len(names))
                for i, name in enumerate(names):
                    values = batch[name].to_numpy()[lo:hi]
                    # a running sum adds one value after the other
                    sums[i] = np.cumsum(np.append(sums[i], values[~np.isnan(values)]))[-1]
            yield pd.DataFrame(done, columns=["__key", *names])
        if key is not None:
            yield pd.DataFrame([(key, *sums)], columns=["__key", *names])

    rows = df.select(encoded(keys).alias("__key"), F.col(position).alias("__at"), *[F.col(c).cast("double").alias(n) for n, c in totals.items()])
    dealt = rows.repartition("__key") if keys else rows.repartition(1)
    return dealt.sortWithinPartitions("__key", "__at").drop("__at").mapInPandas(added, "__key string, " + ", ".join(f"{n} double" for n in names))


def _ranked(c: Column, pick: Callable[[Column], Column]) -> Column:
    """``pick`` from the sorted present values of a group, which are sorted once."""
    return F.element_at(F.transform(F.array(F.sort_array(F.collect_list(c))), pick), 1)


def _nearest(c: Column, p: int) -> Column:
    return _ranked(c, lambda a: F.get(a, (_whole(F.size(a) * p + 99, 100) - 1).cast("int")))


def _median(c: Column) -> Column:
    def middle(a: Column) -> Column:
        lo = F.get(a, _whole(F.size(a) - 1, 2).cast("int"))
        hi = F.get(a, _whole(F.size(a), 2).cast("int"))
        return F.when(F.size(a) > 0, halfway(lo, hi))

    return _ranked(c, middle)


def halfway(lo: Column, hi: Column) -> Column:
    """Mean of two decimals, also where their sum is too large."""
    plain = (lo + hi) / 2
    return F.when(F.abs(plain) < F.lit(float("inf")), plain).otherwise(lo / 2 + hi / 2)


def _whole(a: Column, b: int) -> Column:
    """Integer quotient of non-negative whole numbers."""
    return ((a - a % b) / b).cast("bigint")


def simple(agg: Agg, c: Column | None, kind: Kind | None) -> Column:
    """The aggregate over a group; decimals add in any order."""
    match agg.fn:
        case "count":
            return F.count(F.lit(1))
        case "count_non_null":
            return F.count(c)
        case "min":
            return F.min(c)
        case "max":
            return F.max(c)
        case "median":
            return _median(c.cast("double"))
        case "percentile":
            return _nearest(c, agg.p)
    if kind is Kind.INTEGER:
        total = exact_total(c)
        return total.cast("bigint") if agg.fn == "sum" else total.cast("double") / F.count(c)
    return finite(F.sum(c) if agg.fn == "sum" else F.sum(c) / F.count(c))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, wanted: Sequence[tuple[str, Agg]]) -> DataFrame:
    """Medians and percentiles of ``value`` for groups of any size, without keys too.

    A quantile sketch of each group, combined before the shuffle, brackets every
    wanted rank. Values inside a bracket are counted by value, those below only
    by bracket, also combined before the shuffle; then running counts over the
    values of a bracket find the rank. So the task that sorts a group sees a few
    of every ``SKETCH`` rows, however many there are. Returns the key columns and
    one column for each of ``wanted``; groups without a value are left out.
    """
    present = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    slack = 2 / SKETCH
    centres = [(agg.p or 50) / 100 for _, agg in wanted]
    ends = [min(1.0, max(0.0, c + d)) for c in centres for d in (-slack, slack)]
    sketch = present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", ends, SKETCH).alias("__q"), F.min("__v").alias("__least"), F.max("__v").alias("__most")
    )
    if keys:
        renamed = sketch.select(*[F.col(k).alias(f"__{k}") for k in keys], "__n", "__q", "__least", "__most")
        bounded = present.join(renamed, reduce(and_, [present[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]))
    else:
        one = sketch.first()
        if one is None or not one["__n"]:
            return sketch.select(*[F.lit(None).cast("double").alias(n) for n, _ in wanted]).where("false")
        kind = present.schema["__v"].dataType
        shown = lambda x: F.lit(x.isoformat(sep=" ") if isinstance(x, dt.datetime) else x).cast(kind)
        bounded = present.select(
            "*", F.lit(one["__n"]).alias("__n"), F.array(*[shown(x) for x in one["__q"]]).alias("__q"), shown(one["__least"]).alias("__least"), shown(one["__most"]).alias("__most")
        )
    # a rank near an end of the group is bracketed by the least or greatest value; ranks are off by one at most from n times the centre
    low = [F.when(F.col("__n") * (c - slack) <= 2, F.col("__least")).otherwise(F.get("__q", F.lit(2 * i))) for i, c in enumerate(centres)]
    high = [F.when(F.col("__n") * (1 - c - slack) <= 2, F.col("__most")).otherwise(F.get("__q", F.lit(2 * i + 1))) for i, c in enumerate(centres)]
    v = F.col("__v")
    inside = [v.between(lo, hi) for lo, hi in zip(low, high, strict=True)]
    marked = bounded.select(
        *keys, "__n", F.array(*[v < lo for lo in low]).alias("__below"), F.array(*inside).alias("__inside"), F.when(reduce(or_, inside), v).alias("__v")
    )
    counted = marked.groupBy(*keys, "__n", "__below", "__inside", "__v").agg(F.count(F.lit(1)).alias("__k"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    in_order = group.orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    n, columns = F.col("__n"), []
    ranked = counted
    for i, (name, agg) in enumerate(wanted):
        here = F.when(F.get("__inside", F.lit(i)), F.col("__k")).otherwise(0)
        below = F.sum(F.when(F.get("__below", F.lit(i)), F.col("__k")).otherwise(0)).over(group)
        upto = below + F.sum(here).over(in_order)
        ranked = ranked.withColumn(f"__upto{i}", upto).withColumn(f"__from{i}", upto - here)

        def at(rank: Column, i: int = i) -> Column:
            found = F.max(F.when((F.col(f"__from{i}") < rank) & (rank <= F.col(f"__upto{i}")), F.col("__v")))
            return F.coalesce(found, F.raise_error(F.lit("the quantile sketch missed a rank")).cast(present.schema["__v"].dataType))

        if agg.fn == "percentile":
            columns.append(at(_whole(n * agg.p + 99, 100)).alias(name))
        else:
            columns.append(halfway(at(_whole(n + 1, 2)).cast("double"), at(_whole(n, 2) + 1).cast("double")).alias(name))
    return ranked.groupBy(*keys).agg(*columns)
