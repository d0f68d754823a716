"""Scannable tables: any DataFrame with a schema of the six kinds and a row number."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineaframe.functions.scalars import SPARK_TYPES, finite
from lineaframe.plans.plan import SourceInfo
from lineaframe.plans.types import Field, Kind, Schema
from lineaframe.storage import keep

#: Name of the row number in every table and step; it never changes for a row.
RID = "_rid"
#: Names of files are broadcast up to this many.
BROADCAST_FILES = 100_000


@dataclass(frozen=True)
class Table:
    """``df`` has the row number and the columns of ``info.schema`` as ``c0, c1, ...``.

    Internal names are numbers because Spark compares names without case and
    reads dots; the engine compares them exactly.
    """

    info: SourceInfo
    df: DataFrame
    source_id: int = 0

    @property
    def schema(self) -> Schema:
        return self.info.schema

    def columns(self) -> dict[str, str]:
        return {f.name: f"c{i}" for i, f in enumerate(self.schema)}


def kind_of(t: T.DataType) -> Kind | None:
    """The kind a Spark type is read as; None for types that have no counterpart."""
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return Kind.INTEGER
    if isinstance(t, T.FloatType | T.DoubleType):
        return Kind.DECIMAL
    if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
        return Kind.TIMESTAMP
    if isinstance(t, T.StructType) and [f.name for f in t.fields] == ["lat", "lon"]:
        return Kind.LOCATION
    return {T.BooleanType: Kind.BOOLEAN, T.StringType: Kind.TEXT}.get(type(t))


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = RID) -> DataFrame:
    """``df`` with a dense row number 0, 1, ... in the given order, which must be total.

    Rows are sorted by ranges and written; then each row's number is its place
    in its range plus the sizes of the ranges before. No task sees all rows.
    """
    sorted_rows = df.orderBy(*order).select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__place"))
    written = keep(sorted_rows, "numbered")
    place = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))  # one row for each range
    offsets = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    numbered = written.join(F.broadcast(offsets), "__range").withColumn(name, place + F.col("__before"))
    return numbered.drop("__range", "__place", "__before")


def stored_numbers(df: DataFrame, name: str = RID) -> DataFrame | None:
    """``df``, read from files, with a row number that a row has for as long as the files are there; None for other DataFrames.

    The number is the place of the file among the sorted names, then the place
    of the row in its file; how Spark splits the files doesn't matter.
    """
    try:
        rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return None
    n_files = len(df.inputFiles())
    if n_files < 2:
        return rows.withColumn(name, F.col("__row")).drop("__file", "__row")
    if n_files > BROADCAST_FILES:
        return number_rows(rows, ["__file", "__row"], name).drop("__file", "__row")
    names = sorted(r[0] for r in rows.select("__file").distinct().collect())  # reads no column
    places = df.sparkSession.createDataFrame(list(enumerate(names)), "__place bigint, __name string")
    joined = rows.join(F.broadcast(places), F.col("__file") == F.col("__name"))
    return joined.withColumn(name, F.shiftleft("__place", 40) + F.col("__row")).drop("__file", "__row", "__place", "__name")


def from_dataframe(
    df: DataFrame, title: str, row_number: str | None = None, order: Sequence[str] = (), source_id: int = 0, as_stored: bool = False
) -> Table:
    """A table of a DataFrame's columns; arrays and other types without a counterpart are left out.

    Rows are numbered by the unique integer column ``row_number``, or else
    densely in the order of the columns ``order`` (all columns, if empty).
    ``as_stored`` numbers them as they lie in their files instead, with gaps
    between files, which costs next to nothing and holds for as long as the
    files do; a DataFrame that is no plain table of files is numbered densely.
    Integers widen to 64 bits, decimals that are not finite become missing.
    """
    rows = df if row_number else stored_numbers(df) if as_stored else None
    if rows is None:
        rows = number_rows(df, order or df.columns)
    number = F.col(f"`{row_number or RID}`").cast("bigint")
    fields, columns = [], [number.alias(RID)]
    for f in df.schema.fields:
        kind = kind_of(f.dataType)
        if kind is None:
            continue
        c = F.col(f"`{f.name}`").cast(SPARK_TYPES[kind])
        columns.append((finite(c) if kind is Kind.DECIMAL else c).alias(f"c{len(fields)}"))
        fields.append(Field(f.name, kind, f.nullable))
    return Table(SourceInfo(title, Schema.of(fields)), rows.select(*columns), source_id)
