"""Column names for what operators add to their input on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
