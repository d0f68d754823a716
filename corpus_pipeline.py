"""A training corpus from the table ``documents``, in five stages.

Each stage takes the rows its predecessor kept and returns the columns of
``documents``, the last one with words and targets besides. ``run`` writes
every stage as Parquet in the folder that the cluster shares and reads it again
for the next one, so a lost executor costs tasks of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaframe.llm import decontam, mixing, pii, quality, simhash
from lineaframe.llm.queries import table
from lineaframe.storage import forget, keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go. The network learns from the labelled rows of the stage's input."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), net).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays, the one with the smallest id."""
    return simhash.deduplicate(docs.select(*COLUMNS), by_likeness=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    found = decontam.scan(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), into="found")
    return found.where("found.n_hit = 0").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; no document goes."""
    found = docs.select(*COLUMNS).withColumn("spans", pii.find_spans(F.col("text")))
    redacted = found.withColumn("text", pii.redact(F.col("text"), F.col("spans")))
    return redacted.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each whole repetition of a document and for its part, with its words and the target of its source."""
    mixed = mixing.mixed_texts(mixing.mix(docs.select(*COLUMNS)))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS, mixing.n_words(F.col("text")).alias("words"), "mix.target")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: The classifier and the fingerprints have no SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            forget(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
