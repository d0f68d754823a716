"""The operators as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaframe.llm import decontam, fingerprint, html_text, license_scan, mixing, pii, quality, simhash, suffix_dedup, url_filter
from lineaframe.llm.pii import _let
from lineaframe.storage import keep

#: The rules of the url query.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark"), into="found")
    return found.select("doc_id", "found.*", (F.col("found.n_hit") > 0).alias("contaminated"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = fingerprint.with_next(docs)
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k))
    likeness = lambda fp, text: fingerprint.same(F.col("fingerprint"), fp, F.col("text"), text)

    def of_edited(e: Column) -> Column:
        made = _let(fingerprint.digest(fingerprint.canonical(e)), lambda fp: F.struct(fp.alias("fp"), likeness(fp, e).alias("near")))
        return F.struct(F.sha2(e.cast("binary"), 256).alias("sha256"), made.alias("made"))

    prints = rows.select(
        "doc_id",
        "raw",
        n.cast("long").alias("n_chars"),
        _let(edited, of_edited).alias("edited"),
        "fingerprint",
        likeness(F.col("next_fingerprint"), F.col("next_text")).alias("near_next"),
    )
    prints = keep(prints, "fingerprints").select(
        "doc_id", "raw", "n_chars", F.col("edited.sha256").alias("edited_sha256"), "fingerprint", F.col("edited.made.fp").alias("edited_fingerprint"),
        F.col("edited.made.near").alias("near_edited"), "near_next",
    )
    return fingerprint.exact_groups(docs, prints=prints).drop("raw")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("passages", F.lit(0), lambda a, p: a + p["end"] - p["start"]), F.lit(0)).cast("long").alias("n_repeated"),
        F.size("passages").cast("long").alias("n_passages"),
        F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"], p["end"])), ",").alias("passages"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_quality, op3_pii, op4_html, op5_url_filter, op6_license, op7_fingerprint, op8_suffix_dedup,
        op9_mixing, op10_simhash,
    )
}
