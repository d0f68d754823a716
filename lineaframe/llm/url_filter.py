"""URL filters: a trie over reversed host labels, then path segments.

A rule is a host and a path prefix. Walking the reversed labels of a host from
the root passes every rule whose host is the url's host or a parent domain of
it; from each such node the path segments lead to the rules whose path is a
prefix of the url's path. The longest fitting rule decides between allow and
block; of rules of one length a block decides, then the greater name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaframe.storage import ship

#: Rule lists up to this many characters (some 40 bytes a character as a trie, so 80 MB) are broadcast; longer ones are joined.
BROADCAST_CHARS = 2_000_000
#: Over so many tasks the urls that meet one rule are spread by the join.
SALTS = 16


class Rule(NamedTuple):
    """``path`` starts with a slash and is a plain string prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url: both empty for null or where ``://`` is missing.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, with
    A-Z lower-cased; the path from there to ``?``, ``#`` or the end.
    """
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


class RuleTrie:
    """``find`` returns the longest rule that fits, or None.

    Below a host node, rules hang at the node of their complete path segments,
    with what follows the last slash as a remainder that the next segment must
    start with. A node's remainders are looked up by their lengths, longest
    first, so it may hold very many.
    """

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.root: dict = {}
        nodes: list[dict] = []
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            *whole, rest = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            if None not in node:
                node[None] = ({}, [])
                nodes.append(node)
            ends = node[None][0]
            if rest not in ends or rule.verdict == "block":
                ends[rest] = rule
        for node in nodes:
            node[None][1].extend(sorted({len(rest) for rest in node[None][0]}, reverse=True))

    def find(self, host: str, path: str) -> Rule | None:
        best: Rule | None = None
        node: dict | None = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get("/")
            for segment in segments:
                if at is None:
                    break
                if None in at:
                    ends, lengths = at[None]
                    rule = next((ends[segment[:n]] for n in lengths if segment[:n] in ends), None)
                    if rule and (best is None or _precedence(rule) > _precedence(best)):
                        best = rule
                at = at.get(segment)
        return best


def _precedence(rule: Rule) -> tuple[int, bool, str]:
    return len(rule.name), rule.verdict == "block", rule.name


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """Verdict of every url: ``page_id, host, path, rule, verdict``.

    ``rules`` is a list, or a table ``verdict, host, path`` that only comes to
    the driver if it is short enough to broadcast. One row per row of ``pages``,
    whose other columns don't matter. A null url, or one without ``://``, has an
    empty host and path, fits no rule and gets ``default``; rules with a null
    field don't count, rules may repeat, and of an allow and a block of the same
    host and path the block counts. An empty table gives no rows; repeated rows
    are judged each by itself.
    """
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        listed = rules.select("verdict", "host", "path").dropna()
        chars = listed.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0
        if chars <= broadcast_chars:
            rules = [Rule(*r) for r in listed.collect()]
    else:
        chars = sum(len(r.name) for r in rules)
        if chars > broadcast_chars:
            listed = pages.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    judged = _by_trie(parts, rules, default) if chars <= broadcast_chars else _by_join(parts, listed, default)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _by_trie(parts: DataFrame, rules: Sequence[Rule], default: str) -> DataFrame:
    ship(parts.sparkSession)
    shared = parts.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in batches:
            found = [trie.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(
                {
                    "rule": pd.Series([r and r.name for r in found], dtype=object),
                    "verdict": pd.Series([r.verdict if r else default for r in found], dtype=object),
                }
            )

    return parts.withColumn("judged", verdicts("host", "path")).select("page_id", "host", "path", "judged.*")


def _by_join(parts: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """For lists too long to broadcast: every parent domain and path prefix of the distinct urls that a rule could have.

    Prefixes are cut at the lengths that paths of rules have, so a url meets a
    rule by equality and at most one rule for each prefix, however many rules a
    host has. The urls that meet one rule are spread over ``SALTS`` keys.
    """
    lengths = [r[0] for r in listed.select(F.length("path").alias("n")).distinct().collect()]  # whole numbers up to the longest path
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    once = listed.groupBy("host", "path").agg(F.max("verdict").alias("r_verdict"))  # block is the greater word
    once = once.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "r_verdict", salts.alias("salt"))
    distinct = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("path"))
    asked = (
        distinct.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        .withColumn("r_host", F.explode(parents))
        .withColumn("n", F.explode(fitting))
        .withColumn("r_path", F.substring("path", F.lit(1), F.col("n")))
    )
    name = F.concat("r_host", "r_path")
    precedence = F.struct(F.length(name).alias("n"), (F.col("r_verdict") == "block").alias("block"), name.alias("rule"), F.col("r_verdict").alias("verdict"))
    best = asked.join(once, ["r_host", "r_path", "salt"]).groupBy("host", "path").agg(F.max(precedence).alias("best"))
    joined = parts.join(best, ["host", "path"], "left")
    return joined.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )
