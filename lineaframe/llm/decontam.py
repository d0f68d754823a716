"""Benchmark decontamination: Wu-Manber search for windows of test words.

The alphabet is words. Windows of one length form one set of patterns with two
tables: the shift of the block of the last two words read (how far the search
may jump, as no window can end sooner), and for blocks that end a window,
buckets of windows by their last and first two words. Only those are compared
word by word. In
text that shares no word pair with a benchmark the search reads one pair in
nine.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaframe.llm.names import free_name
from lineaframe.storage import forget, keep, ship

#: Words of a window; shorter items are one window.
WINDOW = 10
#: Characters of benchmark text whose tables (some 100 bytes a character to build) are broadcast at once; more goes block by block.
BLOCK_CHARS = 2_000_000

#: Folds A-Z to a-z and every other ASCII character that is not a letter or digit to a space.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, in UTF-8: runs of digits, letters folded to lower case (A-Z only) and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class WuManber:
    """All patterns of one length, of words. A pattern is a place in an item's words, so no window is copied."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], int, frozenset]]] = {}

    def add(self, words: list[bytes], start: int, ids: frozenset) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = words[start + end - 1] if b == 1 else (words[start + end - 2], words[start + end - 1])
            self.shift[key] = min(self.shift.get(key, m), m - end)
        ends = (*words[start : start + b], *words[start + m - b : start + m])
        self.buckets.setdefault(ends, []).append((words, start, ids))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, frozenset]]:
        """Starts of all occurrences, in order, with the ids of the items they belong to."""
        m, b, n = self.length, self.block, len(words)
        furthest, shift = m - b + 1, self.shift.get
        i = m - 1
        while i < n:
            key = words[i] if b == 1 else (words[i - 1], words[i])
            jump = shift(key, furthest)
            if jump:
                i += jump
                continue
            at = i - m + 1
            for item, start, ids in self.buckets.get((*words[at : at + b], *words[i - b + 1 : i + 1]), ()):
                if all(words[at + j] == item[start + j] for j in range(m)):
                    yield at, ids
            i += 1


def build(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """Tables for the windows of ``(item id, text)``; items without words have none."""
    places: dict[int, dict[bytes, tuple[list[bytes], int, set[str]]]] = defaultdict(dict)
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if words else 0):
            key = hashlib.blake2b(b" ".join(words[i : i + length]), digest_size=16).digest()
            places[length].setdefault(key, (words, i, set()))[2].add(item)
    tables, alike = [], {}
    for length, patterns in places.items():
        table = WuManber(length)
        for words, start, ids in patterns.values():
            same = frozenset(ids)
            table.add(words, start, alike.setdefault(same, same))
        tables.append(table)
    return tables


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _search(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of words inside occurrences, and the ids of their items."""
    spans, found = [], set()
    for table in tables:
        for at, ids in table.search(words):
            if spans and spans[-1][0] <= at <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], at + table.length))
            else:
                spans.append((at, at + table.length))
            found |= ids
    return merge(spans), sorted(found)


def _counted(n_words: int, spans: Iterable[tuple[int, int]], ids: Iterable[str]) -> tuple[int, int, int, str]:
    names = sorted(set(ids))
    return n_words, sum(e - s for s, e in merge(spans)), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


_RESULT = ["n_words", "n_hit", "n_items", "items_sha256"]
_RESULT_TYPE = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string"


def _judged(text: Column, tables: list[WuManber], spark: SparkSession) -> Column:
    """Counts and digest of a text, where one block holds all tables."""
    shared = spark.sparkContext.broadcast(tables)

    @F.pandas_udf(_RESULT_TYPE)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        searches = shared.value
        for texts in batches:
            words = map(words_of, texts)
            yield pd.DataFrame([_counted(len(ws), *_search(ws, searches)) for ws in words], columns=_RESULT)

    return judged(text)


def _hits(text: Column, tables: list[WuManber], spark: SparkSession) -> Column:
    """What the tables of one block find in a text."""
    shared = spark.sparkContext.broadcast(tables)

    @F.pandas_udf("hits array<struct<start:int,end:int>>, items array<string>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        searches = shared.value
        for texts in batches:
            found = [_search(words_of(t), searches) for t in texts]
            yield pd.DataFrame({"hits": [[{"start": s, "end": e} for s, e in f[0]] for f in found], "items": [f[1] for f in found]})

    return hits(text)


def _summed_rounds(text: Column, found: Column) -> Column:
    """Counts and digest of what all rounds have found in a text."""

    @F.pandas_udf(_RESULT_TYPE)
    def summed(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for text, rounds in zip(texts, lists, strict=True):
            rounds = [] if rounds is None else rounds
            spans = [(x["start"], x["end"]) for r in rounds for x in r["hits"]]
            rows.append(_counted(len(words_of(text)), spans, (i for r in rounds for i in r["items"])))
        return pd.DataFrame(rows, columns=_RESULT)

    return summed(text, found)


def _pieces(items: DataFrame, window: int, step: int) -> DataFrame:
    """``item, piece``: each item's words, cut so that every window lies in one piece; ``step`` windows a piece."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, body in zip(batch["item"], batch["body"], strict=True):
                words = words_of(body)
                starts = range(0, max(1, len(words) - window + 1), step)
                texts = [b" ".join(words[s : s + step + window - 1]).decode("utf-8", "replace") for s in starts]
                yield pd.DataFrame({"item": [item] * len(texts), "piece": texts})

    return items.mapInPandas(cut, "item string, piece string").where("piece != ''")


def _blocks(items: DataFrame, window: int, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """Windows of the items in blocks of at most ``block_chars`` (or one piece, should it be longer)."""
    pieces = keep(_pieces(items, window, max(1, block_chars // 64)), "decontam-pieces")
    size = F.length("piece")
    total, longest = pieces.agg(F.sum(size), F.max(size)).first()
    rounds = -(-3 * (total or 0) // (2 * block_chars))
    mine = lambda: F.pmod(F.xxhash64("item", "piece"), F.lit(rounds))
    while rounds and pieces.groupBy(mine().alias("r")).agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] > max(block_chars, longest):
        rounds *= 2
    for r in range(rounds):
        yield [(x["item"], x["piece"]) for x in pieces.where(mine() == r).collect()]
    forget(pieces)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    into: str = "decontam",
) -> DataFrame:
    """``docs`` with a struct column ``into``: ``n_words, n_hit, n_items, items_sha256``.

    ``n_hit`` counts words inside any occurrence of a window, ``n_items`` the
    distinct ids of items with occurring windows, and the digest is that of
    these ids, sorted as strings and comma-joined. Null and empty texts have no
    words; items without words, or with a null id, have no windows; items that
    repeat count once; an empty benchmark hits nothing; repeated rows are each
    judged; a column named ``into`` that ``docs`` has already is replaced.

    The tables of up to ``block_chars`` of benchmark text are broadcast, and no
    row is shuffled. A larger benchmark is cut into pieces, long items too, and
    dealt into blocks of that size; the documents are read once for each, and
    only the hits of distinct texts with any are written. So neither the driver
    nor a task ever holds more than one block. At the end a document finds the
    hits of its text by a 128-bit digest.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("body")).where(
        "item is not null and body is not null"
    ).distinct()
    if (items.agg(F.sum(F.length("body"))).first()[0] or 0) <= block_chars:
        return docs.withColumn(into, _judged(F.col(text_col), build([(x["item"], x["body"]) for x in items.collect()], window), spark))
    key = F.struct(F.xxhash64(text_col).alias("one"), F.xxhash64(F.lit("wide"), text_col).alias("two"))
    texts = docs.where(F.length(text_col) > 0).select(key.alias("key"), F.col(text_col).alias("text"))
    written = []
    for block in _blocks(items, window, block_chars):
        found = texts.select("key", _hits(F.col("text"), build(block, window), spark).alias("x"))
        written.append(keep(found.where(F.size("x.hits") > 0).dropDuplicates(["key"]).select("key", "x.hits", "x.items"), "decontam-hits"))
    digest, rounds = free_name(docs, "__text"), free_name(docs, "__rounds")
    hits = reduce(DataFrame.union, written).groupBy(F.col("key").alias(digest)).agg(F.collect_list(F.struct("hits", "items")).alias(rounds))
    joined = docs.withColumn(digest, key).join(hits, digest, "left").drop(digest)
    return joined.withColumn(into, _summed_rounds(F.col(text_col), F.col(rounds))).drop(rounds)
