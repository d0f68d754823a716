"""Passages that repeat across documents: sparse suffix arrays.

Of all suffixes of a document (from each word on) only those at minimisers are
retained: positions whose hash of ``GRAM`` words is the smallest of some
``WINDOW`` neighbouring ones. The choice depends on the words alone, so a
passage of ``LEAST`` words or more has the same retained suffixes wherever it
stands. Suffixes whose first words no other document has are dropped; the rest
are sorted by their words, neighbours are compared, and a match is extended to
the right along both suffixes and to the left along what precedes them. Matches
of ``LEAST`` words or more are merged into passages.

Neighbours alone would miss partners that share the words to the left while very
many others sort between, so links are decided by windows: every run of
``LEAST`` words around a retained suffix is hashed, and a window that stands in
two documents, by the least and greatest document of its 64-bit hash, is part of
a passage, however many suffixes share its first words.

A suffix is compared over ``RIGHT`` words and to the left over ``LEFT``: enough
for the next retained suffix to go on from there, so passages of any length
come out whole. Suffixes that agree on all these words form a class; a class of
several documents needs no comparing, and of every class one member's words are
sorted, so thousands of copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaframe.llm.simhash import _SPACES
from lineaframe.storage import keep, ship

LEAST = 50
GRAM = 8
WINDOW = 40
LEFT = WINDOW
RIGHT = LEAST + WINDOW
#: Sorted neighbours on each side that a suffix is compared with, besides the nearest of another document.
NEAR = 3
#: Classes of one gram that a task sorts together; those of more frequent grams are sorted in ranges of so many rows.
FREQUENT = 1024
RANGE_ROWS = 50_000
_ORDER = ("gram", "after", "before", "least")

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z folded."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if w] if text else []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & 0xFFFFFFFFFFFFFFFF))
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _grams(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - GRAM + 1
    grams = np.zeros(n, np.uint64)
    for j in range(GRAM):
        grams = grams * np.uint64(_BASE) + hashes[j : n + j]
    return _mix(grams)


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the minimisers of a document's word hashes, and the hashes of their grams.

    Where neighbouring grams are equal (a word that repeats on and on), one in
    ``WINDOW / 2`` is taken. A text of fewer than ``LEAST`` words has none.
    """
    if len(hashes) < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = _grams(hashes)
    width = min(WINDOW, len(grams))
    least = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)  # hashes are at least 0, so this never wins
    best = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(best == grams)
    own = grams[at]
    first = np.append(True, own[1:] != own[:-1])
    run_start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    slot = (at - at[run_start]) // (WINDOW // 2)
    chosen = first | np.append(True, slot[1:] != slot[:-1])
    return at[chosen], own[chosen]


def sketch(text: str | None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words; hash, context hash and position of each retained suffix."""
    words = words_of(text)
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    at, own = anchors(hashes)
    if not len(at):
        return n, own, own, at
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)])
    lo, hi = np.maximum(at - LEFT, 0), np.minimum(at + RIGHT, n)
    context = (sums[hi] - sums[lo]) * _powers(_INVERSE, n)[lo]
    context = _mix(context + ((at - lo) * 1024 + (hi - at)).astype(np.uint64) * np.uint64(_BASE))
    return n, own, context, at


def windows(hashes: np.ndarray, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each place of :func:`anchors`, hashes and starts (from the place on) of the windows of ``LEAST`` words that it stands for.

    Those are the windows whose first ``WINDOW`` grams have the place's gram as
    the smallest. They start up to ``WINDOW - 1`` words before the place, or,
    where equal grams were thinned out, less than ``WINDOW / 2`` after it; so
    the words that a class shares settle them, and no window is left out.
    """
    n = len(hashes)
    if n < LEAST:
        return []
    grams = _grams(hashes)
    least = _sliding(grams, WINDOW, np.minimum)[: n - LEAST + 1]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)])
    whole = _mix((sums[LEAST:] - sums[:-LEAST]) * _powers(_INVERSE, n - LEAST + 1)).view(np.int64)
    out = []
    for p in places:
        lo = max(0, p - WINDOW + 1)
        at = lo + np.flatnonzero(least[lo : p + WINDOW // 2] == grams[p])
        out.append((whole[at], (at - p).astype(np.int32)))
    return out


def _sketches(text: Column) -> Column:
    @F.pandas_udf("n_words bigint, grams array<bigint>, contexts array<bigint>, places array<int>")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [sketch(t) for t in texts]
            yield pd.DataFrame(
                {
                    "n_words": [r[0] for r in rows],
                    "grams": [r[1].view(np.int64) for r in rows],
                    "contexts": [r[2].view(np.int64) for r in rows],
                    "places": [r[3].astype(np.int32) for r in rows],
                }
            )

    return sketches(text)


def _surroundings(text: Column, places: Column) -> Column:
    """For each place, the words from it on, the words before it, nearest first, and its windows."""

    @F.pandas_udf("after array<string>, before array<string>, windows array<array<bigint>>, starts array<array<int>>")
    def surroundings(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for text, at in zip(texts, lists, strict=True):
            spelt = words_of(text)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, spelt), np.uint64, len(spelt))
            words = [w.decode("utf-8", "replace") for w in spelt]
            found = windows(hashes, at)
            rows.append(
                (
                    [" ".join(words[p : p + RIGHT]) for p in at],
                    [" ".join(reversed(words[max(0, p - LEFT) : p])) for p in at],
                    [f[0] for f in found],
                    [f[1] for f in found],
                )
            )
        return pd.DataFrame(rows, columns=["after", "before", "windows", "starts"])

    return surroundings(text, places)


def _common(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def compare(rows: list[tuple]) -> list[tuple[int, int]]:
    """For sorted ``(gram, least, most, after, before)``: words matched to the left and right, (0, 0) below ``LEAST``.

    Rows are classes with their least and greatest document. A row is compared
    with its neighbours and, past rows of the same document, with the nearest
    row on each side that another document has a part in.
    """
    split = [(a.split(" "), b.split(" ") if b else []) for *_, a, b in rows]
    owner = [low if low == high else None for _, low, high, *_ in rows]
    best = [(0, 0)] * len(rows)

    def apart(i: int, j: int) -> bool:
        return owner[i] is None or owner[i] != owner[j]

    def match(i: int, j: int) -> None:
        right, left = _common(split[i][0], split[j][0]), _common(split[i][1], split[j][1])
        if right + left >= LEAST:
            best[i] = (max(best[i][0], left), max(best[i][1], right))
            best[j] = (max(best[j][0], left), max(best[j][1], right))

    for i in range(len(rows)):
        for j in range(i + 1, min(len(rows), i + 1 + NEAR)):
            if rows[j][0] != rows[i][0]:
                break
            if apart(i, j):
                match(i, j)
    for turn in (range(len(rows)), reversed(range(len(rows)))):
        last = other = None  # the row before, and the last one of another document than that
        for i in turn:
            if last is None or rows[i][0] != rows[last][0]:
                other = None
            elif apart(i, last):
                other = last
            elif other is not None:
                match(i, other)
            last = i
    return best


_COMPARED = "gram bigint, context bigint, least bigint, most bigint, after string, before string, to_left int, to_right int, border boolean"


def _end(frame: pd.DataFrame) -> pd.DataFrame:
    """The last ``NEAR`` rows, and before them the last one of another document than the last."""
    apart = (frame["least"] != frame["most"]) | (frame["least"] != frame["least"].iloc[-1]) | (frame["most"] != frame["most"].iloc[-1])
    at = np.flatnonzero(apart.to_numpy())
    near = max(0, len(frame) - NEAR)
    return frame.iloc[[*at[at < near][-1:], *range(near, len(frame))]]


def _compare_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares the sorted rows of a partition, batch by batch; the rows at its two ends come out once more as border rows."""
    columns = ["gram", "context", "least", "most", "after", "before"]
    rest = pd.DataFrame(columns=columns)
    ends: list[pd.DataFrame] = []

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        found = compare(list(zip(*(frame[c] for c in columns if c != "context"), strict=True)))
        out = frame[["gram", "context"]].assign(least=0, most=0, after=None, before=None, to_left=[x[0] for x in found], to_right=[x[1] for x in found], border=False)
        return out[out["to_right"] > 0]

    last = None
    for batch in batches:
        if not len(batch):
            continue
        batch = batch[columns]
        if last is None:
            ends.append(_end(batch[::-1])[::-1])
        frame = pd.concat([rest, batch], ignore_index=True) if len(rest) else batch.reset_index(drop=True)
        yield compared(frame)
        rest = _end(frame)
        last = rest
    if last is not None:
        ends.append(last)
        yield pd.concat(ends, ignore_index=True).assign(to_left=0, to_right=0, border=True)


def _compare_inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for out in _compare_partition(batches):
        yield out[~out["border"].astype(bool)]


def _merged(spans: Column) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def merged(lists: pd.Series) -> pd.Series:
        out = []
        for spans in lists:
            joined: list[list[int]] = []
            for start, end in sorted((s["start"], s["end"]) for s in spans):
                if joined and start <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], end)
                else:
                    joined.append([start, end])
            out.append([{"start": s, "end": e} for s, e in joined])
        return pd.Series(out)

    return merged(spans)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, passages`` of every row of ``docs``.

    ``passages`` is an array of ``struct<start, end>``, words from 0, ends
    exclusive: the runs of words that are part of a passage of ``LEAST`` words
    or more which another document holds too. Rows with the same id and text
    are one document and get the same answer; null and empty texts have no
    words; null ids are ids like any other; an empty table gives no rows.

    Words and windows of suffixes travel only for one member of each class whose
    first words several documents share. Suffixes are sorted by gram; those of grams with
    very many classes are sorted in ranges, so that a passage in a third of all
    documents is spread over many tasks, and suffixes next to the border of a
    range are compared once more with those beyond it.
    """
    spark = docs.sparkSession
    ship(spark)
    document = F.xxhash64(F.col(id_col), F.xxhash64(text_col))
    sketched = keep(
        docs.select(F.col(id_col).alias("doc_id"), document.alias("document"), _sketches(F.col(text_col)).alias("s")).select(
            "doc_id", "document", "s.*"
        ),
        "suffix-sketch",
    )
    suffixes = sketched.select(
        "document", "n_words", F.explode(F.arrays_zip("grams", "contexts", "places")).alias("x")
    ).select("document", "n_words", F.col("x.grams").alias("gram"), F.col("x.contexts").alias("context"), F.col("x.places").alias("place"))
    least, most = F.min("document").alias("least"), F.max("document").alias("most")
    shared = keep(suffixes.groupBy("gram").agg(least, most).where("least != most").select("gram"), "suffix-shared")
    # both sides of this join are plain shuffles, which Spark can split where a gram has very many contexts
    grouped = suffixes.groupBy("gram", "context").agg(least, most, F.min_by("place", "document").alias("place"))
    classes = keep(grouped.join(shared, "gram", "left_semi"), "suffix-classes")
    wanted = classes.groupBy("least").agg(F.collect_list(F.struct("gram", "context", "place", "most")).alias("mine"))
    spelled = (
        docs.select(document.alias("document"), F.col(text_col).alias("text"))
        .join(wanted, F.col("document") == F.col("least"))
        .select("document", "mine", _surroundings(F.col("text"), F.col("mine.place")).alias("words"))
        .select("document", "mine", "words.*")
        .select("document", F.explode(F.arrays_zip("mine", "after", "before", "windows", "starts")).alias("x"))
        .select(F.col("document").alias("least"), "x.mine.most", "x.mine.gram", "x.mine.context", "x.after", "x.before", "x.windows", "x.starts")
    )
    spelled = keep(spelled, "suffix-words")
    frequent = keep(classes.groupBy("gram").count().where(F.col("count") > FREQUENT), "suffix-frequent")
    n_frequent = frequent.agg(F.sum("count")).first()[0]
    parts = [classes.where("least != most").select("gram", "context", F.lit(LEFT).alias("to_left"), F.lit(RIGHT).alias("to_right"))]
    parts.append(_linked_windows(spelled))
    usual = spelled = spelled.drop("windows", "starts")
    if n_frequent:
        usual = spelled.join(frequent, "gram", "left_anti")
        parts += _compared_in_ranges(spelled.join(frequent, "gram", "left_semi"), -(-n_frequent // RANGE_ROWS))
    parts.append(usual.repartition("gram").sortWithinPartitions(*_ORDER).mapInPandas(_compare_inside, _COMPARED))
    matched = keep(
        reduce(DataFrame.union, [p.select("gram", "context", "to_left", "to_right") for p in parts])
        # windows that start after the place need not touch those that hold it
        .groupBy("gram", "context", (F.col("to_left") < 0).alias("beyond"))
        .agg(F.max("to_left").alias("to_left"), F.max("to_right").alias("to_right")),
        "suffix-matched",
    )
    start = F.col("place") - F.least("to_left", "place")
    end = F.least(F.col("place") + F.col("to_right"), F.col("n_words")).cast("int")
    spans = (
        suffixes.join(matched, ["gram", "context"])
        .select("document", start.alias("start"), end.alias("end"))
        .where(F.col("end") - F.col("start") >= LEAST)
        .groupBy("document")
        .agg(_span_list())
        .select("document", _merged(F.col("spans")).alias("passages"))
    )
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    return sketched.select("doc_id", "document", "n_words").join(spans, "document", "left").select(
        "doc_id", "n_words", F.coalesce("passages", nothing).alias("passages")
    )


def _linked_windows(spelled: DataFrame) -> DataFrame:
    """Spans of the windows that another document holds too, for classes of one document; those of several are whole anyway."""
    rows = spelled.select("gram", "context", "least", "most", F.explode(F.arrays_zip("windows", "starts")).alias("w"))
    rows = rows.select("gram", "context", "least", "most", F.col("w.windows").alias("window"), F.col("w.starts").alias("start"))
    held = rows.groupBy("window").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    shared = keep(held.where("least != most").select("window"), "suffix-windows")
    linked = rows.where("least = most").select("gram", "context", "window", "start").join(shared, "window", "left_semi")
    return linked.select("gram", "context", (-F.col("start")).alias("to_left"), (F.col("start") + LEAST).alias("to_right"))


def _compared_in_ranges(spelled: DataFrame, ranges: int) -> list[DataFrame]:
    """Suffixes of very frequent grams, compared in ranges of their order, and once more across the borders of ranges."""
    sorted_rows = spelled.repartitionByRange(ranges, *_ORDER).sortWithinPartitions(*_ORDER)
    compared = keep(sorted_rows.mapInPandas(_compare_partition, _COMPARED), "suffix-compared")
    borders = compared.where("border").repartition("gram").sortWithinPartitions(*_ORDER).mapInPandas(_compare_inside, _COMPARED)
    return [compared.where("not border"), borders]


def _span_list() -> Column:
    return F.collect_set(F.struct("start", "end")).alias("spans")
