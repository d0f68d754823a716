"""Near copies by the likeness of their word shingles, for the SimHash operator.

Texts with the same set of ``SHINGLE``-word shingles are one class, and near
copies are classes whose sets have a Jaccard likeness of ``LIKENESS`` or more.
Their 64-bit fingerprints then differ in about ten bits, far more than a masked
index can search for, so candidates come from two places:

1. the Gray-order index of :mod:`lineaframe.llm.simhash` links fingerprints at
   ``MOST_BITS`` or fewer bits, which joins most of a large group of copies;
2. classes that agree on all ``ROWS`` least hashes of one of ``BANDS`` bands
   share a node. At a likeness of 0.8 a pair meets in some node with a chance of
   0.9999.

Every link is checked on the whole texts. Inside a node the largest component
of the first step is not compared with itself, only the others with it and with
each other, in blocks: a task holds two blocks of a node and multiplies their
shingle tables, and emits one edge a member, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaframe.llm.simhash import bit_counts, components, majority
from lineaframe.llm.simhash import link as gray_link
from lineaframe.llm.suffix_dedup import _BASE, _mix, words_of
from lineaframe.storage import keep, ship

SHINGLE = 5
LIKENESS = 0.8
BANDS = 25
ROWS = 5
SEED = 42
#: Classes, and shingles, of a block of a node.
PART = 512
PART_SHINGLES = 400_000
#: Rows with whole texts that go to Python at once.
BATCH_ROWS = 500
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; a shorter text is one shingle, an empty one has none."""
    words = words_of(text)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not words:
        return hashes
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size))
    for j in range(size):
        out = out * np.uint64(_BASE) + hashes[j : n + j]
    return np.unique(_mix(out))


def likeness(a: str | None, b: str | None) -> float:
    """Jaccard likeness of the shingle sets of two texts; 1 for two empty ones."""
    x, y = shingles(a), shingles(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def sketch(text: str | None) -> tuple[int, int, int, np.ndarray]:
    """Hash of the shingle set, its size, its SimHash, and the node of each band; an empty text has no nodes."""
    own = shingles(text)
    code = xxhash.xxh64_intdigest(own.tobytes())
    if not len(own):
        return code, 0, 0, own
    least, set_bits = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(64, np.int64)
    for lo in range(0, len(own), 2048):
        part = own[lo : lo + 2048]
        least = np.minimum(least, (part[:, None] * _FACTORS).min(axis=0))
        set_bits += bit_counts(part)
    nodes = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        nodes = _mix(nodes * np.uint64(_BASE) + row)
    return code, len(own), majority(set_bits, len(own)), nodes


def _sketches(text: Column) -> Column:
    @F.pandas_udf("fp bigint, n bigint, sim bigint, nodes array<bigint>")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [sketch(t) for t in texts]
            signed = lambda k: np.array([r[k] for r in rows], np.uint64).view(np.int64)
            yield pd.DataFrame({"fp": signed(0), "n": [r[1] for r in rows], "sim": signed(2), "nodes": [r[3].view(np.int64) for r in rows]})

    return sketches(text)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to Python a few at a time while a table is written; the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose texts are alike enough."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) >= LIKENESS for x, y in zip(a, b, strict=True)], dtype=bool)

    one = texts.select(F.col("fp").alias("u"), F.col("text").alias("text_u"))
    two = texts.select(F.col("fp").alias("v"), F.col("text").alias("text_v"))
    with _small_batches(pairs.sparkSession):
        return keep(pairs.join(one, "u").join(two, "v").where(alike("text_u", "text_v")).select("u", "v"), "near-links")


def _by_simhash(codes: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of classes from the edges of the Gray-order index, and from equal fingerprints to the first class of each."""
    reps = keep(codes.where("n > 0").groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("rep")), "near-sims")
    edges = gray_link(reps.select(F.col("sim").alias("fp")))
    one, two = reps.select(F.col("sim").alias("u"), F.col("rep").alias("a")), reps.select(F.col("sim").alias("v"), F.col("rep").alias("b"))
    linked = edges.join(one, "u").join(two, "v").select("a", "b")
    equal = codes.join(reps, "sim").where(F.col("fp") != F.col("rep.fp")).select(F.struct("fp", "n").alias("a"), F.col("rep").alias("b"))
    sizes = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * LIKENESS  # sets of other sizes can't reach the likeness
    return linked.union(equal).where(sizes).select(F.greatest("a.fp", "b.fp").alias("u"), F.least("a.fp", "b.fp").alias("v")).distinct()


def shared_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles that each two of ``sets`` share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = held > 1
    rows = owner[several[column]]
    columns = (np.cumsum(several) - 1)[column[several[column]]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(several.sum()), 2048):
        a, b = np.searchsorted(columns, (lo, lo + 2048))
        table = np.zeros((len(sets), 2048), np.float32)
        table[rows[a:b], columns[a:b] - lo] = 1
        out += table @ table.T
    return out


def local_links(fps: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join the classes of a node as all links between their roots do."""
    n = np.array([len(s) for s in sets])
    both = shared_shingles(sets)
    near = (both >= LIKENESS * (n[:, None] + n - both)) & (roots[:, None] != roots)
    _, place = np.unique(roots, return_inverse=True)
    parent = np.arange(place.max() + 1)  # of roots
    out = []
    for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
        a, b = find(parent, place[i]), find(parent, place[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((max(fps[i], fps[j]), min(fps[i], fps[j])))
    return out


def find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _links_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by task; each task's texts are compared once all of them are there."""
    names = ["band", "node", "a", "b"]
    held: list[tuple] = []
    task = None

    def links() -> pd.DataFrame:
        fps, roots = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
        return pd.DataFrame(local_links(fps, roots, [h[2] for h in held]) if held else [], columns=["u", "v"], dtype="int64")

    for batch in batches:
        for *key, fp, root, text in zip(*(batch[c] for c in [*names, "fp", "root", "text"]), strict=True):
            if key != task:
                yield links()
                task, held = key, []
            held.append((fp, root, shingles(text)))
    yield links()


def _members(codes: DataFrame) -> DataFrame:
    """``band, node, fp, n`` of the nodes that several classes share."""
    each = codes.select("fp", "n", F.posexplode("nodes").alias("band", "node"))
    several = each.groupBy("band", "node").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least != most")
    return keep(each.join(several, ["band", "node"], "left_semi"), "near-members")


def _by_nodes(members: DataFrame, texts: DataFrame, roots: DataFrame, part: int) -> DataFrame:
    """Edges ``(u, v)`` of the links between classes that share a node and have different roots."""
    key = ["band", "node"]
    rooted = members.join(roots, members["fp"] == roots["class"], "left")
    rooted = keep(rooted.select(*key, "fp", "n", F.coalesce("root", "fp").alias("root")), "near-rooted")
    # one row for each node and root, then for each node; of nodes with the same members one is enough
    of_root = rooted.groupBy(*key, "root").agg(
        F.count(F.lit(1)).alias("count"), F.sum("n").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("mark")
    )
    of_node = of_root.groupBy(*key).agg(
        F.sum("count").alias("all_count"), F.sum("n").alias("all_n"), F.sum("mark").alias("mark"),
        F.max(F.struct("count", "root", "n")).alias("main"), F.count(F.lit(1)).alias("roots"),
    )
    once = of_node.where("roots > 1").groupBy("mark", "all_count", "all_n").agg(F.min(F.struct(*key, "main")).alias("x"))
    main = once.select("x.band", "x.node", F.col("x.main.root").alias("main"), F.col("x.main.count").alias("main_count"), F.col("x.main.n").alias("main_n"), "all_count", "all_n")
    parts = lambda count, n: F.greatest(F.ceil(count / part), F.ceil(n / PART_SHINGLES), F.lit(1)).cast("int")
    main = keep(
        main.select(
            *key, "main", parts(F.col("main_count"), F.col("main_n")).alias("main_parts"),
            parts(F.col("all_count") - F.col("main_count"), F.col("all_n") - F.col("main_n")).alias("other_parts"),
        ),
        "near-nodes",
    )
    # parts of the main root are numbered from -1 down; they meet the other parts, and those each other
    mine = lambda parts: F.pmod(F.xxhash64("fp"), F.col(parts)).cast("int")
    count_up = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    met = F.when(
        F.col("root") == F.col("main"), F.transform(count_up("other_parts"), lambda q: F.struct((-1 - mine("main_parts")).alias("a"), q.alias("b")))
    ).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(1), F.col("main_parts")), lambda p: F.struct((-p).alias("a"), mine("other_parts").alias("b"))),
            F.transform(
                F.filter(count_up("other_parts"), lambda q: q != mine("other_parts")),
                lambda q: F.struct(F.least(q, mine("other_parts")).alias("a"), F.greatest(q, mine("other_parts")).alias("b")),
            ),
        )
    )
    task = [*key, "a", "b"]
    dealt = rooted.join(main, key).select(*key, F.explode(met).alias("x"), "fp", "root").select(*key, "x.a", "x.b", "fp", "root")
    dealt = dealt.join(texts, "fp").repartition(*task).sortWithinPartitions(*task)
    with _small_batches(members.sparkSession):
        return keep(dealt.mapInPandas(_links_of, "u bigint, v bigint").distinct(), "near-links")


def link(codes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], part: int | None = None) -> DataFrame:
    """Edges ``(u, v)``, ``u > v``, that join the classes as all links between candidates do.

    ``codes`` has one row ``fp, n, sim, nodes`` for each class; ``texts_of`` finds
    a text ``fp, text`` of each ``fp`` of a table. A node with more than ``part`` (``PART``)
    classes is dealt out: ``M`` classes of its largest component and ``m``
    others come to ``(2 M m + m * m) / part`` rows, so that copies which the
    index has joined already cost little.
    """
    pairs, members = keep(_by_simhash(codes), "near-pairs"), _members(codes)
    wanted = members.select("fp").union(pairs.select("u")).union(pairs.select("v")).distinct()
    texts = keep(texts_of(wanted), "near-texts")
    near = _alike(pairs, texts)
    roots = components(near).select(F.col("node").alias("class"), "root")
    return near.union(_by_nodes(members, texts, roots, part or PART))


def rooted_classes(keyed: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row ``fp, first, root`` for each class: the least keys of its documents, and the least class linked to it."""
    ship(keyed.sparkSession)
    with _small_batches(keyed.sparkSession):
        sketched = keep(keyed.select(*keys, _sketches(F.col(text_col)).alias("s")).select(*keys, "s.*"), "near-sketch")
    codes = keep(sketched.groupBy("fp").agg(F.min(F.struct(*keys, "n", "sim", "nodes")).alias("first")), "near-codes")
    firsts = codes.select("fp", F.struct(*[F.col(f"first.{k}") for k in keys]).alias("first"))

    def texts_of(fps: DataFrame) -> DataFrame:
        wanted = firsts.join(fps, "fp", "left_semi").select("fp", "first.*")
        return keyed.select(*keys, F.col(text_col).alias("text")).join(wanted, keys).select("fp", "text").dropDuplicates(["fp"])

    roots = components(link(codes.select("fp", "first.n", "first.sim", "first.nodes"), texts_of))
    return firsts.join(roots, firsts["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
