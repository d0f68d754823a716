"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, and components.

Two fingerprints link at ``MOST_BITS`` or fewer differing bits. Cut the 64 bits
into B blocks: fingerprints that link agree on at least B - 3 of them. Every
choice of B - 3 blocks is a top node of the index, a masked bit pattern that
its members share; the fingerprints are dealt out by these nodes. Inside a node
the codes are sorted by Gray rank, so that neighbours share bits, and packed
into nodes of 16; a node keeps the bits its members share beyond those of its
parent. A search adds up the differences on the way down and drops a whole
group once they exceed the limit.

A node emits one edge for each member of a local component, to its smallest
member, never all pairs. The components of these edges are found by alternating
large-star and small-star rounds over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineaframe.llm.names import free_name
from lineaframe.storage import forget, keep, ship

MOST_BITS = 3
SHINGLE = 3
SEED = 42
#: Members of a node compared by one task; larger nodes are cut by further bits, and how many times.
PART = 1024
DEEPER = 3
#: Most members of a node, on the average, before the bits are cut into more blocks.
NODE_MEAN = 64
_FAN = 16
_SPACES = bytes(0x20 if c == 0x20 or 0x09 <= c <= 0x0D else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint of the word shingles of a text, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        pieces = [joined[a:b] for a, b in zip(starts[lo : lo + 65536], stops[lo : lo + 65536], strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces))
        set_bits += bit_counts(h)
    return majority(set_bits, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each of the 64 bits is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(set_bits: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are those set in over half of ``n`` hashes."""
    bits = (set_bits * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text as a bigint with the same 64 bits."""

    @F.pandas_udf("bigint")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))

    return fingerprints(text)


def as_hex(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Rank of each code in Gray order."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Hierarchical index of distinct 64-bit codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        pattern, mask = self.codes, np.full(len(codes), full)
        levels = [(pattern, mask)]
        while len(pattern) > _FAN:
            cuts = np.arange(0, len(pattern), _FAN)
            firsts = np.repeat(pattern[cuts], np.diff(np.append(cuts, len(pattern))))
            differ = np.bitwise_or.reduceat((pattern ^ firsts) | ~mask, cuts)
            mask = ~differ
            pattern = pattern[cuts] & mask
            levels.append((pattern, mask))
        #: From the top: pattern and the bits not shared by the parent already.
        self.levels = []
        for k in range(len(levels) - 1, -1, -1):
            pattern, mask = levels[k]
            if k + 1 < len(levels):
                mask = mask & ~levels[k + 1][1][np.arange(len(pattern)) // _FAN]
            self.levels.append((pattern, mask))

    def search(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position in ``queries``, position in ``self.codes``) at ``most`` or fewer differing bits, in slices."""
        top = len(self.levels[0][0])
        step = max(1, (1 << 18) // max(1, top))
        for lo in range(0, len(queries), step):
            q = np.repeat(np.arange(lo, min(lo + step, len(queries))), top)
            node = np.tile(np.arange(top), len(q) // top)
            yield from self._down(0, q, node, np.zeros(len(q), np.int64), queries, most)

    def _down(self, level: int, q: np.ndarray, node: np.ndarray, sofar: np.ndarray, queries: np.ndarray, most: int) -> Iterator:
        pattern, mask = self.levels[level]
        sofar = sofar + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
        alive = sofar <= most
        q, node, sofar = q[alive], node[alive], sofar[alive]
        if level == len(self.levels) - 1:
            if len(q):
                yield q, node
            return
        below = len(self.levels[level + 1][0])
        for lo in range(0, len(q), 1 << 16):
            child = (node[lo : lo + (1 << 16), None] * _FAN + np.arange(_FAN)).ravel()
            inside = child < below
            yield from self._down(
                level + 1, np.repeat(q[lo : lo + (1 << 16)], _FAN)[inside], child[inside],
                np.repeat(sofar[lo : lo + (1 << 16)], _FAN)[inside], queries, most,
            )


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def local_components(codes: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """For sorted distinct codes, the position of the smallest code of each one's component."""
    n = len(codes)
    parent = np.arange(n)
    index = GrayIndex(codes)
    where = np.searchsorted(codes, index.codes)
    for q, at in index.search(codes, most):
        a, b = q, where[at]
        while len(a):
            ra, rb = _roots(parent, a), _roots(parent, b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if len(a):
                np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    return _roots(parent, np.arange(n))


def _edges_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by task; emits edges to the smallest member of each local component."""
    names = ["mask", "pattern", "a", "b"]
    rest = pd.DataFrame()
    for batch in _and_last(batches):
        if batch is None:
            chunk, rest = rest, pd.DataFrame()
        else:
            chunk = pd.concat([rest, batch], ignore_index=True) if len(rest) else batch
            if not len(chunk):
                continue
            last = (chunk[names].to_numpy() == chunk[names].iloc[-1].to_numpy()).all(axis=1)
            first = int(np.argmax(last))
            chunk, rest = chunk.iloc[:first], chunk.iloc[first:]
        if len(chunk):
            yield pd.DataFrame(_edges_of_tasks(chunk[names].to_numpy(), chunk["fp"].to_numpy()), columns=["u", "v"])


def _and_last(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _edges_of_tasks(tasks: np.ndarray, fps: np.ndarray) -> np.ndarray:
    cuts = np.flatnonzero(np.append(True, (tasks[1:] != tasks[:-1]).any(axis=1)))
    sizes = np.diff(np.append(cuts, len(fps)))
    out = []
    codes = fps.view(np.uint64) if fps.dtype == np.int64 else fps.astype(np.int64).view(np.uint64)
    for size in (2, 3):  # most nodes: compare all of a size at once
        at = cuts[sizes == size]
        for i, j in combinations(range(size), 2):
            near = np.bitwise_count(codes[at + i] ^ codes[at + j]) <= MOST_BITS
            out.append(np.stack([codes[at + i][near], codes[at + j][near]], axis=1))
    for at, size in zip(cuts[sizes > 3], sizes[sizes > 3], strict=True):
        own = np.unique(codes[at : at + size])
        root = local_components(own)
        linked = root != np.arange(len(own))
        out.append(np.stack([own[linked], own[root[linked]]], axis=1))
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.uint64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]].view(np.int64)
    return np.stack([pairs.max(axis=1), pairs.min(axis=1)], axis=1) if len(pairs) else pairs


@lru_cache
def top_masks(blocks: int, most: int = MOST_BITS) -> tuple[int, ...]:
    """Masks of every choice of ``blocks - most`` of the blocks, as signed 64-bit numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(each, blocks - most)]
    return tuple(m - (1 << 64) if m >= 1 << 63 else m for m in masks)


def n_blocks(distinct: int, most: int = MOST_BITS) -> int:
    """Fewest blocks for which random codes fill a top node with ``NODE_MEAN`` members at most."""
    blocks = most + 1
    while blocks < 8 and distinct / 2.0 ** (64 * (blocks - most) / blocks) > NODE_MEAN:
        blocks += 1
    return blocks


def finer_masks(mask: int, most: int = MOST_BITS) -> list[int]:
    """``mask`` with each of ``most + 1`` blocks of the bits it leaves out: codes that link agree on one of them."""
    left = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(left) * i / (most + 1)) for i in range(most + 2)]
    finer = {mask | sum(1 << b for b in left[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)}
    return sorted(m - (1 << 64) if m >= 1 << 63 else m for m in (m % (1 << 64) for m in finer))


def link(codes: DataFrame, blocks: int | None = None, part: int = PART) -> DataFrame:
    """Edges ``(u, v)``, ``u > v``, that join the same codes as all links do.

    ``codes`` has distinct non-null bigints in ``fp``. A top node with more than
    ``part`` members is cut by the bits that its pattern leaves open, as the
    whole was, which deals each member out four times, and so on ``DEEPER``
    times. Only what is larger still, codes that differ in few of the last bits,
    is dealt out as pairs of parts; so no task holds more than two parts.
    """
    ship(codes.sparkSession)
    node = ["mask", "pattern"]
    at = lambda rows: rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")
    masks = list(top_masks(blocks or n_blocks(codes.count())))
    rows = at(codes.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")))
    settled: list[DataFrame] = []
    for depth in range(DEEPER + 1):
        large = keep(rows.groupBy(*node).count().where(F.col("count") > part), "simhash-large")
        if large.isEmpty():
            settled.append(rows.withColumn("parts", F.lit(1)))
            break
        settled.append(rows.join(large, node, "left_anti").withColumn("parts", F.lit(1)))
        hot = rows.join(large, node)
        if depth == DEEPER:
            settled.append(hot.select(*node, "fp", F.ceil(F.col("count") / part).cast("int").alias("parts")))
            break
        finer = {m: finer_masks(m) for m in masks}
        below = F.create_map(*[x for m, fs in finer.items() for x in (F.lit(m), F.array(*[F.lit(f) for f in fs]))])
        rows = keep(at(hot.select("fp", F.explode(below[F.col("mask")]).alias("mask"))).distinct(), "simhash-finer")
        masks = sorted({f for fs in finer.values() for f in fs})
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = (
        reduce(DataFrame.union, [r.select(*node, "fp", "parts") for r in settled])
        .withColumn("mine", mine)
        .withColumn("other", others)
        .select(*node, F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp")
        .repartition(*node, "a", "b")
        .sortWithinPartitions(*node, "a", "b")
    )
    return dealt.mapInPandas(_edges_of, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges``; the root is the smallest node of its component.

    Large-star and small-star rounds until nothing changes; every round is a
    written table, so a lost executor costs one round. Joins and sums only:
    nothing is gathered by node, and the joins are of written tables, whose
    shuffles Spark can split, so a node of very many edges is no trouble.
    """
    now = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "cc")
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc-least")
        large = keep(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "cc"
        )
        lower = keep(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        after = keep(small.where("u != v").distinct(), "cc")
        for table in (large, now, least, lower):
            forget(table)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _components_of(codes: DataFrame) -> DataFrame:
    """``codes`` (one row for each ``fp``) with the smallest linked fingerprint as ``root``."""
    roots = components(link(codes.select("fp")))
    return codes.join(roots, codes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``; ``component_id`` is the smallest ``doc_id`` reachable.

    Null and empty texts have fingerprint 0 and link like any other; null ids
    are passed over by the smallest, so a component of null ids only has a null
    ``component_id``; repeated rows stay; an empty table gives no rows. The
    fingerprints are written once as a table, since every later step reads
    them; only distinct ones are linked, so exact copies cost nothing.
    """
    ship(docs.sparkSession)
    prints = keep(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")), "simhash")
    rooted = _components_of(keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-codes"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_likeness: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: that of the smallest id.

    Links are those of :func:`near_duplicates`, or with ``by_likeness`` pairs of
    texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or
    more (:mod:`lineaframe.llm.near_copies`); null and empty texts are copies of
    each other in either way.

    Rows with a null id stay only where their component has no other; of rows
    with the same id the one with the smallest text hash stays, and of repeated
    rows one. All columns are kept, whatever their names; an empty table gives
    no rows.
    """
    from lineaframe.llm.near_copies import rooted_classes

    ship(docs.sparkSession)
    keys = [free_name(docs, k) for k in ("__sim_null", "__sim_id", "__sim_tie")]
    turn = free_name(docs, "__sim_turn")
    keyed = (
        docs.withColumn(keys[0], F.col(id_col).isNull())
        .withColumn(keys[1], F.coalesce(F.col(id_col), F.lit(0)))
        .withColumn(keys[2], F.xxhash64(text_col))
    )
    if by_likeness:
        rooted = rooted_classes(keyed, keys, text_col)
    else:
        prints = keep(keyed.select(*keys, fingerprint(F.col(text_col)).alias("fp")), "simhash")
        rooted = _components_of(keep(prints.groupBy("fp").agg(F.min(F.struct(*keys)).alias("first")), "simhash-codes"))
    staying = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    in_turn = Window.partitionBy(*keys).orderBy(*keys)
    kept = keyed.join(staying, keys, "left_semi").withColumn(turn, F.row_number().over(in_turn)).where(F.col(turn) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
