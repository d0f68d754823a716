"""Mixing sources to target weights: capped water-filling, native DataFrame code.

Every source has a weight. A budget of words is shared out by weight; a source
whose share is above ``max_epochs`` times its own size is clamped there and the
excess is shared among the rest by weight, until no share is above its clamp.
That fixed point has a closed form: order the sources by clamp / weight; the
water level is the greatest of (budget - clamps before) / (weights from here).
So the loop "clamp, reshare, repeat" becomes two running sums over a table with
one row per source.

A document is then repeated ``target / size of its source`` times: whole
repetitions plus a fractional one. A fractional repetition is a run of the
document's words from a seeded start, wrapping round; its length is rounded up
or down by a seeded draw, so that a source's total meets its target to within a
few words per hundred documents, whatever the lengths of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineaframe.llm.names import free_name
from lineaframe.llm.pii import _let

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A source table of up to this many rows is broadcast (about 100 bytes a row).
BROADCAST_SOURCES = 100_000
#: Beyond it, documents of one source are spread over this many join keys.
SALTS = 64


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: str, key: Column) -> Column:
    """A draw in [0, 1) that depends on ``seed`` and ``key`` only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Targets for a table ``(source, source_size)`` with one row per source.

    Weights go round over the sources in order of code points, null last.
    Returns ``(source, source_size, weight, target)``.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    sized = sources.withColumn("weight", weight).withColumn("clamp", F.lit(float(max_epochs)) * F.col("source_size"))
    by_fill = Window.orderBy((F.col("clamp") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("clamp").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        sized.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", "weight", F.least(F.col("weight") * F.col("level"), F.col("clamp")).alias("target"))
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    into: str = "mix",
) -> DataFrame:
    """``docs`` with a struct column ``into`` that says how much of each document the mix takes.

    Its fields: ``size, source_size, target, taken, repeats, part, part_start``,
    where ``taken = repeats * size + part`` and ``part_start`` is the word at
    which the fractional repetition starts.

    Null and empty texts have size 0 and nothing is taken of them; a null
    source is a source of its own and comes last; a null id draws like an empty
    one; repeated rows are documents of their own; an empty table gives no rows.
    A hot source costs nothing: sums are combined before the shuffle and the
    documents are not shuffled by source. The water level is found by one task
    over a row of about 100 bytes for each source: tens of millions of sources.
    A column named ``into`` that ``docs`` has already is replaced.
    """
    size = n_words(F.col(text_col))
    sources = docs.select(F.col(source_col).alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    own_size, own_key, own_salt, found = (free_name(docs, f"__mix_{n}") for n in ("size", "key", "salt", "found"))
    per_source = water_fill(sources, weights, share, max_epochs).select(
        key(F.col("source")).alias(own_key), F.struct(F.col("source_size").alias("size"), "target").alias(found)
    )
    keyed = docs.withColumn(own_size, size).withColumn(own_key, key(F.col(source_col)))
    if docs.select(source_col).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(per_source), own_key)
    else:
        salt = F.pmod(F.xxhash64(id_col, own_size), F.lit(SALTS)).cast("int")
        spread = per_source.withColumn(own_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(own_salt, salt).join(spread, [own_key, own_salt])
    n, total, target = F.col(own_size), F.col(found)["size"], F.col(found)["target"]
    epochs = F.when(total > 0, target / total).otherwise(F.lit(0.0))
    most = F.floor(F.lit(float(max_epochs)) * n).cast("long")
    taken = F.least(most, F.floor(n * epochs + seeded(seed, F.col(id_col))).cast("long"))

    def mixed(taken: Column) -> Column:
        repeats = F.when(n > 0, F.floor(taken / n)).otherwise(F.lit(0)).cast("long")
        start = F.floor(seeded(seed + "/start", F.col(id_col)) * n).cast("long")
        return F.struct(
            n.alias("size"), total.alias("source_size"), target.alias("target"), taken.alias("taken"),
            repeats.alias("repeats"), (taken - repeats * n).alias("part"), start.alias("part_start"),
        )

    return joined.withColumn(into, _let(taken, mixed)).select(*[F.col(f"`{c}`") for c in docs.columns if c != into], into)


def mixed_texts(mixed: DataFrame, mix_col: str = "mix", text_col: str = "text") -> DataFrame:
    """The texts of the mix, from a result of :func:`mix`: its columns, with ``text_col`` as the mix takes it.

    A document that is due ``repeats`` whole repetitions comes that many times,
    as it stands; a fractional one is one more row, the run of ``part`` words
    from ``part_start`` that wraps round, joined by spaces. A document of which
    nothing is taken gives no row, and an empty table none.
    """
    due = F.col(mix_col)
    turns = F.sequence(F.lit(0).cast("long"), due["repeats"] + F.when(due["part"] > 0, 1).otherwise(0) - 1)
    turn, names = free_name(mixed, "__mix_turn"), mixed.columns
    words = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    part = _let(words, lambda ws: F.array_join(F.slice(F.concat(ws, ws), (due["part_start"] + 1).cast("int"), due["part"].cast("int")), " "))
    rows = mixed.where(due["taken"] > 0).withColumn(turn, F.explode(turns))
    text = F.when(F.col(turn) < due["repeats"], F.col(text_col)).otherwise(part)
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names])
