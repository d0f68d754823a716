"""Document fingerprints: a canonical exact digest, by DataFrame functions alone.

The canonical form of a text is its Unicode normal form C, in folded case, with
every run of white space as one space and none at the ends. Its digest is 128
bits of XXH64, from two seeds. Texts with equal digests are compared byte by
byte before they count as equal.

Normalisation needs no Python on the executors: most texts hold no character
that normalisation could change, which one pattern shows. In the others,
clusters of a starter and its marks are decomposed, ordered and composed by
lookups in tables that are derived from the Unicode data of the driver's Python.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineaframe.llm.pii import _let, _running_sums
from lineaframe.storage import keep

#: White space characters beyond ASCII.
WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Hashes of texts in buckets of several rows are broadcast up to this many.
BROADCAST_TEXTS = 1_000_000
_HANGUL = range(0xAC00, 0xAC00 + 11172)
_PAIR, _ITEM = "\ue000", "\ue001"


def _char_class(points: list[int]) -> str:
    """A Java character class, in groups of ranges that one test of their bounds passes over."""
    ranges: list[list[int]] = []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    one = lambda lo, hi: f"\\x{{{lo:X}}}-\\x{{{hi:X}}}"
    groups = [ranges[i : i + 24] for i in range(0, len(ranges), 24)]
    return "".join(f"[{one(g[0][0], g[-1][1])}&&[{''.join(one(*r) for r in g)}]]" for g in groups)


@lru_cache
def _tables() -> tuple[str, str, str, str, str]:
    """Classes of marks and of characters that normal form C never holds; maps of decompositions, pairs and mark classes."""
    marks, never, parts, pairs, classes = set(), [], [], [], []
    for point in range(0x110000):
        c = chr(point)
        if ccc := unicodedata.combining(c):
            marks.add(point)
            classes.append(f"{c}{_PAIR}{ccc}")
        if point in _HANGUL or 0xD800 <= point < 0xE000:
            continue
        apart = unicodedata.normalize("NFD", c)
        if apart != c:
            parts.append(f"{c}{_PAIR}{apart}")
            if unicodedata.combining(apart[0]):
                marks.add(point)
            if unicodedata.normalize("NFC", c) != c:
                never.append(point)
            else:
                steps = unicodedata.decomposition(c).split()
                first, second = (chr(int(x, 16)) for x in steps)
                pairs.append(f"{first}{second}{_PAIR}{c}")
                marks.add(ord(second))
    marks |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    return _char_class(sorted(marks)), _char_class(never), _ITEM.join(parts), _ITEM.join(pairs), _ITEM.join(classes)


def _map(entries: str) -> Column:
    return F.str_to_map(F.lit(entries), F.lit(_ITEM), F.lit(_PAIR))


def _chr(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _cluster(cluster: Column) -> Column:
    """Normal form C of a starter with its marks."""
    _, _, parts, pairs, classes = _tables()
    apart = F.flatten(F.transform(_letters(cluster), lambda c: _letters(F.coalesce(F.try_element_at(_map(parts), c), c))))
    classed = F.transform(
        apart, lambda c, i: F.struct(F.coalesce(F.try_element_at(_map(classes), c).cast("int"), F.lit(0)).alias("k"), i.alias("i"), c.alias("c"))
    )
    ordered = _let(
        classed,
        lambda cs: _let(
            F.struct(cs.alias("cs"), _running_sums(F.transform(cs, lambda x: F.when(x["k"] == 0, F.lit(1)).otherwise(F.lit(0)))).alias("run")),
            lambda s: F.array_sort(
                F.transform(s["cs"], lambda x, i: F.struct(F.get(s["run"], i).alias("run"), x["k"].alias("k"), x["i"].alias("i"), x["c"].alias("c")))
            ),
        ),
    )
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("tail"), F.lit(-1).alias("last"))

    def step(s: Column, x: Column) -> Column:
        b, c = F.ascii(s["base"]), F.ascii(x["c"])
        lead_vowel = b.between(0x1100, 0x1112) & c.between(0x1161, 0x1175)
        with_tail = b.between(0xAC00, 0xD7A3) & ((b - 0xAC00) % 28 == 0) & c.between(0x11A8, 0x11C2)
        joined = (
            F.when(lead_vowel, _chr((b - 0x1100) * 588 + (c - 0x1161) * 28 + 0xAC00))
            .when(with_tail, _chr(b + c - 0x11A7))
            .otherwise(F.try_element_at(_map(pairs), F.concat(s["base"], x["c"])))
        )
        free = (s["base"] != "") & (s["last"] < x["k"])

        def put(done: Column, base: Column, tail: Column, last: Column) -> Column:
            return F.struct(done.alias("done"), base.alias("base"), tail.alias("tail"), last.alias("last"))

        return _let(
            F.when(free, joined),
            lambda j: F.when(j.isNotNull(), put(s["done"], j, s["tail"], s["last"]))
            .when(x["k"] == 0, put(F.concat(s["done"], s["base"], s["tail"]), x["c"], F.lit(""), F.lit(-1)))
            .otherwise(put(s["done"], s["base"], F.concat(s["tail"], x["c"]), x["k"])),
        )

    return F.aggregate(ordered, empty, step, lambda s: F.concat(s["done"], s["base"], s["tail"]))


def nfc(text: Column) -> Column:
    """Unicode normal form C."""
    marks, never, *_ = _tables()
    cluster = f"(?s)(?:(?![{marks}]).)?[{marks}]++|[{never}]"
    pieces, found = F.split(text, cluster, -1), F.regexp_extract_all(text, F.lit(cluster), F.lit(0))
    whole = F.array_join(
        F.flatten(F.zip_with(pieces, found, lambda p, m: F.array(p, F.coalesce(_cluster(m), F.lit(""))))), ""
    )
    latin = r"[^\x00-\x{2FF}]"  # below, every text is normal
    return F.when(text.rlike(latin) & text.rlike(f"[{marks}{never}]"), whole).otherwise(text)


@lru_cache
def _folds() -> tuple[str, str]:
    """Class of the lower-case characters that full case folding changes further, and a map of what they become."""
    points = [p for p in range(0x80, 0x110000) if not 0xD800 <= p < 0xE000 and chr(p).lower() == chr(p) != chr(p).casefold()]
    return _char_class(points), _ITEM.join(f"{chr(p)}{_PAIR}{chr(p).casefold()}" for p in points)


def folded(text: Column) -> Column:
    """Full Unicode case folding: lower case, then what else folds, as sharp s, final sigma and ligatures."""
    special, becomes = _folds()

    def further(lower: Column) -> Column:
        pieces, found = F.split(lower, f"[{special}]", -1), F.regexp_extract_all(lower, F.lit(f"[{special}]"), F.lit(0))
        whole = F.array_join(
            F.flatten(F.zip_with(pieces, found, lambda p, c: F.array(p, F.coalesce(F.try_element_at(_map(becomes), c), F.lit(""))))), ""
        )
        return F.when(lower.rlike(r"[^\x00-\xFF]") & lower.rlike(f"[{special}]"), whole).otherwise(lower)

    return _let(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), further)  # the only one that is frequent


def one_spaced(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    wide = r"[\x{85}\x{A0}\x{1680}-\x{3000}]"  # where they all are, and few letters
    narrow = lambda t: F.when(t.rlike(wide), F.translate(t, WIDE_SPACE, " " * len(WIDE_SPACE))).otherwise(t)
    return F.trim(F.regexp_replace(_let(text, narrow), r"[\x09-\x0D\x1C-\x20]+", " "))


def canonical(text: Column) -> Column:
    """Normal form C in folded case, white space folded; null counts as empty."""
    return one_spaced(folded(nfc(F.coalesce(text, F.lit("")))))


def digest(canon: Column) -> Column:
    """128 bits of XXH64 of a canonical text, as 32 lower-case hex digits."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return _let(canon, lambda c: F.concat(part(F.xxhash64(c)), part(F.xxhash64(F.lit("wide"), c))))


def same(fp_a: Column, fp_b: Column, text_a: Column, text_b: Column) -> Column:
    """Likeness of exact fingerprints: 1 if they are equal and the canonical texts are too, byte by byte, else 0."""
    return F.when((fp_a == fp_b) & ((text_a == text_b) | (canonical(text_a) == canonical(text_b))), F.lit(1.0)).otherwise(F.lit(0.0))


def raw_key(text: Column) -> Column:
    """128 bits of XXH64 of a text as it stands."""
    return F.struct(F.xxhash64(text).alias("one"), F.xxhash64(F.lit("wide"), text).alias("two"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, raw, fingerprint`` of every row, for :func:`exact_groups`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), raw_key(text).alias("raw"), digest(canonical(text)).alias("fingerprint"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints: DataFrame | None = None) -> DataFrame:
    """The rows of ``prints`` (by default :func:`digests` of ``docs``) with ``group_id, group_size``.

    A group is all rows with equal canonical texts; ``group_id`` is its smallest
    id. ``prints`` has ``doc_id, raw, fingerprint`` and any other columns, one
    row for each row of ``docs``, and should be a written table.

    Rows are counted by digest first, combined before the shuffle, so a hot
    group is one row a task. Only buckets of several rows have their texts
    compared byte by byte, as the least and greatest text of each raw digest and
    then the least and greatest canonical text of each bucket, combined
    likewise; a bucket whose two differ (a collision) is split by a further
    digest.

    Null texts count as empty; null ids are passed over by the smallest;
    repeated rows are members each; an empty table gives no rows.
    """
    if prints is None:
        prints = keep(digests(docs, id_col, text_col), "digests")
    buckets = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("group_id"))
    several = prints.join(buckets.where("group_size > 1"), "fingerprint", "left_semi").select("raw", "fingerprint").distinct()
    several = keep(several, "digests-several")
    if several.count() <= BROADCAST_TEXTS:
        several = F.broadcast(several)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text"), raw_key(text).alias("raw")).join(several, "raw")
    texts = rows.groupBy("raw", "fingerprint").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    canon = texts.select("raw", "fingerprint", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("text")).withColumn("canon", canonical(F.col("text")))
    compared = canon.groupBy("fingerprint").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    mixed = keep(compared.where("lo != hi").select("fingerprint"), "digests-mixed")
    whole = prints.join(buckets, "fingerprint").select(*prints.columns, "group_id", "group_size")
    if mixed.isEmpty():
        return whole
    further = keep(canon.join(mixed, "fingerprint", "left_semi").select("raw", F.sha2("canon", 512).alias("further")).distinct(), "digests-further")
    split = prints.join(mixed, "fingerprint", "left_semi").join(further, "raw")
    parts = split.groupBy("fingerprint", "further").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("group_id"))
    apart = split.join(parts, ["fingerprint", "further"]).select(*prints.columns, "group_id", "group_size")
    return whole.join(mixed, "fingerprint", "left_anti").select(*apart.columns).union(apart)


#: Ranges of the id that are cut at quantiles, and characters of text in a range; more ranges divide those between quantiles evenly.
QUANTILES = 512
RANGE_CHARS = 16_000_000


def _ranges(docs: DataFrame, id_col: str, text_col: str, range_chars: int) -> Column:
    """The range of each row as ``struct<missing, cut, hot, part>``, in the order of the ids.

    Ids between two neighbouring quantiles share a range, or evenly several. An
    id that is a quantile itself may hold very many rows; it has a range of its
    own, or one for each time that it is a quantile, by a hash of the text. So
    have null ids.
    """
    chars, rows, missing = docs.agg(
        F.sum(F.length(text_col)), F.count(F.lit(1)), F.sum(F.col(id_col).isNull().cast("long"))
    ).first()
    n = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(chars or 0) // range_chars))
    quantiles = min(n, QUANTILES)
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / quantiles for i in range(1, quantiles)], 100 * quantiles)).first()[0] if quantiles > 1 else None
    cuts = [int(c) for c in found or []]
    parts = -(-n // quantiles)
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    own = F.col(id_col).cast("long")
    hashed = (F.shiftrightunsigned(F.xxhash64(text_col), 11) / F.lit(float(1 << 53))).cast("double")  # in [0, 1)
    below, equal = F.size(F.filter(bounds, lambda b: b < own)), F.size(F.filter(bounds, lambda b: b == own))
    low, high = F.get(bounds, below - 1).cast("double"), F.get(bounds, below).cast("double")
    between = F.coalesce((own - low) / (high - low), F.lit(0.0))
    at = lambda share, many: F.floor(share * many).cast("int")
    of_nulls = max(1, -(-n * (missing or 0) // max(1, rows)))
    return (
        F.when(own.isNull(), F.struct(F.lit(True).alias("missing"), F.lit(0).alias("cut"), F.lit(True).alias("hot"), at(hashed, of_nulls).alias("part")))
        .when(equal > 0, F.struct(F.lit(False).alias("missing"), below.alias("cut"), F.lit(True).alias("hot"), at(hashed, equal * parts).alias("part")))
        .otherwise(F.struct(F.lit(False).alias("missing"), below.alias("cut"), F.lit(False).alias("hot"), at(between, F.lit(parts)).alias("part")))
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_chars: int = RANGE_CHARS) -> DataFrame:
    """``doc_id, text, raw, fingerprint`` with the next row's ``next_text, next_fingerprint``, by ascending id.

    Ids are whole numbers. The first row follows the last; null ids come last;
    rows of one id follow each other by a hash of their text, repeated rows in
    any order. Rows are dealt into ranges of the id of about ``range_chars``
    characters, so no task sees all rows and texts are shuffled once; the first
    row of the next range reaches a range by a join.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # the hash by which rows of one id are ordered is that by which _ranges deals them out
    tie = F.shiftrightunsigned(F.xxhash64("text"), 11)
    rows = rows.select("doc_id", "text", tie.alias("tie"), F.xxhash64("text").alias("tie_all"), _ranges(rows, "doc_id", "text", range_chars).alias("bucket"))
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tie", "tie_all")
    edges = rows.groupBy("bucket").agg(F.min(key).alias("first_key"))  # one row for each range
    in_turn = Window.orderBy("bucket")
    start = F.first("first_key").over(in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follows = edges.select("bucket", F.coalesce(F.lead("first_key").over(in_turn), start).alias("k"))
    texts = rows.select(F.col("doc_id").alias("b_id"), F.col("tie_all").alias("b_tie"), F.col("text").alias("border_text"))
    border = (
        texts.join(F.broadcast(follows), texts["b_id"].eqNullSafe(F.col("k.doc_id")) & (texts["b_tie"] == F.col("k.tie_all")))
        .groupBy("bucket").agg(F.max("border_text").alias("border_text"))
        .select(F.col("bucket").alias("b"), "border_text", digest(canonical(F.col("border_text"))).alias("border_fp"))
    )
    marked = rows.withColumn("raw", raw_key(F.col("text"))).withColumn("fingerprint", digest(canonical(F.col("text"))))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), "tie", "tie_all")
    led = marked.select("*", F.lead("text").over(order).alias("led_text"), F.lead("fingerprint").over(order).alias("led_fp"))
    return led.join(border, (F.col("bucket") == F.col("b")) & F.col("led_text").isNull(), "left").select(
        "doc_id", "text", "raw", "fingerprint",
        F.coalesce("led_text", "border_text").alias("next_text"),
        F.coalesce("led_fp", "border_fp").alias("next_fingerprint"),
    )
