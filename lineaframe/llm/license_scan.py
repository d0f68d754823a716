"""License scans by diagonal voting, by DataFrame functions alone.

Templates are license notices, short ones and the texts that files carry. All rolling word k-grams of the
documents are joined to the positions at which the templates hold them (the
templates are a small fixed table, so the join is a broadcast and the k-grams
are never shuffled); the words themselves are compared too, so that a hash
collision counts for nothing. A hit votes for the diagonal "position in the
document minus position in the template". Votes are summed by diagonal;
diagonals of a longer template that are a few words apart are merged, which
bridges inserted or missing words; a merged span is verified by the share of
the template's k-grams that it holds and by its length.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word, after folding A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 3
#: Words by which neighbouring diagonals may differ, least share of k-grams, and length of a span against its template.
SLACK = 3
COVERAGE = 0.7
STRETCH = 1.5


class Template(NamedTuple):
    """A template with ``base`` counts only where all its words stand together."""

    label: str
    text: str
    base: bool


#: The base phrases, and the notices that add labels.
BASE = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", False),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", False),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", False),
    Template("mit", "released under the mit license", False),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", False),
    Template("mit", """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
        in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
        of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any
        kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no
        event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""", False),
    Template("bsd", """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary
        form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties
        including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the
        copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
        procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether
        in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
        possibility of such damage""", False),
    Template("isc", """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
        notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this
        software including all implied warranties of merchantability and fitness""", False),
    Template("apache-2.0", """
        you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties
        or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the
        license""", False),
    Template("gpl", """
        you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version
        3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without
        even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details""", False),
    Template("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", False),
    Template("unlicense", """
        this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""", False),
    Template("zlib", """
        in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software
        for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions""", False),
    Template("bsl-1.0", """
        permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by
        this license the software to use reproduce display distribute execute and transmit the software""", False),
)


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def template_rows(templates: tuple[Template, ...]) -> list[tuple]:
    """``(template, label, base, k-grams in all, words, position, w0, w1, w2)``; a shorter template is one gram."""
    rows = []
    for number, t in enumerate(templates):
        ws = t.text.split()
        k = min(K, len(ws))
        if k < 2:
            raise ValueError("a template has two words at least")
        for i in range(len(ws) - k + 1):
            rows.append((number, t.label, t.base, len(ws) - k + 1, len(ws), i, ws[i], ws[i + 1], ws[i + 2] if k > 2 else None))
    return rows


def trigger_words(templates: tuple[Template, ...]) -> list[str]:
    """Words of which every text with a verified span has one.

    A span lacks at most so many k-grams of its template; a set of words that
    stands in more of them can't be missing whole. Long words are taken first,
    then those of few templates, as they are rare.
    """
    found: set[str] = set()
    common = Counter(w for t in templates for w in set(t.text.split()))
    for t in templates:
        ws = t.text.split()
        k = min(K, len(ws))
        grams = [set(ws[i : i + k]) for i in range(len(ws) - k + 1)]
        lacking = 0 if t.base else sum(1 for n in range(len(grams)) if round(n / len(grams), 4) >= COVERAGE)
        own: set[str] = set()
        for w in sorted(set(ws), key=lambda w: (-len(w), common[w], w)):
            if sum(bool(g & own) for g in grams) > lacking:
                break
            own.add(w)
        found |= own
    return sorted(found)


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, spans`` of every row of ``docs``.

    ``spans`` is an array of ``struct<label, base, start, end, score>``, words
    from 0, ends exclusive, sorted. Null and empty texts have none; repeated
    rows and null ids stay rows of their own; an empty table gives no rows.

    Only texts with a word of :func:`trigger_words` are cut into k-grams. A
    document sends on its k-gram hits and one row that stands for itself, so
    only these are shuffled, by a number of the row; no text is.
    """
    spark = docs.sparkSession
    grams = spark.createDataFrame(
        template_rows(templates),
        "template int, label string, base boolean, grams int, length int, at int, t0 string, t1 string, t2 string",
    ).withColumn("t_hash", F.xxhash64("t0", "t1"))
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words")
    )
    n = F.size("words")
    # the last entry has no second word and stands for the document itself
    last = F.struct(F.lit("").alias("w0"), F.lit(None).cast("string").alias("w1"), F.lit(None).cast("string").alias("w2"), n.alias("pos"))
    grams_of = F.arrays_zip(
        F.col("words").alias("w0"), F.slice("words", 2, F.greatest(n, F.lit(1))).alias("w1"), F.slice("words", 3, F.greatest(n, F.lit(1))).alias("w2"),
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1).alias("pos"),
    )
    triggers = F.array(*[F.lit(w) for w in trigger_words(templates)])
    cut = F.when(F.arrays_overlap("words", triggers), F.concat(grams_of, F.array(last))).otherwise(F.array(last))
    rolled = numbered.select("row", "doc_id", n.cast("long").alias("n_words"), F.explode(cut).alias("gram"))
    rolled = rolled.select("row", "doc_id", "n_words", "gram.pos", "gram.w0", "gram.w1", "gram.w2")
    hit = (F.xxhash64("w0", "w1") == F.col("t_hash")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
    hit &= F.col("t2").isNull() | (F.col("w2") == F.col("t2"))
    voted = (
        rolled.join(F.broadcast(grams), hit, "left")
        .where("template is not null or pos = n_words")
        .select("row", "doc_id", "n_words", "template", "label", "base", "grams", "length", "at", F.col("pos").alias("pos"))
        .withColumn("diagonal", F.col("pos") - F.col("at"))
        .repartition("row")
    )
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal", "pos")
    gap = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    apart = F.when(gap <= F.when(F.col("base"), 0).otherwise(SLACK), 0).otherwise(1)
    islands = voted.withColumn("apart", apart).withColumn("island", F.sum("apart").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    k = F.least(F.lit(K), F.col("length"))
    spans = (
        islands.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "length", "island")
        .agg(F.countDistinct("at").alias("covered"), F.min("pos").alias("start"), (F.max("pos")).alias("last"))
        .withColumn("end", F.col("last") + k)
        .withColumn("score", F.round(F.col("covered") / F.col("grams"), 4))
    )
    verified = F.when(F.col("base"), F.col("covered") == F.col("grams")).otherwise(
        (F.col("score") >= COVERAGE) & (F.col("end") - F.col("start") <= F.col("length") * STRETCH)
    )
    span = F.when(
        verified,
        F.struct("label", "base", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "score"),
    )
    return spans.groupBy("row", "doc_id", "n_words").agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("row")
