import random

import pytest

#: Columns of documents, then columns that clash with names inside operators and in their results.
EXTRA = ("score", "size", "row", "words", "spans", "fp", "mix", "found", "component_id", "target", "label", "labelled_id", "sample", "hits",
         "n_words", "key", "bucket", "tie", "host", "rule", "root", "least", "passages", "document", "fingerprint", "canon",
         "__found", "__text", "__rounds", "__sim_id", "__sim_null", "__sim_tie", "__sim_turn", "__mix_size", "__mix_key", "__mix_found", "__mix_turn")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)


def frame(spark, rows):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)``, with clashing columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1]) if r[1] is not None else None, *["x"] * len(EXTRA)) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def vocabulary(n=60, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(n)]


def prose(rng, n, words=tuple(vocabulary())):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and white texts, a very long text, ties and repeated rows."""
    rng = random.Random(9)
    long = prose(rng, 40_000)
    body = prose(rng, 120)
    return [
        (None, None, None), (None, "", "a"), (1, None, "a"), (2, "", None), (3, " \n\t", "b"), (4, "!!! --- ???", "b"), (5, long, "c"), (6, body, "c"),
        (7, body, "c"), (7, body, "c"), (8, body + " more words here", None), (9, "a", "d"), (10, "é" * 5000, "d"), (11, "x" * 300_000, "d"),
        (12, "\x00\ufeff odd \U0001f600 text", "d"), (13, body.upper(), "d"), (None, body, "d"),
    ]
