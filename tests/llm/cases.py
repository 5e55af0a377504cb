"""Awkward documents that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key long, score double, size long, chunk int, h string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def documents(spark, extra=()):
    """Null in every column, empty, white space only, a very long text, ties, repeated rows, clashing columns."""
    g = random.Random(5)
    base = " ".join(g.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(g.randrange(40)) for _ in range(90))
    rows = [
        (1, base, "en", "a", len(base)),
        (1, base, "en", "a", len(base)),
        (2, base, "en", "b", len(base)),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "en", "b", 4),
        (None, "only words without a key", None, "c", None),
        (None, None, None, None, None),
        (6, LONG, "en", None, len(LONG)),
        (7, "one", "en", "c", 3),
        (8, "été \U0001f600   　 straße", "de", "c", 17),
        *extra,
    ]
    return spark.createDataFrame([(*r, 1, 0.5, 9, 3, "x") for r in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(g: random.Random, n: int) -> list[str]:
    return ["".join(g.choice("abcdefghij") for _ in range(g.randint(1, 6))) for _ in range(n)]
