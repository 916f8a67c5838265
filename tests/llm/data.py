"""Small tables with the awkward cases."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # Names that operators use themselves.
          "key string, size string, kept string, set string, blob string, run string, n string")


def prose(seed: int, n: int, words: int = 400) -> str:
    pick = random.Random(seed)
    names = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 8))) for _ in range(words)]
    return " ".join(pick.choice(names) for _ in range(n))


def rows(*pairs, lang="en", source="s"):
    return [(i, t, lang, source, None, *["x"] * 7) for i, t in pairs]


LONG = prose(1, 30_000)
EDGE = rows((1, "One two three."), (2, None), (3, ""), (4, LONG), (4, LONG), (5, " \n\t \n"),
            (None, "One two three."), (None, None), (6, "ONE TWO three."), (7, "naïve Été ½ 北京 🙂 <|endoftext|>"),
            (8, "x" * 5_000), (9, "a a a a a a a a a a a a a a a a a a a a"), (10, "...")) + [
    (11, "null source and language", None, None, None, *["x"] * 7)]


def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table_of(spark, pairs, **kw):
    return spark.createDataFrame(rows(*pairs, **kw), SCHEMA)
