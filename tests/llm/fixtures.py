"""Small document tables with the awkward cases: nulls, blanks, repeats, long texts, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, digest long, fp long, `a.b` int, __id string, __cut long, __taken long, row string, id string, rest string, words int"
AWKWARD = (5, "own id", 6, 7, "own row", "own", "own rest", 8)
SYLLABLES = ["ka", "lo", "mi", "ter", "an", "sho", "un", "ri", "vel", "do"]


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    shared = prose(rng, 40)
    base = [prose(rng, rng.randrange(3, 120)) for _ in range(30)]
    near = [base[0][:-3] + "zz", base[1] + " end", base[2].replace(" ", "  ")]
    return [None, "", "   \n\t ", "a", "Two words", *base, *near, base[3], base[3], shared, "x " + shared + " y", shared + " " + shared, "ab" * 300, "é" * 150 + "ß", "Ünïcödé Ωmega\x00nul \U0001f600" * 9, prose(rng, 3000)]


def documents(spark, extra_repeat: bool = True):
    rows = [(i * 3 + 1, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "S0"][i % 4], len(t or ""), 7, "k", 9, 11, *AWKWARD) for i, t in enumerate(texts())]
    if extra_repeat:
        rows += [rows[8], rows[8], (None, "null id " * 20, "en", "s1", 1, 1, None, 1, 1, *AWKWARD), (rows[9][0], "another text under one id " * 8, None, "s2", 1, 1, "k", 2, 3, *AWKWARD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
