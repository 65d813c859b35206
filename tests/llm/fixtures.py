"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names clash with what operators make.
CLASH = ["size", "taken", "score", "lang_pred", "key", "id", "fp", "a", "line", "row", "place"]

SYLLABLES = {
    "en": "the and ing tion her ed ly wh ou st ble".split(),
    "fr": "le eau eux ai oi ment é è ê tre que".split(),
    "de": "der sch ung ein ich zu ver ü ä ß lich".split(),
}


def words(rng: random.Random, lang: str, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)]


def documents(n: int = 120, seed: int = 1) -> list[tuple]:
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = "\n".join(" ".join(words(rng, lang, rng.randint(5, 40))) + "." for _ in range(rng.randint(1, 5)))
        out.append((i, text, lang, rng.choice(["a", "a", "a", "b", "c", "d", None])))
    copies = [(n + i, out[3][1], out[3][2], "a") for i in range(10)]
    near = []
    for i in range(6):
        w = out[5][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append((n + 20 + i, " ".join(w), out[5][2], "b"))
    odd = [
        (n + 40, None, "en", "a"), (n + 41, "", "en", "b"), (n + 42, " \n\t ", None, None), (n + 43, "123 !!! 456", "en", "a"),
        (n + 44, "the " * 30_000, "en", "a"), (n + 45, "x" * 5000, "en", "b"), (n + 46, "one", "en", "é"), (n + 47, "tab\tseparated\nlines\r\nhere. <|endoftext|>", "en", "a"),
        (n + 48, "日本語 テキスト。 \U0001f600", None, "b"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in [*out, *copies, *near, *odd]]


def frame(spark, rows, clash: bool = False):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(c) for c in CLASH})
    return df


def rows_of(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
