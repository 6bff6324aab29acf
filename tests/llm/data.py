"""Small documents with every defined case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(n, T.StringType()) for n in ("key", "n", "c", "_key", "_row", "grp", "part", "deal", "found", "kept", "lists", "size", "h", "root", "label", "_text")),
])
CLASHING = SCHEMA.names[5:]


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    out = []
    for k in range(words):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2 + hash((rng.randrange(vocabulary), 3)) % 6))
        out.append(word.capitalize() if k % 12 == 0 else word)
        if k % 40 == 39:
            out[-1] += "."
    return " ".join(out)


def texts() -> list[tuple]:
    """(doc_id, text, lang, source)."""
    rng = random.Random(5)
    rows: list[tuple] = []
    base = prose(1, 300)
    for k in range(40):
        rows.append((k, prose(100 + k, 20 + 7 * k), ("en", "de")[k % 2], f"s{k % 3}"))
    for k in range(40, 60):  # near copies, some over the threshold
        words = base.split()
        for _ in range(rng.randrange(1, 30)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(words), "en", "s0"))
    rows += [(k, base, "en", "s0") for k in range(60, 66)]  # exact copies
    rows += [
        (66, None, "en", "s1"), (67, "", "en", "s1"), (68, " \t\n\x0b\x0c\r ", None, None), (69, "one two three", "fr", None), (70, "ONE two Three", None, "s9"), (71, "one two three", "fr", "s9"),
        (72, "naïve Ünïcödé 世界 \U0001f600 é́ ẞ ß", "zz", "s2"), (73, "a a a a a a a a a a a a a a", "en", "s1"), (74, "line one\nline two\nline one\n\n  \nline two\nline one", "en", "s1"),
        (75, "aaaaaaaaaaaaaaaaaaaaaaaaa " * 3 + "bbbbbbb" * 9, "en", "s1"), (76, "special <|endoftext|> and <|startoftext|> inside", "en", "s1"), (77, "#*$%&|<> " * 30, "en", "s0"),
        (78, prose(3, 6000), "en", "s0"), (79, "short", "en", "s2"), (80, "tabs\tand\r\nline  ends   here \n", "en", "s2"), (81, "it's we'll they've I'm you'd he's '' 's", "en", "s2"), (82, "nul \x00 and \x1c\x1d and \x85 and  ", "en", "s2"),
        (83, "Съешь ещё этих „мягких“ булок — it’s 世界。 " * 60, "ru", "s2"), (None, "no id here at all", "en", "s1"), (None, None, None, None), (5, rows[5][1], "de", "s2"), (5, "same id, other text, same id", "en", "s2"), (40, rows[40][1], "en", "s0"),
    ]
    return rows


def frame(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *("clash",) * len(CLASHING)) for r in rows], SCHEMA).repartition(3)
