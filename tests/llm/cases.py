"""Small inputs that the operators' tests share."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd: random.Random, n: int) -> str:
    parts = ["the", "of", "and", "tion", "er", "ing", "Ué", "ß", "#x", "a|b", "ÇA", "don't", "42", "over"]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    """Nulls, empty and blank texts, one long text, copies, near copies, shared passages, repeated rows, a null id."""
    rnd = random.Random(seed)
    passage = words(rnd, 70)
    rows: list[tuple] = []
    for i in range(n):
        text = words(rnd, rnd.choice([0, 1, 2, 3, 40, 60, 120]))
        if i % 7 == 3:
            text = f"{text} {passage} {words(rnd, 5)}"
        if i % 11 == 5 and i > 11:
            text = rows[i - 9][1]
        rows.append((i * 3, text, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s10", None]), len(text or "")))
    long = words(rnd, 9000)
    rows += [(1000, long, "en", "s1", len(long)), (1001, long + " end", "en", "s2", 0), (1002, None, None, None, None), (1003, "", "en", "s1", 0), (1004, " \n\t ", "en", "s1", 4), (1005, "aaaa" * 60, "en", "s1", 240), (1006, "x" + "aaaa" * 40, "en", "s1", 161), (1007, rows[4][1].replace("the", "The") if rows[4][1] else "", "en", "s1", 0)]
    rows += [rows[10], rows[10], (None, "a text without an id " * 6, "en", "s1", 0), (None, passage, None, "s2", 0)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def awkward(df):
    """With more columns, of names that operators use themselves."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("unit", "row", "fp", "size", "n_words", "bin", "_kept", "_again", "_first", "_wave", "_shard", "_n_bytes", "part", "doc", "key", "a.b", "stratum"))))
