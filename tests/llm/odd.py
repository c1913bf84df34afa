"""Small tables with nulls, blanks, very long texts, copies, repeated rows and clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import types as T

_WORDS = "the of and harbour letter window engine garden silver morning paper river castle thunder market yellow".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(_WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def texts() -> list[str | None]:
    long = prose(1, 30_000)
    near = prose(2, 200).split(" ")
    out: list[str | None] = [
        None, "", " \t\r\n\x0b\x0c ", "a", "A b", "one two three", "One\ttwo\n\nthree", "12345 67890", "...",
        long, long.replace(" ", "\n", 500), "x" * 200_000, "É là où ça finit — 東京 😀 ▁ \x00 end",
        " ".join(near), " ".join(near[:-1] + ["changed"]), " ".join(near).upper(), "  ".join(near) + "\n",
        "Same line of text here\nother line number one\nSame line of text here", "  same LINE of text here \nshort\nlast line of them all",
        "same line of text here", "tail\n\n", "\n\n\n", "<|endoftext|> is text",
    ]
    return out + ["one copy among many"] * 5


FIELDS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# names that the operators use inside
CLASHES = ["size", "pos", "key", "rep", "kept", "keep_id", "recipe", "bucket", "copies", "_copies", "_kept_id", "_mixed_id", "_language", "spans", "ids", "h"]


def docs(spark, rows=None, extra: bool = True):
    if rows is None:
        sources = ["b", "a", None, "é", "B"]
        rows = [(i * 7 % 101, t, ["en", "de", None][i % 3], sources[i % 5], len(t or "")) for i, t in enumerate(texts())]
        rows += [rows[3], rows[9], (None, "no id", "en", "a", 5), (None, None, None, None, None)]
    schema = T.StructType(FIELDS.fields + [T.StructField(c, T.StringType()) for c in CLASHES] * extra)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES) * extra) for r in rows], schema).repartition(3)


def no_docs(spark):
    return docs(spark, [], extra=False)
