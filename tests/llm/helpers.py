"""Small fixtures: odd rows that every operator has to survive, and plain Python twins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def docs_of(spark, texts: dict | list, source: str | None = "s"):
    items = list(texts.items()) if isinstance(texts, dict) else list(texts)
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in items], DOCS)


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long_text = " ".join(f"word{k % 977}" for k in range(30_000)) + "\n" + "\n".join(f"a line with the number {k} in it, long enough to count" for k in range(3_000))
    rows = [
        (1, "plain words in a short text", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0),
        (None, "a text without an id but with words", "en", None, 1), (4, long_text, "de", "b", 1),
        (5, "same text twice " * 20, "en", "a", 1), (5, "same text twice " * 20, "en", "a", 1), (6, "same text twice " * 20, "en", "a", 1),
        (5, "the same id with another text", "en", "c", 1), (7, " \t\n\n ", "en", "a", 1), (2**60 + 1, "a large id", "en", "a", 1),
        (None, None, None, None, None), (8, "Straße ÀÉ 日本 🙂 <|endoftext|> 's", "fr", "b", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("h", "g", "n", "pos", "size", "score", "word", "hash", "bitmap", "slot", "doc", "item", "row"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
