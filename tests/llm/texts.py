"""Rows that every text operator must stand."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(r.choice(vocab) for _ in range(n))


def odd_rows() -> list[tuple]:
    long = prose(1, 60_000)
    return [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (None, "no id at all in this row of text", "en", "a", 1),
        (3, " \t\n\x0b\x0c\r ", "en", "a", 6),
        (4, "one", "en", "a", 3),
        (5, "Ünïcödé wörds with odd spaces and emoji 😀 here ok", "de", "b", 1),
        (6, "same line\nsame line\nsame line\n\n\nother", "en", "b", 1),
        (7, "a b c d e a b c d e a b c d e f", "en", "b", 1),
        (8, "### *** && <b> | $ % x", "en", "c", 1),
        (9, long, "en", "c", len(long)),
        (9, long, "en", "c", len(long)),
        (10, "tail without newline\r\nsecond\r\nsecond\r", "fr", "c", 1),
        (11, "word " * 40, "fr", "c", 1),
        (12, prose(2, 300) + "\n" + prose(3, 200), "es", "d", 1),
    ]


def frame(spark, rows, extra: bool = True):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumn("kept", F.lit(1)).withColumn("_at", F.lit("x")).withColumn("rules", F.lit(2.0)).withColumn("a.b", F.lit(0))
    return df
