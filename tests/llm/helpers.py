"""Tables with the awkward rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    random_ = random.Random(seed)
    some = ["the", "of", "and", "in", "to", "cat", "house", "river", "stone", "ändern", "été", "Paris,", "walked.", "x1"]
    return " ".join(random_.choice(some) + random_.choice(["", "", str(random_.randint(0, 99))]) for _ in range(words))


def awkward_rows() -> list[tuple]:
    long = prose(1, 9_000)
    return [
        (None, None, None, None, None),
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", None, 4),
        (4, prose(2, 80), "en", "a", 1),
        (4, prose(2, 80), "en", "a", 1),
        (5, prose(2, 80), None, "b", 1),
        (6, prose(3, 120), "de", "b", 1),
        (7, long, "en", "b", len(long)),
        (8, long + " end", "en", "b", len(long)),
        (None, prose(4, 60), "fr", None, 1),
        (9, "one two", "en", "a", 7),
        (10, "日本語 🙂 a\x00b <|endoftext|> ▁ ́", "ja", "c", 1),
    ]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)


def clashing(df, *names):
    """``df`` with extra columns that are named like an operator's own, and some others."""
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("extra"))
    return df.withColumn("a b.c", F.lit(1))
