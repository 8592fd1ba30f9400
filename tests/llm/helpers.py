"""Small tables with the awkward cases every operator has to take."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("body", T.IntegerType()), T.StructField("items", T.StringType())])


def table(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA).repartition(3)


def prose(seed, n_words, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéghß") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n_words))


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "it's 'tis we'll they've 'rx don't!'s '"), (6, "a" * 5000), (7, "Ünïcödé ΣΑΣ İ ﬁ 東京 😀👩‍👩‍👧     x\u0085y \x1c z"), (8, "x<|endoftext|>y <|startoftext|> z"), (9, "one"), (9, "one"), (10, "12 345 6.7 !!! ...'s '' 'll"), (11, "\x00\x01 nul")]
