"""Small document tables shared by the tests of the corpus operators."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
# Names that operators use inside.
CLASHES = ("k1", "k2", "row", "h", "lines", "fp", "label", "score", "places", "doc", "root", "low", "unit", "own", "at", "x")

ODD_ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "two words"), (6, "two words"),
    (None, "an orphan text without an id, long enough to matter to windows of thirteen words in all"),
    (None, None), (7, "x" * 5000), (8, ("word " * 30_000).strip()),
    (9, "an orphan text without an id, long enough to matter to windows of thirteen words in all"),
    (10, "line a\nline a\n\nline b\n"), (11, "é中😀    mixed\x0bspace"),
]


def frame(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t) for i, t in rows], SCHEMA).repartition(3)
    if clash:
        for c in CLASHES:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(r.choices(words, k=n))


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
