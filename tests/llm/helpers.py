"""Small tables with the cases that every operator has to survive."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("uid", "t", "k", "src", "spans", "score", "distance", "held_out", "root", "cls", "__text", "n", "size", "bucket", "blob")


def words(rng, n, vocabulary=40):
    return " ".join(rng.choice(VOCABULARY[:vocabulary]) for _ in range(n))


VOCABULARY = [a + b for a in ("ba", "ne", "ti", "so", "lu", "ra", "ke") for b in ("n", "rt", "st", "l", "m", "ss", "ck", "d", "p", "x")]


def edge_docs(spark, rng=None, extra=True):
    rng = rng or random.Random(1)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "hello world", "en", "b", 11), (4, "hello world", "en", "b", 11),
        (None, "abc def ghi", "de", "b", 11), (5, words(rng, 9000), "en", "a", None), (6, words(rng, 60), "en", "c", None), (7, "!!! 123 ???", "fr", "c", 11), (8, "Ünïcödé ŵörds — “quoted” 漢字 🚢", "de", None, 30),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if extra else df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
