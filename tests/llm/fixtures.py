"""Small tables with the awkward cases: nulls in any column, empty and long texts, ties, repeats, and columns that clash."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("size", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("row", T.StringType()), T.StructField("h", T.IntegerType()), T.StructField("kept", T.BooleanType()), T.StructField("s", T.StringType()),
])


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8))) for _ in range(n))


def documents() -> list[tuple]:
    rng = random.Random(1)
    texts = [words(rng, rng.randint(1, 80)) for _ in range(60)]
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[0].upper(), " " + texts[1], texts[2] + "\t\n"]  # copies, also but for white space
    long = words(rng, 4000)
    near = words(rng, 300).split()
    texts += [long, long + " tail"] + [" ".join(near[:k] + ["changed"] + near[k + 1 :]) for k in (5, 50, 100, 299)]
    texts += ["", "   \n", " ", "é", "emoji 😀 text", "one two", "one two"]
    rows = [(i, t, rng.choice(["de", "en", None]), rng.choice(["a", "b", "c", "d"]), len(t)) for i, t in enumerate(texts)]
    rows += [(500, None, None, None, None), (None, "without an id", "en", "a", 3), (None, texts[0], None, None, 3), (501, None, "en", None, 0)]
    rows += [rows[3], rows[3], (502, texts[0], "en", None, 1)]  # repeated rows
    return [(*r, "x", "y", "z", 1, False, "q") for r in rows]


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)
