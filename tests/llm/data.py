"""Small documents that hold every awkward case."""

import random

from pyspark.sql import types as T

# Clashing names: columns that operators use inside or return.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("score", "class_id", "ids", "n", "key", "rep", "removed", "version", "h0", "quality", "start", "held_out"))])


def prose(seed: int, words: int, letters: str = "etaoinshrdlu") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(words))


def awkward(spark):
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [(1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "word"), (8, "one two three four"), (9, prose(2, 40_000)), (10, "日本語のテキスト é ñ 😀 ▁"), (None, base), (11, "x" * 50_000), (12, "!!! ??? 123"), (13, "a\n\n\nb\n" + base + "\n" + base), (14, "İstanbul ẞ Ḱ " + prose(3, 50))]
    langs = ["en", None, "de", "fr"]
    rows = [(i, t, langs[k % 4], "s", len(t or ""), *["x"] * 12) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")


def items(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string, doc_id long")
