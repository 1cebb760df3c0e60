"""Small tables that every operator must cope with, and brute force."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, start long, node long, id long, h long, g string"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rng = random.Random(3)
    words = [f"wörd{k}" for k in range(500)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [(1, "a b c d e f g h i j k l"), (2, ""), (3, None), (4, "   \n\t"), (5, long), (6, "x" * 70_000), (7, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"), (8, "\U0001f600 é\u0301 <|endoftext|>"), (9, long), (None, "no id at all here"), (None, None)]
    rows = [(d, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, None, 5, k, k, 1, "q") for k, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text, lower=True):
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def some(spark, n=None, sf="0.001"):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    return df if n is None else df.where(f"doc_id < {n}")
