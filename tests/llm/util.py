import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Nulls, empty, blank and very long texts, ties, repeated rows and odd spaces.
ODD = [
    (1, None, "en", "s"), (2, "", "en", None), (3, " \n\t ", None, "s"), (4, "one two three", "en", "s"), (5, "one two three", "en", "s"), (5, "one two three", "en", "s"),
    (None, "one two three", None, None), (6, "ab " * 30_000, "en", "s"), (7, " leading  double   spaces. And, marks! don't split 　 é á ▁x", "fr", "s"), (8, "日本語のテキスト 中文。 emoji 😀😀", "zh", "s"),
    (9, "<|endoftext|> text </s> <s> ▁▁", "en", "s"), (10, "x" * 5000, "en", "s"), (11, "a\x00b\x0bc\x85d e  f", "en", "s"),
]


def odd(spark, *extra):
    """The odd rows; ``extra``: names of more columns, which may clash."""
    schema = T.StructType([*DOCS.fields, *[T.StructField(x, T.StringType()) for x in extra]])
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["z"] * len(extra)) for i, t, lang, s in ODD], schema)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ra", "ne", "ti", "po") for c in "abcdefghijklmnopqrstuvwxy"]
    return " ".join(rng.choice(words[:vocabulary]) for _ in range(n))
