"""A documents table with every odd case."""

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(30_000))
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for columns of their own
    T.StructField("h", T.StringType()), T.StructField("f", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("ids", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("tree", T.StringType()), T.StructField("size", T.StringType()), T.StructField("key", T.StringType()), T.StructField("k", T.StringType()),
])

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, LONG, "en", "a"),
    (5, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
    (5, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
    (None, "a row without an id", "en", "a"),
    (7, "\t \n", "de", ""),
    (8, "x", None, "a"),
    (9, "日本語 テキスト 😀 Ünïcödé line ▁ sep", "ja", "c"),
    (10, "alpha beta gamma " * 40, "en", "a"),
    (11, "same line\nsame line\nother\n \nsame line", "en", "a"),
]


def rows(texts=TEXTS):
    return [(i, t, lang, s, None if t is None else len(t), *"x" * 10) for i, t, lang, s in texts]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts), SCHEMA)


def at(tmp_path, spark, texts=TEXTS, benchmark=((1, "over the lazy dog near the river bank today"),)):
    """A folder with documents and benchmark, as queries take it."""
    d = str(tmp_path)
    docs(spark, texts).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.mode("overwrite").parquet(f"{d}/benchmark.parquet")
    return d
