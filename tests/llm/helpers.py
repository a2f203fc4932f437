"""Small tables with the odd cases that every operator must stand."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 9973}" for i in range(30_000)) + ".\n"

ODD = [
    (1, "A plain sentence of a few words. Another one follows here.", "en", "a"),
    (1, "A plain sentence of a few words. Another one follows here.", "en", "a"),  # a repeated row
    (2, "A plain sentence of a few words. Another one follows here.", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n\v\f\r ", "en", "b"),
    (None, "No id at all, but some words are here.", "en", "b"),
    (7, LONG, "en", "c"),
    (8, "one", "en", "c"),
    (9, "Ünïcödé \U0001f600 – “quotes” naïve façade 中文字符 слово.", "fr", ""),
    (10, "<|endoftext|> a\x00b \\ </turn> <turn x> ###", "en", "c"),
    (11, "one two three four", "en", "c"),
    (12, "ONE two three four", "en", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Names that operators use inside.
CLASHES = ("n", "fp", "x", "size", "score", "held_out", "predicted", "bundle", "shard", "bucket", "doc", "rate", "cell", "n_words", "id")


def odd_documents(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint"))
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).repartition(3)


def no_documents(spark):
    return odd_documents(spark).where("false")


def rows(df):
    return [r.asDict() for r in df.collect()]


def documents(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
