"""From raw documents to packed training sequences, in five stages.

Each stage reads all that its predecessor kept, as a written table, and applies
one operator: toxic documents go, then documents of low quality; of each group
of near copies the one with the smallest id and text hash stays; sources are mixed to their
weights; what is left is packed into sequences of token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import jaccard_join, mixing, packing, quality_classifier, toxicity
from vectrail.llm.common import discard, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity operator does not reject, nulls, empty texts and repeated rows among them; columns of any name pass."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.where("predicted = 0").select("doc.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of at least the quality cut; null and empty texts are judged like texts without words; repeated rows are judged alike."""
    scored = quality_classifier.score_quality(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.where("predicted = 1").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays.

    Rows go by id and text, as one id may stand for several texts of different groups, or of
    one. Rows without an id all stay; of rows that repeat id and text, the one whose JSON comes
    first. Only ids and hashes are grouped; texts meet the list of rows that go, and only that.
    """
    key = F.xxhash64(F.col("text").cast("binary")).alias("_key")
    classes = jaccard_join.jaccard_components(docs, keys=True).where("doc_id is not null")
    marks = classes.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.max("first").alias("stays"), F.count("*").alias("rows"))
    marks = written(marks.where("not stays or rows > 1"), "pipeline-marks")
    own = docs.select(F.col("doc_id").cast("bigint").alias("_id"), key, F.struct(*docs.columns).alias("doc"))
    left = own.join(marks.where("not stays").select("_id", "_key"), ["_id", "_key"], "left_anti")
    repeated = marks.where("stays").select("_id", "_key")
    if repeated.isEmpty():
        return left.select("doc.*")
    some = left.join(repeated, ["_id", "_key"], "left_semi").groupBy("_id", "_key").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return left.join(repeated, ["_id", "_key"], "left_anti").select("doc.*").unionByName(some.select("doc.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate asks for; null sources are one source, and rows of no words follow its rate too."""
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences with their token ids; a null or empty text is the end id alone, long texts are many pieces."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives no sequences."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{k}")
        discard(before)
    return docs
