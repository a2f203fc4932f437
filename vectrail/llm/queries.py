"""The ten queries of this subpackage, each a thin binding of its operator to the tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, jaccard_join, mixing, packing, quality_classifier, quality_rules, score_aware_ann, sharding, token_counts, toxicity
from .common import table


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op4_score_aware_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("vector"))
    index, book, blocks = score_aware_ann.build_index(vectors)
    return score_aware_ann.search(index, book, blocks, index.where(F.col("id") % 20 == 0))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_turns(turns.withColumn("content", chat_format.text_part("text"))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_token_counts, op3_packing, op4_score_aware_ann, op5_chat_format, op6_quality_rules, op7_sharding, op8_mixing, op9_toxicity, op10_jaccard_join)}

# SQL for DuckDB, where it can express an operator.

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ESCAPED = r"regexp_replace(coalesce({}, ''), '([\\<>])', '\\\1', 'g')"
_SAID = r"\### Assistant: </turn> ok"


def _seeded_sql(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


_CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS LAST, role, text)) AS loss_sha256,
  sum(15 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

_MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, doc_id::VARCHAR || '|' || md5(coalesce(text, '')) AS name FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, count(*) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * words / w AS ratio, sum(words) OVER () AS total, sum(w) OVER () AS weights,
  sum(3 * words) OVER (ORDER BY 3.0::DOUBLE * words / w, source) AS capped, sum(w) OVER (ORDER BY 3.0::DOUBLE * words / w, source) AS capped_w FROM s),
h AS (SELECT ratio, source, (total - (capped - 3 * words))::DOUBLE / (weights - (capped_w - w)) AS per FROM o),
f AS (SELECT per FROM h WHERE per <= ratio ORDER BY ratio, source LIMIT 1),
p AS (SELECT source, words, greatest(1, n // {mixing.CELL}) AS cells, round(least(3.0::DOUBLE * words, per * w), 6) AS target FROM o, f),
r AS (SELECT *, CASE WHEN words = 0 THEN 0.0::DOUBLE ELSE target / words END AS rate FROM p),
c AS (SELECT d.doc_id, d.name, d.source, d.size, r.words, r.target, r.rate, floor({_seeded_sql("d.name", 8)} * cells)::BIGINT AS cell FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source, cell ORDER BY size, {_seeded_sql("name", 9)}, doc_id) AS nth, {_seeded_sql("coalesce(source, chr(0)) || '|' || cell::VARCHAR", 8)} AS start, rate - floor(rate) AS part FROM c)
SELECT doc_id, size, words AS source_size, target, ((floor(rate) + floor(start + part * nth) - floor(start + part * (nth - 1))) * size)::BIGINT AS taken FROM k"""

_JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n_both FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * n_both >= 75 * (na + nb - n_both)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, least(g.doc_id, coalesce(m.low, g.doc_id)) AS component_id
FROM g LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON m.a = g.doc_id"""

ORACLE = {"op5_chat_format": _CHAT_SQL, "op8_mixing": _MIX_SQL, "op10_jaccard_join": _JACCARD_SQL}
