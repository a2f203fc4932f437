"""Operator 7: longest-processing-time sharding.

Rows with equal texts form a group that stays together.  Groups are sorted by
size and each goes to the least-loaded shard, through a heap.  The heap works on
a bounded list at every scale: a group holding more than one part in
``shards * fineness`` of all bytes is scheduled by itself (there are fewer than
``shards * fineness`` of those), the others travel in ``bundles`` hash bundles
of whole groups.  While there are fewer groups than bundles, most bundles hold
one group.

Size: UTF-8 bytes of the text plus 16.  Defined results:

* null text: no bytes, the CRC of no bytes, in one group with empty texts;
* null doc_id: sharded like any other row;
* repeated rows: each gets its own slot; an empty table gives no rows;
* ties of size go to the lower hash bundle and shard; very long texts are hashed and
  measured whole;
* extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUNDLES = 1 << 15
FINENESS = 256
SLOT_BLOCK = 50_000


def schedule(sizes: list[tuple[int, object]], shards: int) -> dict:
    """LPT: (size, key) pairs, largest first, each to the least-loaded shard; ties go to the lower key and shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_documents(docs: DataFrame, shards: int, bundles: int = BUNDLES, fineness: int = FINENESS) -> DataFrame:
    """doc_id, size, text_crc32, group_key, shard, slot; group sums near-equal over shards."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 16).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group_key"),
        ).withColumn("bundle", F.pmod(F.xxhash64("group_key"), F.lit(bundles)).cast("int")),
        "sharding",
    )
    groups = slim.groupBy("group_key", "bundle").agg(F.sum("size").alias("size"))
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cut = total / (shards * fineness)
    large = {(r.bundle, bytes(r.group_key)): r["size"] for r in groups.where(F.col("size") > cut).collect()}  # under shards * fineness rows
    loads = groups.where(F.col("size") <= cut).groupBy("bundle").agg(F.sum("size").alias("size")).collect()  # at most `bundles` rows
    placed = schedule([(r["size"], (r.bundle, b"")) for r in loads] + [(s, k) for k, s in large.items()], shards)
    by_bundle = spark.createDataFrame([(b, s) for (b, k), s in placed.items() if not k] or [(-1, 0)], "bundle int, by_bundle int")
    by_group = spark.createDataFrame([(bytearray(k), s) for (b, k), s in placed.items() if k] or [(bytearray(b"-"), 0)], "group_key binary, by_group int")
    # Both lists are bounded by the parameters, not by the data.
    put = (
        slim.join(F.broadcast(by_bundle), "bundle", "left")
        .join(F.broadcast(by_group), "group_key", "left")
        .withColumn("shard", F.coalesce("by_group", "by_bundle"))
    )
    return with_slots(put.select("doc_id", "size", "text_crc32", "group_key", "shard"), shards, rows)


def with_slots(put: DataFrame, shards: int, rows: int, block: int = SLOT_BLOCK, run: int = 10_000) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    No task sees a whole shard, and none sees all copies of a row: equal rows are counted
    before the shuffle and numbered as one, distinct rows are placed within blocks of a
    shard, and a block starts where the counts of the blocks before it end.  Copies are
    rows again at the end, in runs of ``run`` that are dealt anew.
    """
    blocks = max(4, -(-rows // (shards * block)))
    distinct = put.groupBy(*put.columns).agg(F.count("*").alias("m")).withColumn("block", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = distinct.groupBy("shard", "block").agg(F.sum("m").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "group_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn("before", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(starts.select("shard", "block", "start"), ["shard", "block"])
    first = placed.withColumn("first", F.col("start") + F.col("before")).drop("start", "before", "block")
    long = first.where(F.col("m") > run).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / run))))
    long = long.withColumn("first", F.col("first") + F.col("k") * run).withColumn("m", F.least(F.lit(run).cast("bigint"), F.col("m") - F.col("k") * run)).drop("k").repartition(F.col("first"))
    runs = first.where(F.col("m") <= run).unionByName(long)
    return runs.select(*put.columns, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("m") - 1)).alias("slot"))
