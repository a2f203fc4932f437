"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remover, shared_path

#: A word: a run of characters other than space and \\t \\n \\v \\f \\r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors.

    The table goes when the application ends; ``discard`` drops it earlier.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vectrail_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_vectrail_path", None):
            remover(t.sparkSession)(path)


def tasks(spark: SparkSession, least: int = 1) -> int:
    """Partitions that a keyed shuffle of this session has."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def row_hash() -> Column:
    """Names a row's id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))


def learnable(docs: DataFrame) -> DataFrame:
    """doc_id and h, the ``row_hash``, of rows that a model may learn from: not held out and with an id. A written table."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_hash().alias("h"))
    return written(own.where(F.col("doc_id").isNotNull() & ~held_out()), "learnable")


def thinned(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` of the distinct ``rows``, one for each value of the column h, in order of a seeded hash of h.

    Rows are thinned by the same hash first, by the number of distinct values, so that the
    limit sees little more than ``most`` rows however many there are and however often they repeat.
    """
    order = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 30))
    distinct = rows.agg(F.approx_count_distinct("h")).first()[0]
    share = (1.5 * most + 100) / max(1, distinct)
    few = rows.where(order < int(share * (1 << 30))) if share < 0.5 else rows
    return few.dropDuplicates(["h"]).orderBy(order, "h").limit(most)


def sampled(keys: DataFrame, most: int, seed: int) -> list[tuple[int, int]]:
    """At most ``most`` distinct rows of ``keys``, as (doc_id, h)."""
    return [(r.doc_id, r.h) for r in thinned(keys.select("doc_id", "h"), most, seed).collect()]


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """text and the further columns of ``chosen``, which has doc_id and h: one row for each that ``docs`` has.

    ``chosen`` is broadcast, as its size is a parameter of the sample.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_hash().alias("h"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(chosen.columns)


def bound_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """Arrow batches to Python hold about ``most_bytes``, unless the session says otherwise: texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(most_bytes))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving freed memory back to the system at its end: workers are used again by other stages."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def scored(docs: DataFrame, make: Callable[[], Callable[[list], np.ndarray]], cut: float, carry: bool = False, rows: int = 256) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; with ``carry`` also the row as the struct ``doc``, whose names cannot clash.

    Only the text goes to Python, and only a score comes back. ``make`` gives the function from
    texts to scores; it gets a few rows at a time, to hold few texts as Python strings.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = make()
        for texts in batches:
            parts = [of(texts.slice(at, rows).to_pylist()) for at in range(0, len(texts), rows)]
            yield pa.array(np.concatenate([np.empty(0), *parts]))
        give_back()

    # Called nondeterministic so that a filter on the score is not moved below it, which would score every text twice.
    score = F.arrow_udf(run, "double").asNondeterministic()
    row = [F.struct(*docs.columns).alias("doc")] if carry else []
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), score(F.col("text").cast("string")).alias("score"), *row)
    return ids.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), *(["doc"] if carry else []))
