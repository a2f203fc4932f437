"""Exact search: score, threshold, top-k, metadata.

A table to search has ``id``, ``vector`` and any other columns.  Scores are
doubles; results are best first with ties to the smaller id; ``order="asc"``
turns them round, best last.

Scoring many queries runs in tiles (``tiles``): a matrix product of some queries and
some rows, of which only each query's ``k`` best leave a task.  Few queries travel in
the closure, up to ``MOST_BYTES``; of more, a task holds a block while the table
streams past, so that neither side is ever held whole and no pairs are shuffled.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector
from ..model import DEFAULT_THRESHOLD, DEFAULT_TOP_K, Similarity
from . import tiles
from .tiles import MOST_BYTES


def _checked(k: int) -> int:
    if k is None or k <= 0:
        raise ValueError("k must be positive")
    return k


def scored(table: DataFrame, query, similarity: Similarity = Similarity.COSINE, threshold: float | None = DEFAULT_THRESHOLD) -> DataFrame:
    """Rows with their score to one query vector, where it is a number on the right side of the threshold.

    The score is computed in its own projection, once; the filter reads its value.
    """
    query = [float(x) for x in query]
    one = table.select(*[c for c in table.columns if c != "score"], F.array(vector.score("vector", vector.literal(query), similarity)).alias("_s"))
    rows = one.withColumn("score", F.explode("_s")).drop("_s")
    return rows.where(vector.passes("score", similarity, threshold))


def top_k(rows: DataFrame, k: int, similarity: Similarity = Similarity.COSINE, by: tuple[str, ...] = (), id_: str = "id", value: str = "score") -> DataFrame:
    """The k best rows, overall or of each group in ``by``; partial limits run before the shuffle."""
    _checked(k)
    best = [vector.order(value, similarity), F.col(id_).asc()]
    if not by:
        return rows.orderBy(*best).limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def merge_top_k(parts: list[DataFrame], k: int, similarity: Similarity = Similarity.COSINE) -> DataFrame:
    """Top-k of several partial top-k results; a row that several hold counts once."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return top_k(rows.dropDuplicates(["id"]), k, similarity)


def arranged(rows: DataFrame, similarity: Similarity, order: str = "desc", by: tuple[str, ...] = ()) -> DataFrame:
    """Best first (``desc``) or best last (``asc``)."""
    best_first = [vector.order("score", similarity), F.col("id").asc()]
    turned = [F.col("score").desc() if similarity is Similarity.EUCLIDEAN else F.col("score").asc(), F.col("id").desc()]
    return rows.orderBy(*by, *(best_first if order == "desc" else turned))


def search(
    table: DataFrame, query, k: int = DEFAULT_TOP_K, threshold: float | None = DEFAULT_THRESHOLD, similarity: Similarity = Similarity.COSINE,
    where: Column | None = None, order: str = "desc", columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """The k rows nearest to one vector. ``where`` filters rows, by metadata for one, before they are scored."""
    _checked(k)
    rows = table if where is None else table.where(where)
    chosen = [c for c in table.columns if c != "vector"] if columns is None else columns
    keep = [c for c in chosen if c not in ("id", "score")]
    best = top_k(scored(rows.select("id", "vector", *keep), query, similarity, threshold), k, similarity)
    return arranged(best.select("id", "score", *keep), similarity, order)


def search_batch(
    table: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, threshold: float | None = DEFAULT_THRESHOLD, similarity: Similarity = Similarity.COSINE, dim: int | None = None, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """query_id, id, score, rank for every row (id, vector) of ``queries``."""
    _checked(k)
    if dim is None:
        first = queries.where(F.col("vector").isNotNull()).select(F.size("vector")).first()
        dim = first[0] if first else 1
    rows, n = table.select("id", "vector"), queries.count()
    found = tiles.best(rows, queries.select("id", "vector"), n, lambda part: tiles.Best(part, k, threshold, similarity), dim, k, most_bytes)
    return top_k(found, k, similarity, by=("query_id",))


def within(found: DataFrame, millis: float) -> DataFrame:
    """``found``, evaluated now; a TimeoutError, and its jobs cancelled, if that takes longer. For results of a few rows."""
    spark, group, late = found.sparkSession, f"within-{uuid.uuid4().hex}", threading.Event()
    context = spark.sparkContext

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    watch, names = threading.Timer(millis / 1000, stop), ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = [context.getLocalProperty(n) for n in names]
    context.setJobGroup(group, f"a query of at most {millis} ms", True)
    watch.start()
    try:
        rows = found.collect()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"the query took more than {millis} ms") from None
        raise
    finally:
        watch.cancel()
        for n, value_ in zip(names, before, strict=True):
            context.setLocalProperty(n, value_)
    if late.is_set():
        raise TimeoutError(f"the query took more than {millis} ms")
    return spark.createDataFrame(rows, found.schema)


def with_metadata(found: DataFrame, meta: DataFrame, how: str = "left") -> DataFrame:
    """Metadata after the top-k. ``left``: missing metadata is ``{}``; ``inner``: such rows go."""
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    rows = found.join(meta.select("id", "meta"), "id", how)
    return rows.withColumn("meta", F.coalesce("meta", F.lit("{}")))


def hybrid(indexed: DataFrame, fresh: DataFrame, k: int, similarity: Similarity = Similarity.COSINE) -> DataFrame:
    """Results of an index and of rows newer than it; a row that is in both counts once."""
    return merge_top_k([indexed.select("id", "score"), fresh.select("id", "score")], k, similarity)


def not_indexed(table: DataFrame, last_id: int | None = None, indexed: DataFrame | None = None) -> DataFrame:
    """Rows that an index does not hold: beyond its last id, or whose id it lacks."""
    if indexed is not None:
        return table.join(indexed.select("id"), "id", "left_anti")
    return table if last_id is None else table.where(F.col("id") > last_id)


def get(table: DataFrame, id_: int) -> DataFrame:
    return table.where(F.col("id") == id_)


def value(table: DataFrame, id_: int) -> DataFrame:
    return get(table, id_).select("id", "vector")


def ids_of(table: DataFrame, rid: str) -> DataFrame:
    """The newest row of a business key."""
    return table.where(F.col("rid") == rid).agg(F.max("id").alias("id")).where(F.col("id").isNotNull())


def after(table: DataFrame, id_: int) -> DataFrame:
    return table.where(F.col("id") > id_).orderBy("id")


def keys(table: DataFrame) -> DataFrame:
    return table.select("id").orderBy("id")


def last_id(table: DataFrame) -> DataFrame:
    return table.agg(F.max("id").alias("last_id"))


def count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"))
