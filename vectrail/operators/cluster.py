"""Samples and centroids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reservoir(table: DataFrame, n: int, seed: int = 0, by: str = "id") -> DataFrame:
    """n rows in order of a seeded hash of ``by``; all rows if there are fewer. The same seed gives the same rows.

    Rows are thinned by the same hash first, so that the last step sees little more
    than ``n`` of them.
    """
    hashed = F.pmod(F.xxhash64(F.col(by), F.lit(seed)), F.lit(1 << 30))
    rows = table.count()
    share = (n + 6 * math.sqrt(n) + 20) / rows if rows else 1
    if share < 0.5:
        few = table.where(hashed < int(share * (1 << 30)))
        if few.count() >= n:  # else hashes are uneven, as repeated values of ``by`` make them
            table = few
    return table.withColumn("_h", hashed).orderBy("_h", by).drop("_h").limit(n)


def centroids(table: DataFrame, k: int, max_iter: int = 100, seed: int = 1) -> np.ndarray:
    """(k or fewer, dim) centroids of the vectors by k-means with parallel k-means++ seeding."""
    rows = table.where(F.col("vector").isNotNull()).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, initMode="k-means||").fit(rows)
    return np.array(model.clusterCenters())


def centroid_rows(table: DataFrame, k: int, max_iter: int = 100, seed: int = 1) -> DataFrame:
    found = centroids(table, k, max_iter, seed)
    return table.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cell int, centroid array<double>")
