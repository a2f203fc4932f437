"""Vector functions on columns: built-in expressions where they exist, Arrow batches where they do not."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Similarity
from . import kernels


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _products(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def same_length(a, b) -> Column:
    return F.size(_col(a)) == F.size(_col(b))


def dot(a, b) -> Column:
    """Null if the lengths differ."""
    a, b = _col(a), _col(b)
    return F.when(same_length(a, b), _sum(_products(a, b)))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b) -> Column:
    """Null for a zero vector or different lengths."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a, b, truncate: bool = False) -> Column:
    """Null if the lengths differ; ``truncate`` compares the common length instead."""
    a, b = _col(a), _col(b)
    if truncate:
        n = F.least(F.size(a), F.size(b))
        a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.when(same_length(a, b), F.sqrt(_sum(squares)))


def euclidean_2d(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(_col(x1) - _col(x2), F.lit(2.0)) + F.pow(_col(y1) - _col(y2), F.lit(2.0)))


def score(a, b, similarity: Similarity) -> Column:
    return {Similarity.DOT_PRODUCT: dot, Similarity.COSINE: cosine, Similarity.EUCLIDEAN: euclidean}[similarity](a, b)


def passes(value, similarity: Similarity, threshold: float | None) -> Column:
    """The inclusive threshold. Spark holds NaN above every number, so NaN is excluded by name."""
    value = _col(value)
    good = value.isNotNull() & ~F.isnan(value)
    if threshold is None:
        return good
    return good & (value <= threshold if similarity is Similarity.EUCLIDEAN else value >= threshold)


def order(value, similarity: Similarity) -> Column:
    value = _col(value)
    return value.asc() if similarity is Similarity.EUCLIDEAN else value.desc()


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once a row, not once for each element that a lambda visits."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize(a) -> Column:
    """Unit length; a zero vector stays as it is. The norm is taken once."""
    a = _col(a)
    pair = F.struct(a.alias("v"), norm(a).alias("n"))
    return _once(pair, lambda z: F.transform(z["v"], lambda x: F.coalesce(F.try_divide(x.cast("double"), z["n"]), x.cast("double"))))


def doubles(a) -> Column:
    return _col(a).cast("array<double>")


def floats(a) -> Column:
    return _col(a).cast("array<float>")


def hamming(a, b) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def hamming_words(a, b) -> Column:
    """Of bit strings held as arrays of words."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def mean_pool(tokens, mask) -> Column:
    """Mean of the token vectors whose mask is not 0; a zero vector if there are none."""
    tokens, mask = _col(tokens), _col(mask)
    active = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["t"])
    width = F.size(F.element_at(tokens, 1))
    zero = F.array_repeat(F.lit(0.0), width)
    total = lambda rows: F.aggregate(rows, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    sums = _once(active, lambda rows: F.struct(total(rows).alias("t"), F.size(rows).cast("double").alias("n")))
    return _once(sums, lambda z: F.transform(z["t"], lambda x: F.coalesce(F.try_divide(x, z["n"]), F.lit(0.0))))


def mean_vector(df: DataFrame, by: list[str], vector: str = "vector", alias: str = "vector") -> DataFrame:
    """Mean of the vectors of each group, by position; partial sums are formed before the shuffle."""
    dim_rows = df.select(*by, F.posexplode(vector).alias("pos", "x"))
    means = dim_rows.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    together = means.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return together.select(*by, F.transform("v", lambda z: z["x"]).alias(alias))


def fwht_function():
    """Walsh-Hadamard transform; raises unless the length is a power of two above 1."""

    return kernels.row_function(kernels.fwht, "array<double>")


def fwht(a) -> Column:
    return fwht_function()(doubles(a))


def fwht_normalized(a) -> Column:
    a = _col(a)
    return F.transform(fwht(a), lambda x: x / F.sqrt(F.size(a).cast("double")))


def project(a, matrix: np.ndarray) -> Column:
    """Unscaled projection by a (k, D) matrix."""
    k, d = matrix.shape
    if not k < d:
        raise ValueError("a projection makes vectors shorter")

    return kernels.row_function(lambda rows: rows @ matrix.T, "array<double>")(doubles(a))


def random_projection(a, dim: int, to: int, seed: int) -> Column:
    return project(a, kernels.gaussian(to, dim, seed))


def compress(a, codec) -> Column:
    """Any Python function from a vector to a shorter one."""

    return kernels.row_function(lambda rows: np.stack([np.asarray(codec(x), np.float64) for x in rows]), "array<double>")(doubles(a))


def random_vectors(spark, count: int, dim: int, seed: int, kind: str = "gaussian", unit: bool = False) -> DataFrame:
    """(id, vector) rows, reproducible for a seed: gaussian, sign_uniform (unit) or uniform in [0, 1)."""
    draw = {"gaussian": lambda s: kernels.gaussian(1, dim, s, unit), "sign_uniform": lambda s: kernels.sign_uniform(1, dim, s), "uniform": lambda s: kernels.uniform(1, dim, s)}[kind]

    @F.pandas_udf("array<float>")
    def make(i: pd.Series) -> pd.Series:
        return i.map(lambda x: draw([seed, x])[0].astype(np.float32))

    return spark.range(count).select("id", make("id").alias("vector"))
