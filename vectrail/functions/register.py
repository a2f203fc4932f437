"""The functions as SQL: expressions where Catalyst can inline them, Arrow functions otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from . import hashing, kernels, vector

_SUM = "aggregate({}, 0D, (s, x) -> s + x)"
_DOT = _SUM.format("zip_with(a, b, (x, y) -> double(x) * double(y))")
_NORM = "sqrt(" + _SUM.format("transform({}, x -> double(x) * double(x))") + ")"
_TWO = "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE"

EXPRESSIONS = {
    "vec_dot": f"{_TWO} RETURN CASE WHEN size(a) = size(b) THEN {_DOT} END",
    "vec_cosine": f"{_TWO} RETURN CASE WHEN size(a) = size(b) THEN try_divide({_DOT}, {_NORM.format('a')} * {_NORM.format('b')}) END",
    "vec_l2": f"{_TWO} RETURN CASE WHEN size(a) = size(b) THEN sqrt({_SUM.format('zip_with(a, b, (x, y) -> (x - y) * (x - y))')}) END",
    "vec_normalize": f"(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(array(named_struct('v', a, 'n', {_NORM.format('a')})), z -> transform(z.v, x -> coalesce(try_divide(x, z.n), x)))[0]",
    "vec_hamming": "(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)",
}


def register(spark: SparkSession, planes: np.ndarray | None = None) -> None:
    """Make the vec_ functions available to SQL; ``planes`` (bits, dim) defines ``vec_lsh``.

    ``vec_mean_pool`` holds a group's vectors in one task; for large groups use ``vector.mean_vector``.
    """
    for name, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("vec_fwht", vector.fwht_function())

    def xxh64(s: pa.Array) -> pa.Array:
        own = hashing.XXHash(0)
        return pa.array([None if x is None else own.hash(x) for x in s.to_pylist()], pa.int64())

    spark.udf.register("xxh64_seed0", F.arrow_udf(xxh64, "bigint"))

    def pooled(v: pd.Series) -> list[float]:
        rows = [np.asarray(x, np.float64) for x in v if x is not None]
        return np.mean(rows, axis=0).tolist() if rows else None

    spark.udf.register("vec_mean_pool", F.pandas_udf(pooled, "array<double>", PandasUDFType.GROUPED_AGG))
    if planes is not None:
        spark.udf.register("vec_lsh", lsh_function(planes))


def lsh_function(planes: np.ndarray):
    """Signature words of a vector; null for null."""

    return kernels.row_function(lambda rows: kernels.sign_words(rows @ planes.T), "array<bigint>")
