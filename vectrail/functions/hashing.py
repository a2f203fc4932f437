"""Hash functions: 64-bit xxHash with seed 0, and hashes of vector contents."""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class HashFunction(Protocol):
    def hash(self, data: bytes) -> int: ...


class XXHash:
    """Signed 64-bit xxHash; Spark's own ``xxhash64`` has seed 42."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def hash(self, data: bytes | str) -> int:
        raw = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data
        v = xxhash.xxh64_intdigest(raw, seed=self.seed)
        return v - (1 << 64) if v >> 63 else v


def hashed(column, function: HashFunction) -> Column:
    """Of a string's UTF-8 or of a binary column."""

    def run(s: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function.hash(x) for x in s.to_pylist()], pa.int64())

    return F.arrow_udf(run, "bigint")((F.col(column) if isinstance(column, str) else column).cast("binary"))


def xxh64_seed0(column) -> Column:
    return hashed(column, XXHash(0))


def duplicates(df: DataFrame, vector: str = "vector", id_: str = "id") -> DataFrame:
    """Vectors that several rows hold, by content: the vector's smallest id and the number of rows."""
    return df.groupBy(vector).agg(F.min(id_).alias("first_id"), F.count("*").alias("rows")).where("rows > 1")
