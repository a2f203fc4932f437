"""Rows from Python: nothing, one row, or an iterator."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

INPUT = "vector array<float>, rid string, extra string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INPUT)


def single(spark: SparkSession, vector, rid: str, extra: str | None = None) -> DataFrame:
    return spark.createDataFrame([([float(x) for x in vector], rid, extra)], INPUT)


def from_iterator(spark: SparkSession, rows: Iterable[tuple], batch: int = 10_000) -> Iterable[DataFrame]:
    """(vector, rid, extra) tuples, a DataFrame for each batch."""
    it = iter(rows)
    while part := list(islice(it, batch)):
        yield spark.createDataFrame([([float(x) for x in v], r, e) for v, r, e in part], INPUT)
