"""Binary vector files: packed frames, headered files, fvecs and ivecs, matrices.

Fixed formats, as other tools write them:

* frame: int64 id and ``dim`` float32, big-endian, without padding;
* headered file: the magic CE E5 07 C9, int16 version, int32 dim, 6 bytes of
  padding, then frames;
* fvecs and ivecs: rows of an int32 length and that many float32 or int32,
  little-endian.

Files are decoded on executors, one file to a row of Spark's ``binaryFile``; a
file that ends inside a frame yields its whole frames only.  ``binaryFile``
holds a file in memory, which segments of bounded size respect.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from .files import Files

MAGIC, VERSION, PADDING = bytes.fromhex("CEE507C9"), 1, 6
HEADER = f">4shi{PADDING}x"
BATCH = 10_000


def frame_type(dim: int) -> np.dtype:
    return np.dtype([("id", ">i8"), ("vector", ">f4", (dim,))])


def frame_count(size: int, dim: int) -> int:
    return size // frame_type(dim).itemsize


def frames(data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(data, frame_type(dim), frame_count(len(data), dim))
    return whole["id"].astype(np.int64), whole["vector"].astype(np.float32)


def to_frames(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    out = np.empty(len(ids), frame_type(vectors.shape[1]))
    out["id"], out["vector"] = ids, vectors
    return out.tobytes()


def header(dim: int) -> bytes:
    return struct.pack(HEADER, MAGIC, VERSION, dim)


def read_header(data: bytes) -> tuple[int, int]:
    """Version and dimension; raises if the magic is another."""
    magic, version, dim = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a headered vector file")
    return version, dim


def records(data: bytes, kind: str) -> np.ndarray:
    """Rows of an fvecs (``<f4``) or ivecs (``<i4``) file."""
    if len(data) < 4:
        return np.empty((0, 0), kind)
    n = int(np.frombuffer(data, "<i4", 1)[0])
    rows = np.frombuffer(data, np.dtype([("n", "<i4"), ("x", kind, (n,))]), len(data) // (4 + 4 * n))
    if (rows["n"] != n).any():
        raise ValueError("rows of different lengths")
    return rows["x"]


def to_records(rows: np.ndarray, kind: str) -> bytes:
    out = np.empty(len(rows), np.dtype([("n", "<i4"), ("x", kind, (rows.shape[1],))]))
    out["n"], out["x"] = rows.shape[1], rows
    return out.tobytes()


def _decoded(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[np.ndarray, np.ndarray]], element: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = decode(data)
                for a in range(0, len(ids), BATCH):
                    x = rows[a : a + BATCH]
                    values = kernels.lists(x, pa.float32() if element == "float" else pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(ids[a : a + BATCH]), values], ["file", "id", "vector"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"file string, id bigint, vector array<{element}>")


def read_frames(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """file, id, vector of packed frames."""
    return _decoded(spark, path, lambda data: frames(data, dim), "float")


def read_headered(spark: SparkSession, path: str) -> DataFrame:
    def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        _, dim = read_header(data)
        return frames(data[struct.calcsize(HEADER) :], dim)

    return _decoded(spark, path, decode, "float")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """id is the row's place in its file."""
    return _decoded(spark, path, lambda data: (np.arange(len(rows := records(data, "<f4"))), rows), "float")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, path, lambda data: (np.arange(len(rows := records(data, "<i4"))), rows), "int")


def write_segments(df: DataFrame, path: str, dim: int, headered: bool = False, rows_per_segment: int = 250_000) -> int:
    """Export (id, vector) as numbered segment files, in order of id, to a folder of any store that Spark reaches.

    Tasks build whole segments; the driver holds one at a time and writes it, as Spark has no
    writer of raw bytes.  All vectors must have ``dim`` elements.
    """
    files, head = Files(df.sparkSession), header(dim) * headered
    files.make(path)
    placed = with_ordinals(df.select("id", "vector")).withColumn("segment", F.floor(F.col("ord") / rows_per_segment))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []

        def out() -> pa.RecordBatch:
            body = to_frames(np.concatenate(ids), np.concatenate(rows).astype(np.float32))
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([head + body])], ["segment", "body"])

        for batch in batches:
            segments = batch.column("segment").to_numpy()
            x, at = kernels.matrix(batch.column("vector"), dim)
            if len(at) < batch.num_rows:
                raise ValueError(f"a vector has not {dim} elements")
            own = batch.column("id").to_numpy()
            for s in np.unique(segments):
                if s != now:
                    if ids:
                        yield out()
                    now, ids, rows = int(s), [], []
                ids.append(own[segments == s])
                rows.append(x[segments == s])
        if ids:
            yield out()

    dealt = placed.repartitionByRange("segment").sortWithinPartitions("segment", "ord")
    n = 0
    for r in dealt.select("segment", "id", "vector").mapInArrow(packed, "segment bigint, body binary").toLocalIterator():
        files.write(f"{path}/segment.{r.segment}.vec", bytes(r.body))
        n += 1
    if not n:
        files.write(f"{path}/segment.0.vec", head)
    return max(n, 1)


def in_order(names: list[str]) -> list[str]:
    """Segment names by their number, not by their text."""
    return sorted(names, key=lambda n: ([int(x) for x in re.findall(r"\d+", n)] or [0], n))


def with_ordinals(df: DataFrame) -> DataFrame:
    """ord, id, vector: the position of each row in order of id, for readers that count rows.

    Rows are counted by ranges of ids, so that no task ranks them all.
    """
    low, high, n = df.agg(F.min("id"), F.max("id"), F.count("*")).first()
    if not n:
        return df.select(F.lit(0).cast("bigint").alias("ord"), "id", "vector")
    width = max(1, -(-(high - low + 1) // max(1, n // 100_000)))
    ranged = df.withColumn("_r", F.floor((F.col("id") - low) / width))
    counts = ranged.groupBy("_r").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_r").orderBy("id")) - 1
    return ranged.withColumn("_p", place).join(starts.select("_r", "_start"), "_r").select((F.col("_start") + F.col("_p")).alias("ord"), "id", "vector")


def write_matrix(spark: SparkSession, matrix: np.ndarray, path: str, mode: str = "error") -> None:
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(matrix)]
    spark.createDataFrame(rows, "row int, values array<double>").coalesce(1).write.mode(mode).parquet(path)


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["values"] for r in spark.read.parquet(path).orderBy("row").collect()])
