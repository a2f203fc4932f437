"""Every row against every query, tile by tile, without a shuffle of pairs.

A table is packed into chunks of rows, written once.  Queries are dealt to blocks,
and a task holds one block while the table's chunks stream past it (a Cartesian
product of chunks, whose tasks read the files themselves).  What a block has found
leaves the task once, at its end, so what is shuffled and written grows with the
rows and not with the pairs; only the arithmetic grows with the pairs.  A task
holds a block, a few chunks and the scores of ``TILE`` pairs.

Few queries travel in the closure instead, and the table is neither packed nor moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..model import Similarity
from ..sources.scratch import shared_path

#: Pairs that are scored at once.
TILE = 1 << 20
#: Rows and bytes of vectors of a chunk or a block, at most.
CHUNK, CHUNK_BYTES = 4096, 1 << 20
#: Chunks of a file: Spark reads a file's binaries by the batch.
FILE = 8
#: Queries of a block, at least, and results that a block holds, at most.
LEAST, HELD = 64, 1 << 19
#: Results held until they are merged, at least.
PENDING = 1 << 16
#: Rows that a query meets in small steps, so that its bound is set early.
EARLY = 1024
#: Of a query matrix that goes to every task.
MOST_BYTES = 16 << 20

FOUND = "query_id bigint, id bigint, score double"
Part = dict[str, np.ndarray]


class Block(Protocol):
    """Queries of a task. ``offer`` takes rows and may yield results, ``finish`` yields the rest."""

    def offer(self, part: Part) -> Iterator[pa.RecordBatch]: ...

    def finish(self) -> Iterator[pa.RecordBatch]: ...


def parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Part]:
    """Columns id, vector, code (binary of one width) and cell, as far as they are there, as arrays; unusable vectors are left out."""
    for batch in batches:
        names = batch.schema.names
        if "vector" in names:
            rows, at = kernels.matrix(batch.column(names.index("vector")), dim)
        else:
            rows, at = None, np.arange(len(batch))
        if not len(at):
            continue
        part = {"id": batch.column(names.index("id")).to_numpy(zero_copy_only=False)[at].astype(np.int64)}
        if rows is not None:
            part["vector"] = rows
        if "code" in names:
            part["code"] = np.frombuffer(b"".join(batch.column(names.index("code")).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
        if "cell" in names:
            part["cell"] = batch.column(names.index("cell")).to_numpy(zero_copy_only=False)[at].astype(np.int32)
        yield part


def _narrow(table: DataFrame) -> str:
    """Floats stay floats on disk; sums are formed in doubles."""
    kind = table.schema["vector"].dataType if "vector" in table.columns else None
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def _packed(table: DataFrame, dim: int, rows: int, prefix: str = "") -> DataFrame:
    """Chunks of at most ``rows`` rows, in the order of their partition: their number in it and the columns as bytes."""
    names, wide = table.columns, _narrow(table)

    def body(part: Part, a: int, b: int) -> list[bytes]:
        return [part[c][a:b].astype(wide).tobytes() if c == "vector" else part[c][a:b].tobytes() for c in names]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0

        def out(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, number
            if not n or n < least:
                return
            part = {c: np.concatenate([p[c] for p in held]) for c in names}
            a = 0
            while n - a >= least and a < n:
                cells = body(part, a, a + rows)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], [f"{prefix}n", *(prefix + c for c in names)])
                number, a = number + 1, a + rows
            held, n = ([{c: x[a:] for c, x in part.items()}], n - a) if a < n else ([], 0)

        for part in parts(batches, dim):
            held.append(part)
            n += len(part["id"])
            yield from out(rows)
        yield from out(1)

    return table.mapInArrow(pack, ", ".join([f"{prefix}n int", *(f"{prefix}{c} binary" for c in names)]))


def _unpacked(values: list[pa.Scalar], names: list[str], dim: int, wide: str) -> Part:
    part = {c: v.as_buffer() for c, v in zip(names, values, strict=True)}
    n = len(part["id"]) // 8
    kinds = {"id": np.int64, "vector": wide, "code": np.uint8, "cell": np.int32}
    out = {c: np.frombuffer(b, kinds[c]) for c, b in part.items()}
    for c in {"vector", "code"} & set(out):
        out[c] = out[c].reshape(n, -1).astype(np.float64 if c == "vector" else np.uint8, copy=False)
    return out


def collected(queries: DataFrame, dim: int) -> Part:
    """Few queries, on the driver."""
    found = list(parts(queries.toArrow().combine_chunks().to_batches(), dim))
    return {c: np.concatenate([p[c] for p in found]) for c in queries.columns} if found else {}


def few(table: DataFrame, queries: Part, make: Callable[[Part], Block], schema: str, dim: int) -> DataFrame:
    """Results of each partition of the table, for queries that travel with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = make(queries) if queries else None
        for part in parts(batches, dim):
            if block is not None:
                yield from block.offer(part)
        if block is not None:
            yield from block.finish()

    return table.mapInArrow(run, schema)


def meet(table: DataFrame, queries: DataFrame, make: Callable[[Part], Block], schema: str, dim: int, n: int, held: int = 1, extra: int = 0) -> DataFrame:
    """Results of blocks of the ``n`` queries against the whole table; a query may hold ``held`` results, a row ``extra`` bytes beside its vector.

    ``table`` is packed in the order of its partitions, and that file is all that is written.
    """
    spark = table.sparkSession
    width = dim * (4 if _narrow(table) == "<f4" else 8) + extra
    rows = max(1, min(CHUNK, CHUNK_BYTES // width))
    of_table, of_queries, wide, q_wide = table.columns, queries.columns, _narrow(table), _narrow(queries)
    chunks, path = _packed(table, dim, rows), shared_path(spark, "chunks")
    chunks.write.option("maxRecordsPerFile", FILE).option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    chunks = spark.read.schema(chunks.schema).parquet(path).coalesce(1)
    most = max(1, min(rows, HELD // held))
    blocks = max(-(-n // most), min(4 * spark.sparkContext.defaultParallelism, -(-n // LEAST)), 1)
    asked = _packed(queries.repartition(blocks), dim, 2 * most, "q_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, Block] = {}
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(len(batch)):
                own = at["q_n"][i].as_py()
                if own not in met:
                    met[own] = make(_unpacked([at[f"q_{c}"][i] for c in of_queries], of_queries, dim, q_wide))
                yield from met[own].offer(_unpacked([at[c][i] for c in of_table], of_table, dim, wide))
        for block in met.values():
            yield from block.finish()

    return chunks.hint("shuffle_replicate_nl").crossJoin(asked).mapInArrow(run, schema)


class Best:
    """The k best rows of each query among those that were offered, best first, ties to the smaller id.

    A matrix product rules rows out, its rounding taken into account; the rest are
    scored pair by pair, so that equal vectors have equal scores wherever they lie.
    """

    def __init__(self, queries: Part, k: int, threshold: float | None, similarity: Similarity):
        self.ids, self.q, self.k, self.similarity, self.threshold = queries["id"], queries["vector"], k, similarity, threshold
        with np.errstate(all="ignore"):
            self.square = (self.q**2).sum(1)
            self.left = self._left()
        n = len(self.ids)
        self.key, self.row, self.value = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.nan)
        most = np.inf
        if threshold is not None:
            most = threshold if similarity is Similarity.EUCLIDEAN else -threshold
        self.bound = np.full(n, most + abs(most) * 1e-12 if np.isfinite(most) else most)
        self.seen = np.zeros(n, np.int64)
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, part: Part) -> Iterator[pa.RecordBatch]:
        yield from ()
        self.among(part, None)

    def among(self, part: Part, at: np.ndarray | None) -> None:
        """Rows for the queries ``at``, all if None."""
        n = len(part["id"])
        at = np.arange(len(self.ids)) if at is None else at
        rows, slack = self._right(part)
        a = 0
        while a < n and len(at):
            seen = int(self.seen[at].min())
            b = n if seen >= EARLY else min(n, a + max(64, seen))
            step = max(1, TILE // (b - a))
            for i in range(0, len(at), step):
                self._tile(part, rows[a:b], slack, a, at[i : i + step])
            if seen < EARLY and self.waiting >= self.k * len(at):
                self._merge()
            self.seen[at] += b - a
            a = b

    def _tile(self, part: Part, rows: np.ndarray, slack: float, start: int, at: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            good = self.left[at] @ rows.T <= self._limit(at, slack)[:, None]
        i, j = np.divmod(np.flatnonzero(good), len(rows))
        if len(i):
            i, j = self._agreeing(part, at[i], j + start)
            for a in range(0, len(i), TILE // 8):
                self._add(part, i[a : a + TILE // 8], j[a : a + TILE // 8])

    # The product of ``left`` and ``_right`` orders rows as keys do; beyond ``_limit``, rounding allowed for, none can count.

    def _left(self) -> np.ndarray:
        if self.similarity is Similarity.COSINE:
            return self.q / -np.sqrt(self.square)[:, None]
        return -self.q if self.similarity is Similarity.DOT_PRODUCT else np.column_stack([-2 * self.q, np.ones(len(self.q))])

    def _right(self, part: Part) -> tuple[np.ndarray, float]:
        rows = part["vector"]
        with np.errstate(all="ignore"):
            square = (rows**2).sum(1)
            largest = np.fmax.reduce(square)
            if self.similarity is Similarity.COSINE:
                return rows / np.sqrt(square)[:, None], 1.0
            if self.similarity is Similarity.DOT_PRODUCT:
                return rows, np.sqrt(largest)
            return np.column_stack([rows, square]), largest

    def _limit(self, at: np.ndarray, slack: float) -> np.ndarray:
        bound, own, eps = self.bound[at], self.square[at], 4 * np.finfo(float).eps * (self.q.shape[1] + 8)
        if self.similarity is Similarity.COSINE:
            limit = bound + eps
        elif self.similarity is Similarity.DOT_PRODUCT:
            limit = bound + eps * np.sqrt(own) * slack
        else:
            limit = np.where(bound < 0, -np.inf, bound * bound * (1 + 1e-12) - own + eps * (own + slack))
        return np.where(np.isnan(limit), np.inf, limit)

    def _agreeing(self, part: Part, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (query, row) that may count."""
        return i, j

    def scores(self, i: np.ndarray, rows: np.ndarray, square: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            if self.similarity is Similarity.EUCLIDEAN:
                return np.sqrt(((rows - self.q[i]) ** 2).sum(1))
            dots = (self.q[i] * rows).sum(1)
            return dots if self.similarity is Similarity.DOT_PRODUCT else dots / np.sqrt(self.square[i]) / np.sqrt(square)

    def _add(self, part: Part, i: np.ndarray, j: np.ndarray) -> None:
        rows = part["vector"][j]
        with np.errstate(all="ignore"):
            s = self.scores(i, rows, (rows**2).sum(1))
        keep = kernels.passing(s, self.similarity, self.threshold)
        s = s[keep]
        self._hold(i[keep], part["id"][j[keep]], s if self.similarity is Similarity.EUCLIDEAN else -s, s)

    def _hold(self, i: np.ndarray, ids: np.ndarray, key: np.ndarray, value: np.ndarray) -> None:
        self.pending.append((i, ids, key, value))
        self.waiting += len(i)
        if self.waiting >= max(PENDING, self.key.size):
            self._merge()

    def _merge(self) -> None:
        if not self.waiting:
            return
        i, ids, key, value = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        self.pending, self.waiting = [], 0
        who, own = np.unique(i, return_inverse=True)
        own = np.concatenate([own, np.repeat(np.arange(len(who)), self.k)])
        ids, key, value = (np.concatenate([new, old[who].ravel()]) for new, old in ((ids, self.row), (key, self.key), (value, self.value)))
        order = np.lexsort((ids, key, own))
        own = own[order]
        rank = np.arange(len(own)) - np.searchsorted(own, np.arange(len(who)))[own]
        first = rank < self.k
        order, to = order[first], (who[own[first]], rank[first])
        self.row[to], self.key[to], self.value[to] = ids[order], key[order], value[order]
        self.bound[who] = np.minimum(self.bound[who], self.key[who, -1])

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        i, j = np.nonzero(~np.isnan(self.value))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.row[i, j]), pa.array(self.value[i, j])], ["query_id", "id", "score"])


def fits(n: int, dim: int, held: int, most_bytes: int = MOST_BYTES) -> bool:
    """Whether ``n`` queries, and ``held`` results of each, are few enough for every task."""
    return n * dim * 8 <= most_bytes and n * held <= 4 * HELD


def best(table: DataFrame, queries: DataFrame, n: int, make: Callable[[Part], Block], dim: int, held: int, most_bytes: int = MOST_BYTES, extra: int = 0) -> DataFrame:
    """query_id, id, score: the best rows of each query, of every partition of the table or, where queries are many, of the table."""
    if fits(n, dim, held, most_bytes):
        return few(table, collected(queries, dim), make, FOUND, dim)
    return meet(table, queries, make, FOUND, dim, n, held, extra)


def in_cell_order(table: DataFrame, n: int, dim: int) -> DataFrame:
    """Rows of a cell beside one another; a cell of very many rows lies in several partitions."""
    rows = max(1, min(CHUNK, CHUNK_BYTES // (8 * dim)))
    return table.repartitionByRange(max(1, -(-n // (FILE * rows))), F.col("cell"), F.col("id")).sortWithinPartitions("cell", "id")
