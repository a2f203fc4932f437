"""Operator 4: maximum inner product search by score-aware (anisotropic) quantisation.

Vectors are product-quantised with sixteen centroids per subspace, so a code is
four bits.  Codebooks and codes minimise an anisotropic loss: the residual's part
parallel to the vector, which is what changes large inner products, weighs ``eta``
times its orthogonal part, with ``eta = (d - 1) t^2 / (1 - t^2)`` for the score
threshold ``t``.  As the parallel part is a sum over subspaces, codes are found
by coordinate descent, and centroids by weighted least squares.

Codebooks are fitted on a bounded sample (``sample`` distinct rows in hash order);
every vector is coded and stored in the index.  A search meets blocks of the index
with chunks of queries: table scans over pairs of codes pick ``rerank`` candidates
of every ``UNIT`` rows of a block, which are scored exactly, in double precision, on
the original vectors; the best ``k`` ids of a block go on to a merge by query.
Equal vectors of a block are scanned once and stand for their ``k + 1`` smallest
ids, as no more of them can be among a query's ``k`` nearest.

Nothing is broadcast but codebooks (16 x d floats).  A task holds one block, of at
most ``BLOCK`` rows, while ``CHUNKS_PER_TASK`` chunks of queries stream past it: every
query meets every row, so the work grows with queries times rows, but what is
shuffled for it is a block and its chunks for minutes of scanning.

Defined results: null, zero and non-finite vectors, null ids, and vectors whose
length is not the most frequent one take no part; ties go to the smaller id; a
query never finds a row with its own id; repeated (id, vector) rows count once; an
id that has several vectors, as a query or as a candidate, has the largest inner
product of any of them and is found once; fewer than ``k`` candidates give fewer
rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tasks, thinned, written

CENTROIDS = 16
#: Rows that ``rerank`` candidates are for; rows of a block, at most; queries of a chunk, and those scanned at once; chunks that pass a block in a task.
UNIT, BLOCK, CHUNK, SCAN, CHUNKS_PER_TASK = 4096, 65_536, 512, 64, 128


class Codebook:
    """Centroids of ``subspaces`` two-dimensional (by default) parts of a vector."""

    def __init__(self, x: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 6, seed: int = 4):
        n, d = x.shape
        self.d, self.width = d, width
        self.parts = -(-d // width) + (-(-d // width) % 2)  # an even number: codes are read in pairs
        self.eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        z, rng = self._split(x), np.random.default_rng(seed)
        self.centres = np.stack([self._kmeans(z[:, m], rng) for m in range(self.parts)])
        for _ in range(rounds):
            codes = self.encode(x, passes=1)
            self._refit(z, codes)

    def _split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.parts * self.width), np.float64)
        wide[:, : self.d] = x
        return wide.reshape(len(x), self.parts, self.width)

    @staticmethod
    def _kmeans(z: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
        c = z[rng.choice(len(z), CENTROIDS, replace=len(z) < CENTROIDS)]
        for _ in range(rounds):
            own = ((z[:, None] - c) ** 2).sum(2).argmin(1)
            for k in range(CENTROIDS):
                if (own == k).any():
                    c[k] = z[own == k].mean(0)
        return c

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes (rows, parts) by coordinate descent on the anisotropic loss."""
        z = self._split(x)
        unit = z / np.maximum(np.sqrt((z * z).sum((1, 2), keepdims=True)), 1e-30)
        codes = np.stack([((z[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1) for m in range(self.parts)], 1).astype(np.uint8)
        along = np.stack([((z[:, m] - self.centres[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(self.parts)], 1)
        total = along.sum(1)
        for _ in range(passes):
            for m in range(self.parts):
                rest = total - along[:, m]
                residual = z[:, m, None] - self.centres[m]
                parallel = (residual * unit[:, m, None]).sum(2)
                codes[:, m] = ((residual**2).sum(2) + (self.eta - 1) * (rest[:, None] + parallel) ** 2).argmin(1)
                along[:, m] = np.take_along_axis(parallel, codes[:, m, None].astype(np.int64), 1)[:, 0]
                total = rest + along[:, m]
        return codes

    def _refit(self, z: np.ndarray, codes: np.ndarray) -> None:
        unit = z / np.maximum(np.sqrt((z * z).sum((1, 2), keepdims=True)), 1e-30)
        along = np.stack([((z[:, m] - self.centres[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(self.parts)], 1)
        for m in range(self.parts):
            rest = along.sum(1) - along[:, m]
            for k in range(CENTROIDS):
                own = codes[:, m] == k
                if own.any():
                    u, v = unit[own, m], z[own, m]
                    a = own.sum() * np.eye(self.width) + (self.eta - 1) * u.T @ u
                    b = v.sum(0) + (self.eta - 1) * ((rest[own] + (u * v).sum(1))[:, None] * u).sum(0)
                    self.centres[m, k] = np.linalg.solve(a, b)
            along[:, m] = ((z[:, m] - self.centres[m][codes[:, m]]) * unit[:, m]).sum(1)

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, rows), read from one table of 256 sums per pair of codes."""
        tables = np.einsum("qmw,mkw->qmk", self._split(queries), self.centres).astype(np.float32)
        pairs = tables[:, 0::2, None, :] + tables[:, 1::2, :, None]  # low nibble last
        pairs = pairs.reshape(len(queries), self.parts // 2, 256)
        out = np.empty((len(queries), len(packed)), np.float32)
        columns = [np.ascontiguousarray(packed[:, j]) for j in range(self.parts // 2)]
        for q in range(len(queries)):
            row = pairs[q, 0].take(columns[0])
            for j in range(1, len(columns)):
                row += pairs[q, j].take(columns[j])
            out[q] = row
        return out


def usable(vector: str) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame, sample: int = 8192, threshold: float = 0.2) -> tuple[DataFrame, Codebook | None, int]:
    """(id, vector, code) of every usable row as a written table, its codebook, and the number of blocks."""
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & usable("vector"))
    dims = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return rows.withColumn("code", F.lit(None).cast("binary")), None, 0
    rows = rows.where(F.size("vector") == dims.d)
    some = thinned(rows.withColumn("h", F.xxhash64("id", "vector")), sample, 4).select("vector").toArrow().column(0).combine_chunks()
    book = Codebook(some.flatten().to_numpy().reshape(len(some), -1).astype(np.float64), threshold=threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                code = book.packed(book.encode(x))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary())], ["id", "vector", "code"])

    index = written(rows.mapInArrow(run, "id bigint, vector array<float>, code binary"), "ann-index")
    return index, book, max(-(-dims.n // BLOCK), min(tasks(vectors.sparkSession), -(-dims.n // UNIT)))


def search(index: DataFrame, book: Codebook | None, blocks: int, queries: DataFrame, k: int = 20, rerank: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows of the index by inner product.

    ``queries``: (id, vector) rows, usable and of the index's length.
    """
    spark, answer = index.sparkSession, "query_id bigint, rank int, vec_id bigint, score double"
    if book is None:
        return spark.createDataFrame([], answer)
    d = book.d

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = np.empty(0, np.int64), np.empty((0, d), np.float32)

        def out(n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ids[:n].tobytes()]), pa.array([held[:n].tobytes()]), pa.array([b""])], ["ids", "vectors", "codes"])

        for batch in batches:
            if batch.num_rows:
                ids = np.concatenate([ids, batch.column(0).to_numpy()])
                held = np.concatenate([held, batch.column(1).flatten().to_numpy().reshape(-1, d).astype(np.float32)])
                while len(ids) >= CHUNK:
                    yield out(CHUNK)
                    ids, held = ids[CHUNK:], held[CHUNK:]
        if len(ids):
            yield out(len(ids))

    groups = max(1, -(-queries.count() // (CHUNK * CHUNKS_PER_TASK)))
    packed = queries.select("id", "vector").mapInArrow(chunked, "ids binary, vectors binary, codes binary")
    packed = packed.withColumn("grp", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rows_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().astype(np.float32).reshape(batch.num_rows, -1)
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            block = batch.column(0).to_numpy()
            out = []
            for b in np.unique(block):
                own = block == b
                out.append((int(b), ids[own].tobytes(), x[own].tobytes(), codes[own].tobytes()))
            if out:
                b, i, v, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(i, pa.binary()), pa.array(v, pa.binary()), pa.array(c, pa.binary())], ["block", "ids", "vectors", "codes"])

    dealt = index.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector", "code")
    data = dealt.mapInArrow(rows_packed, "block int, ids binary, vectors binary, codes binary").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    names = ["grp", "block", "kind", "ids", "vectors", "codes"]
    both = data.withColumn("kind", F.lit(0)).select(names).unionByName(packed.withColumn("kind", F.lit(1)).select(names))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            for grp, b, kind, ids, vectors, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, b) != now:
                    now, parts, block = (grp, b), [], None
                if kind == 0:
                    parts.append((ids, vectors, codes))
                    continue
                if not parts:
                    continue
                if block is None:
                    block = _Block(*(b"".join(p) for p in zip(*parts, strict=True)), d, k)
                q, i = np.frombuffer(vectors, np.float32).reshape(-1, d), np.frombuffer(ids, np.int64)
                for at in range(0, len(i), SCAN):
                    yield block.nearest(book, i[at : at + SCAN], q[at : at + SCAN], k, rerank)

    # A fixed task for each (group, block): enough partitions that none holds many.
    found = both.repartition(max(blocks * groups, 1), "grp", "block").sortWithinPartitions("grp", "block", "kind").mapInArrow(scan, "query_id bigint, ids binary, scores binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, scores = None, [], []

        def out() -> pa.RecordBatch:
            i, s = best_ids(np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(scores), np.float64), k)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), now)), pa.array(np.arange(1, len(i) + 1, dtype=np.int32)), pa.array(i), pa.array(s)], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            done = []
            for q, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if q != now:
                    if ids:
                        done.append(out())
                    now, ids, scores = q, [], []
                ids.append(i)
                scores.append(s)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if ids:
            yield out()

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, answer)


def best_ids(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best ids, each with its best score, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], scores[first]


class _Block:
    """Distinct vectors of a block with their codes and smallest ids."""

    def __init__(self, ids: bytes, vectors: bytes, codes: bytes, d: int, k: int):
        i = np.frombuffer(ids, np.int64)
        v = np.frombuffer(vectors, np.float32).reshape(-1, d) + np.float32(0)  # no negative zeros
        c = np.frombuffer(codes, np.uint8).reshape(len(i), -1)
        order = np.argsort(i, kind="stable")
        i, v, c = i[order], np.ascontiguousarray(v[order]), c[order]
        _, first, own = np.unique(v.view(np.dtype((np.void, v.itemsize * d))).ravel(), return_index=True, return_inverse=True)
        self.vectors, self.codes = v[first].astype(np.float64), c[first]
        order = np.argsort(own, kind="stable")  # ids ascend within a vector
        starts = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
        ends = np.r_[starts[1:], len(order)]
        self.ids = [np.unique(i[order[a:b]])[: k + 1] for a, b in zip(starts, ends, strict=True)]
        self.single = np.array([x[0] if len(x) == 1 else 0 for x in self.ids])
        self.several = np.array([len(x) > 1 for x in self.ids])

    def nearest(self, book: Codebook, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: int) -> pa.RecordBatch:
        approximate = book.scan(queries, self.codes)
        rows_in = approximate.shape[1]
        r = min(rerank * -(-rows_in // UNIT) + 1, rows_in)
        chosen = np.argpartition(-approximate, r - 1, axis=1)[:, :r] if r < rows_in else np.tile(np.arange(r), (len(queries), 1))
        q64 = queries.astype(np.float64)
        out_ids, out_scores = [], []
        for q in range(len(queries)):
            rows = chosen[q]
            s = (self.vectors[rows] * q64[q]).sum(1)
            if self.several[rows].any():
                ids = np.concatenate([self.ids[x] for x in rows])
                s = np.repeat(s, [len(self.ids[x]) for x in rows])
            else:
                ids = self.single[rows]
            other = ids != query_ids[q]
            i, s = best_ids(ids[other], s[other], k)
            out_ids.append(i.tobytes())
            out_scores.append(s.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(out_ids, pa.binary()), pa.array(out_scores, pa.binary())], ["query_id", "ids", "scores"])
