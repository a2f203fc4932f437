"""The approximate index: cells, product-quantised codes, exact reranking.

Vectors are dealt to about sqrt(n) cells by nearest centroid and coded by product
quantisation of what is left.  A search probes the nearest cells, ranks their codes
by the vectors that they stand for, keeps ``k * oversample`` of them, and scores
those exactly; the threshold holds for exact scores only.

A few queries travel to the codes, and vectors are read for what they keep.  Of many,
a task holds a block while codes and vectors stream past in the order of cells
(``tiles``): what is kept carries its exact score, and only the ``k`` best of a query
leave the task.  Where all that is probed would be kept, codes cut nothing and rows
are ranked by their exact scores at once.

How many cells and codes a search needs depends on the vectors, so a build
measures it: rows chosen by hash are searched exactly, themselves left out, and
the fewest cells and codes that find ``recall`` of their neighbours become the
index's settings.

An index is a folder ``v<millis>`` with the tables ``cells``, ``codebook``,
``codes`` (partitioned by cell) and a manifest.  It is built as a batch job,
made active by replacing a pointer file, and old ones are purged.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..model import DEFAULT_THRESHOLD, DEFAULT_TOP_K, Similarity
from ..sources.scratch import shared_path
from . import tiles
from .cluster import reservoir
from .lsh import rerank
from .search import search_batch, top_k

#: Candidates of all queries that are listed before they are scored, at most.
LISTED = 1 << 18


@dataclass
class AnnParameters:
    """``cells``: sqrt(n) if None, and at most a quarter of the sample, so that each has a few sampled rows.

    ``sample`` bounds what the model is fitted on; larger tables want a larger one (sqrt(n) cells take
    ``4 * sqrt(n)`` sampled rows: the default serves 156 million rows, beyond which cells hold more rows).

    ``probes``: measured if None, and then ``oversample`` is the least; else both are taken as given.
    The measure takes ``tested`` rows as queries, for each k of ``neighbours``; a search for more than
    the last of these probes all cells.
    """

    cells: int | None = None
    subspaces: int = 16
    codes: int = 256
    sample: int = 50_000
    probes: int | None = None
    oversample: int = 8
    seed: int = 1
    recall: float = 0.95
    tested: int = 256
    neighbours: tuple[int, ...] = (DEFAULT_TOP_K, 10 * DEFAULT_TOP_K)


@dataclass
class Setting:
    """What a search for at most ``k`` rows takes, and the recall measured with it."""

    k: int
    probes: int
    keep: int
    recall: float


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from sampled rows; the memory is that of one chunk of distances."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    square, chunk = (c**2).sum(1), max(1, 131_072 // len(c))  # a chunk of distances stays in the cache
    return np.concatenate([np.empty(0, np.int64), *((square - 2 * x[i : i + chunk] @ c.T).argmin(1) for i in range(0, len(x), chunk))])


class Quantizer:
    """Cell centroids and one codebook per subspace. Vectors are scaled to unit length for cosine."""

    def __init__(self, cells: np.ndarray, books: list[np.ndarray], similarity: Similarity):
        self.cells, self.books, self.similarity = cells, books, similarity
        self.dim = cells.shape[1]
        self.bounds = np.linspace(0, self.dim, len(books) + 1).astype(int)

    @classmethod
    def fit(cls, x: np.ndarray, cells: np.ndarray, parameters: AnnParameters, similarity: Similarity) -> Quantizer:
        rest = x - cells[_nearest(x, cells)]
        m = min(parameters.subspaces, x.shape[1])
        bounds = np.linspace(0, x.shape[1], m + 1).astype(int)
        rng = np.random.default_rng(parameters.seed)
        return cls(cells, [_kmeans(rest[:, a:b], parameters.codes, rng) for a, b in zip(bounds, bounds[1:], strict=False)], similarity)

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return prepared(x, self.similarity)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.cells)
        rest = x - self.cells[cell]
        codes = [_nearest(rest[:, a:b], book) for a, b, book in zip(self.bounds, self.bounds[1:], self.books, strict=False)]
        return cell, np.stack(codes, 1).astype(self.wide())

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n best cells of each query."""
        key = (self.cells**2).sum(1) - 2 * q @ self.cells.T if self.similarity is Similarity.EUCLIDEAN else -(q @ self.cells.T)
        return np.argsort(key, axis=1, kind="stable")[:, :n]

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that a cell's codes stand for."""
        return self.cells[cell] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)

    def wide(self) -> type:
        return np.uint8 if max(map(len, self.books)) <= 256 else np.uint16


def prepared(x: np.ndarray, similarity: Similarity) -> np.ndarray:
    if similarity is not Similarity.COSINE:
        return x
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _usable(table: DataFrame, dim: int) -> DataFrame:
    return table.where((F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull()))


def train(table: DataFrame, dim: int, parameters: AnnParameters, similarity: Similarity) -> Quantizer:
    n = table.count()
    if not n:
        raise ValueError("an index needs rows")
    some = reservoir(_usable(table, dim), parameters.sample, parameters.seed)
    rows, _ = kernels.matrix(some.select("vector").toArrow().column(0), dim)
    x = prepared(rows[np.isfinite(rows).all(1)], similarity)
    k = max(1, min(parameters.cells or round(math.sqrt(n)), -(-len(x) // 4)))  # a few sampled rows for each cell
    return Quantizer.fit(x, _kmeans(x, k, np.random.default_rng(parameters.seed)), parameters, similarity)


def encode(table: DataFrame, quantizer: Quantizer) -> DataFrame:
    """id, cell, code of every row with a usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = kernels.matrix(batch.column(1), quantizer.dim)
            good = np.isfinite(rows).all(1)
            cell, codes = quantizer.encode(quantizer.prepared(rows[good]))
            ids = batch.column(0).to_numpy()[at[good]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell.astype(np.int32))], ["id", "code", "cell"])

    return table.select("id", "vector").mapInArrow(run, "id bigint, code binary, cell int")


class Cells(tiles.Best):
    """The best rows of each query in the cells that it probes, by exact score."""

    def __init__(self, queries: tiles.Part, k: int, threshold: float | None, quantizer: Quantizer, probes: int):
        super().__init__(queries, k, threshold, quantizer.similarity)
        self.quantizer, self.near = quantizer, quantizer.prepared(self.q)
        self.probed = np.zeros((len(quantizer.cells), len(self.ids)), bool)
        for a in range(0, len(self.ids), 512):
            found = quantizer.probes(self.near[a : a + 512], probes)
            self.probed[found.ravel(), np.repeat(np.arange(a, a + len(found)), found.shape[1])] = True

    def offer(self, part: tiles.Part) -> Iterator[pa.RecordBatch]:
        yield from ()
        order = np.argsort(part["cell"], kind="stable")
        cells, starts = np.unique(part["cell"][order], return_index=True)
        for cell, at in zip(cells, np.split(order, starts[1:]), strict=True):
            self.among({c: x[at] for c, x in part.items()}, np.flatnonzero(self.probed[cell]))


class Coded(Cells):
    """The best of each query's ``keep`` rows of best codes; ``listed``: all of these, without vectors, scored by their codes, higher is better."""

    def __init__(self, queries: tiles.Part, k: int, keep: int, threshold: float | None, quantizer: Quantizer, probes: int, listed: bool = False):
        super().__init__(queries, keep, None, quantizer, probes)
        self.most, self.least, self.listed = k, threshold, listed
        self.euclidean = self.similarity is Similarity.EUCLIDEAN
        self.left = np.column_stack([-2 * self.near, np.ones(len(self.near))]) if self.euclidean else -self.near

    def _right(self, part: tiles.Part) -> tuple[np.ndarray, float]:
        rows = self.quantizer.decode(int(part["cell"][0]), part["code"].view(self.quantizer.wide()))
        return (np.column_stack([rows, (rows**2).sum(1)]) if self.euclidean else rows), 0.0

    def _tile(self, part: tiles.Part, rows: np.ndarray, slack: float, start: int, at: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            key = self.left[at] @ rows.T
            good = np.flatnonzero(key <= self.bound[at][:, None])
        for a in range(0, len(good), tiles.TILE // 8):
            some = good[a : a + tiles.TILE // 8]
            i, j = np.divmod(some, len(rows))
            i, j, value = at[i], j + start, key.ravel()[some]
            score = -value
            if not self.listed:
                x = part["vector"][j]
                with np.errstate(all="ignore"):
                    score = self.scores(i, x, (x**2).sum(1))
            self._hold(i, part["id"][j], value, score)

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        if not self.listed:
            sign = 1 if self.euclidean else -1
            key = np.where(kernels.passing(self.value, self.similarity, self.least), sign * self.value, np.nan)
            first = np.lexsort((self.row, key), axis=-1)[:, : self.most]
            self.row, self.value = np.take_along_axis(self.row, first, 1), sign * np.take_along_axis(key, first, 1)
        yield from super().finish()


def probe(codes: DataFrame, quantizer: Quantizer, queries: DataFrame, probes: int, keep: int) -> DataFrame:
    """query_id, id: the ``keep`` best rows of the probed cells by approximate score, for a few queries."""
    dim, similarity = quantizer.dim, Similarity.DOT_PRODUCT
    few = tiles.collected(queries.select("id", "vector"), dim)

    def make(part: tiles.Part) -> Coded:
        return Coded(part, keep, keep, None, quantizer, probes, listed=True)

    rough = tiles.few(codes.select("id", "cell", "code"), few, make, tiles.FOUND, dim)
    return top_k(rough, keep, similarity, by=("query_id",)).select("query_id", "id")


def calibrate(table: DataFrame, codes: DataFrame, quantizer: Quantizer, parameters: AnnParameters) -> list[Setting]:
    """The fewest cells and codes, for each k of ``neighbours``, that find ``recall`` of the exact neighbours.

    Half of the loss is left to the cells, the rest to the cut by approximate score.
    The driver holds ``tested`` queries and their neighbours.
    """
    spark, every = table.sparkSession, len(quantizer.cells)
    chosen = reservoir(_usable(table, quantizer.dim), parameters.tested, parameters.seed + 1).select("id", "vector").collect()
    queries = spark.createDataFrame([(r.id, [float(x) for x in r.vector]) for r in chosen], "id bigint, vector array<double>")
    exact = search_batch(table, queries, max(parameters.neighbours) + 1, None, quantizer.similarity, quantizer.dim).where("query_id <> id")
    near = exact.join(codes.select("id", "cell"), "id").select("query_id", "id", "cell", "rank").orderBy("query_id", "rank").collect()
    order = quantizer.probes(quantizer.prepared(np.array([r.vector for r in chosen], float).reshape(-1, quantizer.dim)), every)
    place = {r.id: np.argsort(o) for r, o in zip(chosen, order, strict=True)}
    rows = codes.count()
    out = []
    for k in sorted(parameters.neighbours):
        of_query: dict[int, list] = {}
        for r in near:
            of_query.setdefault(r.query_id, []).append(r)
        true = [r for found in of_query.values() for r in found[:k]]
        if not true:
            out.append(Setting(k, every, k * parameters.oversample, 1.0))
            continue
        reached = np.sort([place[r.query_id][r.cell] for r in true])
        probes = int(reached[math.ceil((1 + parameters.recall) / 2 * len(true)) - 1]) + 1
        pairs = F.broadcast(spark.createDataFrame([(r.query_id, r.id) for r in true], "query_id bigint, id bigint"))
        keep = k * parameters.oversample
        while (recall := probe(codes, quantizer, queries, probes, keep).join(pairs, ["query_id", "id"]).count() / len(true)) < parameters.recall and keep < rows:
            keep *= 2
        out.append(Setting(k, probes, keep, round(recall, 4)))
    return out


class AnnIndex:
    """A built index."""

    def __init__(self, quantizer: Quantizer, codes: DataFrame, parameters: AnnParameters, last_id: int, version: int = 0, settings: list[Setting] | None = None):
        self.quantizer, self.codes, self.parameters, self.last_id, self.version = quantizer, codes, parameters, last_id, version
        self.settings = settings or []

    @classmethod
    def build(cls, table: DataFrame, dim: int, parameters: AnnParameters | None = None, similarity: Similarity = Similarity.COSINE, version: int = 0) -> AnnIndex:
        parameters = parameters or AnnParameters()
        last = table.agg(F.max("id")).first()[0]
        frozen = table.where(F.col("id") <= last) if last is not None else table
        quantizer = train(frozen, dim, parameters, similarity)
        codes = encode(frozen, quantizer)
        path = shared_path(table.sparkSession, "codes")  # coded once, for shares, searches and measures
        codes.write.parquet(path)
        codes = table.sparkSession.read.schema(codes.schema).parquet(path)
        if parameters.probes is not None:
            return cls(quantizer, codes, parameters, last, version)
        return cls(quantizer, codes, parameters, last, version, calibrate(frozen, codes, quantizer, parameters))

    def save(self, path: str) -> None:
        spark, q = self.codes.sparkSession, self.quantizer
        cells = [(i, [float(x) for x in c]) for i, c in enumerate(q.cells)]
        spark.createDataFrame(cells, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
        books = [(j, i, [float(x) for x in c]) for j, b in enumerate(q.books) for i, c in enumerate(b)]
        spark.createDataFrame(books, "subspace int, code int, centroid array<double>").coalesce(1).write.parquet(f"{path}/codebook")
        self.codes.repartition("cell").write.partitionBy("cell").parquet(f"{path}/codes")
        manifest = {"similarity": q.similarity.value, "last_vector_id": self.last_id, "version": self.version, "parameters": asdict(self.parameters), "settings": [asdict(s) for s in self.settings]}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AnnIndex:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        cells = np.array([r.centroid for r in spark.read.parquet(f"{path}/cells").orderBy("cell").collect()])
        rows = spark.read.parquet(f"{path}/codebook").orderBy("subspace", "code").collect()
        books = [np.array([r.centroid for r in rows if r.subspace == j]) for j in range(max(r.subspace for r in rows) + 1)]
        quantizer = Quantizer(cells, books, Similarity.parse(manifest["similarity"]))
        return cls(quantizer, spark.read.parquet(f"{path}/codes"), AnnParameters(**manifest["parameters"]), manifest["last_vector_id"], manifest["version"], [Setting(**s) for s in manifest.get("settings", [])])

    def reach(self, k: int) -> tuple[int, int]:
        """Cells that a search for k rows probes and codes that it keeps."""
        p, every = self.parameters, len(self.quantizer.cells)
        if p.probes is not None:
            return min(p.probes, every), k * p.oversample
        for s in self.settings:
            if k <= s.k:
                return min(s.probes, every), s.keep
        last = self.settings[-1]
        return every, -(-k * last.keep // last.k)

    def search(self, table: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, threshold: float | None = DEFAULT_THRESHOLD, probes: int | None = None, listed: int = LISTED) -> DataFrame:
        """query_id, id, score, rank; scores are exact. ``listed``: candidates that are listed before they are scored, at most."""
        own, keep = self.reach(k)
        quantizer, dim = self.quantizer, self.quantizer.dim
        probes, n, held = min(probes or own, len(quantizer.cells)), queries.count(), self.codes.count()
        if keep < held and n * keep <= listed and tiles.fits(n, dim, keep):
            return rerank(probe(self.codes, quantizer, queries, probes, keep), queries, table, k, threshold, quantizer.similarity)
        rows, queries = self.codes.join(table.select("id", "vector"), "id"), queries.select("id", "vector")
        if keep >= held:
            rows = rows.select("id", "cell", "vector")
            if not tiles.fits(n, dim, k):
                rows = tiles.in_cell_order(rows, held, dim)
            found = tiles.best(rows, queries, n, lambda part: Cells(part, k, threshold, quantizer, probes), dim, k)
        else:
            rows = tiles.in_cell_order(rows.select("id", "cell", "code", "vector"), held, dim)
            found = tiles.meet(rows, queries, lambda part: Coded(part, k, keep, threshold, quantizer, probes), tiles.FOUND, dim, n, keep, len(quantizer.books) * 2)
        return top_k(found, k, quantizer.similarity, by=("query_id",))
