"""NumPy kernels that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..model import Similarity


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have ``dim`` non-null elements, as doubles, and where they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    good = (lengths == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values
    if values.null_count:
        holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        good &= holes[offsets[1:]] == holes[offsets[:-1]]
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.flatnonzero(good)
    return (flat[offsets[at][:, None] + np.arange(dim)] if len(at) else np.empty((0, dim))), at


def mapped(column: pa.Array, function: Callable[[np.ndarray], np.ndarray], kind: pa.DataType) -> pa.Array:
    """``function`` of the rows of a list column, a matrix at a time: rows of one length go together.

    Null rows stay null; null elements are NaN.
    """
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths, out = np.diff(offsets), [None] * len(column)
    for n in np.unique(lengths[valid]):
        at = np.flatnonzero(valid & (lengths == n))
        made = function(flat[offsets[at][:, None] + np.arange(n)])
        if len(at) == len(column):
            return lists(made, kind)
        for i, row in zip(at, made, strict=True):
            out[i] = row
    return pa.array(out, pa.list_(kind))


def row_function(function: Callable[[np.ndarray], np.ndarray], returns: str):
    """A column function of vectors from one of matrices, by Arrow batches."""
    kind = {"array<double>": pa.float64(), "array<bigint>": pa.int64()}[returns]

    def run(column: pa.Array) -> pa.Array:
        return mapped(column, function, kind)

    return F.arrow_udf(run, returns)


def scores(queries: np.ndarray, rows: np.ndarray, similarity: Similarity) -> np.ndarray:
    """(queries, rows) in double precision; the cosine of a zero vector is NaN."""
    with np.errstate(all="ignore"):
        if similarity is Similarity.EUCLIDEAN:
            square = (queries**2).sum(1)[:, None] + (rows**2).sum(1) - 2 * queries @ rows.T
            return np.sqrt(np.maximum(square, 0))
        dots = queries @ rows.T
        if similarity is Similarity.DOT_PRODUCT:
            return dots
        return dots / np.sqrt((queries**2).sum(1))[:, None] / np.sqrt((rows**2).sum(1))


def passing(s: np.ndarray, similarity: Similarity, threshold: float | None) -> np.ndarray:
    """Not NaN and, inclusively, on the right side of the threshold."""
    good = ~np.isnan(s)
    if threshold is not None:
        good &= s <= threshold if similarity is Similarity.EUCLIDEAN else s >= threshold
    return good


def best(s: np.ndarray, ids: np.ndarray, k: int, similarity: Similarity) -> np.ndarray:
    """Positions of the k best of one query, best first, ties to the smaller id."""
    key = s if similarity is Similarity.EUCLIDEAN else -s
    if len(key) > 4 * k:
        cut = np.partition(key, k - 1)[k - 1]
        some = np.flatnonzero(key <= cut)
        return some[np.lexsort((ids[some], key[some]))[:k]]
    return np.lexsort((ids, key))[:k]


def fwht(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two above one."""
    n = x.shape[-1]
    if n < 2 or n & (n - 1):
        raise ValueError("the length must be a power of two greater than 1")
    out, h = x.astype(np.float64).copy(), 1
    while h < n:
        pairs = out.reshape(*out.shape[:-1], n // (2 * h), 2, h)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], -2).reshape(out.shape)
        h *= 2
    return out


def sign_words(dots: np.ndarray) -> np.ndarray:
    """(rows, bits) dot products as 32-bit words: bit i is set if and only if the i-th product is above 0."""
    rows, bits = dots.shape
    wide = np.zeros((rows, -(-bits // 32) * 32), np.uint8)
    wide[:, :bits] = dots > 0
    return np.packbits(wide.reshape(rows, -1, 32), axis=2, bitorder="little").view("<u4")[..., 0].astype(np.int64)


def gaussian(count: int, dim: int, seed: int, unit: bool = False) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal((count, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x


def sign_uniform(count: int, dim: int, seed: int) -> np.ndarray:
    """Unit vectors of uniform components in [-1, 1)."""
    x = np.random.default_rng(seed).uniform(-1, 1, (count, dim))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def uniform(count: int, dim: int = 768, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).uniform(0, 1, (count, dim))


def lists(x: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    kind = kind or pa.float64()
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(np.ascontiguousarray(x).ravel(), kind))
