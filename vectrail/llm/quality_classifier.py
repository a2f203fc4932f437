"""Operator 1: a quality classifier learnt from trusted positives and unlabelled web text.

Positive-unlabelled learning with the non-negative unbiased risk: with class
prior ``pi``, loss ``l``, trusted positives P and unlabelled text U,

    R = pi * mean_P l(+) + max(0, mean_U l(-) - pi * mean_P l(-)).

Where the second term falls below zero, a step ascends it instead, which keeps a
flexible model from fitting the positives alone.  Labelled negatives are never
used.  The prior is estimated from scores of a positive-versus-unlabelled model:
the share of U above a threshold over the share of P above it, at the threshold
where an upper bound of that ratio is least.

A text becomes a few dozen statistics (characters, words, lines, repeats), read
from the whole text.  A bounded hash-ordered sample of distinct rows
(``most_positive``, ``most_unlabelled``) fits the model on the driver, and one
pass scores every row; nothing but small keys is written in between.

Defined results: null and empty texts have a score like any text whose
statistics are zero; null ids are scored and never learnt from; rows that repeat
id and text are learnt from once; rows of ``labels`` without a document, with a
null label or repeated are harmless; without any trusted positive every score is
the prior 0.5; extra columns are ignored; very long texts are read whole, and
ties of the sample's hash go by the row's own hash; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, learnable, rows_of, sampled, scored
from .quality_rules import repeated_words

NAMES = (
    "log_words", "word_length", "word_length_sd", "upper", "digit", "space", "symbol", "exclaim", "comma", "stop", "other_mark", "pipe", "bracket", "non_ascii", "control",
    "lines", "line_words", "dup_lines", "short_lines", "ended_lines", "distinct_words", "top_word", "repeat_words", "capital_words", "upper_words", "marked_words", "long_words", "sentences", "urls", "first_line", "stuttered",
)
_URL = re.compile(rb"https?:|www\.")


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(raw)
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    per_line = [len(x.split()) for x in lines]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    some = lambda chars: float(codes[list(chars)].sum())
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    return [
        np.log1p(n), lengths.mean(), lengths.std(), some(range(65, 91)), some(range(48, 58)), some(b" \t\n"), some(b"#*$%&~^+=_@"), some(b"!?"), some(b","), some(b"."),
        some(b";:'\"-"), some(b"|"), some(b"()[]{}<>/\\"), float(codes[128:].sum()), float(codes[:9].sum() + codes[14:32].sum()),
        np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(k < 4 for k in per_line) / len(lines), ends / len(lines),
        len(counts) / n, max(counts.values()) / n, repeated_words(words) / n, sum(w[:1].isupper() for w in words) / n, sum(len(w) > 1 and w.isupper() for w in words) / n,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n, float((lengths > 20).mean()), np.log1p(some(b".!?") * size / n), np.log1p(len(_URL.findall(raw))), np.log1p(per_line[0]),
        sum(map(bytes.__eq__, words, words[1:])) / n,
    ]


class Basis:
    """Statistics as hinges at quantiles of the rows that fit it, so that a linear model bends."""

    def __init__(self, x: np.ndarray, bends: int = 6):
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        self.knots = np.quantile((x - self.mean) / self.sd, np.linspace(0.02, 0.98, bends), axis=0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, *(np.maximum(z - k, 0) for k in self.knots)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = 300, rate: float = 0.03, l2: float = 1e-3) -> np.ndarray:
    """Weights of a linear score. With ``prior``: the non-negative unbiased risk; without: P against U."""
    p, u = p.astype(np.float32), u.astype(np.float32)
    w = np.zeros(p.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        fp, fu = _sigmoid(p @ w), _sigmoid(u @ w)
        if prior is None:
            g = -p.T @ (1 - fp) / len(p) + u.T @ fu / len(u)
        else:
            positive = -prior * (p.T @ (1 - fp)) / len(p)
            negative = u.T @ fu / len(u) - prior * (p.T @ fp) / len(p)
            risk = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
            g = positive + negative if risk >= 0 else -negative
        g = g + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float64)


def estimate_prior(p: np.ndarray, u: np.ndarray, certainty: float = 0.1) -> float:
    """Share of positives in U, from scores of P and U that did not fit the model."""
    cuts = np.unique(np.quantile(np.concatenate([p, u]), np.linspace(0, 0.99, 200)))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    slack = np.sqrt(np.log(4 / certainty) / 2)
    qp, qu = above(p), above(u)
    usable = qp > 0.05
    if not usable.any():
        return 1.0
    bound = (qu + slack / np.sqrt(len(u))) / np.maximum(qp - slack / np.sqrt(len(p)), 1e-3)
    k = np.flatnonzero(usable)[np.argmin(bound[usable])]
    return float(np.clip(qu[k] / qp[k], 0.01, 0.99))


class PUClassifier:
    def __init__(self, p: np.ndarray, u: np.ndarray, prior: float | None = None):
        self.basis = Basis(np.concatenate([p, u]))
        bp, bu = self.basis(p), self.basis(u)
        if prior is None:
            half = fit(bp[::2], bu[::2], None)
            prior = estimate_prior(bp[1::2] @ half, bu[1::2] @ half)
        self.prior = prior
        self.weights = fit(bp, bu, prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.basis(x) @ self.weights)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most_positive: int = 6_000, most_unlabelled: int = 12_000, prior: float | None = None) -> PUClassifier | None:
    """The model, or None without two positives and two unlabelled rows."""
    spark = docs.sparkSession
    bound_batches(spark)
    keys = learnable(docs)
    trusted = labels.where(F.col(label) == 1).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    positive = sampled(keys.join(trusted, "doc_id", "left_semi"), most_positive, 1)
    unlabelled = sampled(keys, most_unlabelled, 2)
    discard(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float32).reshape(-1, len(NAMES))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("kind"), lists], ["h", "kind", "x"])

    rows = [(*r, kind) for kind, some in enumerate((unlabelled, positive)) for r in some]
    if len(unlabelled) < 2 or len(positive) < 2:
        return None
    chosen = spark.createDataFrame(rows, "doc_id bigint, h bigint, kind int")  # at most most_positive + most_unlabelled rows
    got = rows_of(docs, chosen).mapInArrow(run, "h bigint, kind int, x array<float>").toArrow().sort_by([("kind", "ascending"), ("h", "ascending")])
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)).astype(np.float64)
    kind = got.column("kind").to_numpy()
    p, u = x[kind == 1], x[kind == 0]
    return PUClassifier(p, u, prior) if len(p) >= 2 and len(u) >= 2 else None


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", most_positive: int = 6_000, most_unlabelled: int = 12_000, cut: float = 0.3, prior: float | None = None, carry: bool = False
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; ``carry`` adds the row itself as the struct ``doc``."""
    model = fit_quality(docs, labels, label, most_positive, most_unlabelled, prior)

    def make():
        if model is None:
            return lambda texts: np.full(len(texts), 0.5)
        return lambda texts: model.score(np.array([statistics(t) for t in texts], np.float32).reshape(-1, len(NAMES)).astype(np.float64))

    return scored(docs, make, cut, carry)
