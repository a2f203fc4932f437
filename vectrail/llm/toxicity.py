"""Operator 9: toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A text is cut into windows of a few words; each window is compressed with either
dictionary, and the bytes that the toxic one saves are the window's distance.
How many windows reach each of several thresholds, calibrated on labelled
documents, gives the document's score.

The ordinary dictionary comes from zstandard's trainer, on windows of ordinary
documents.  Toxic text is mostly ordinary language too, and that trainer would
learn just this from it.  So the toxic dictionary holds the beginnings of words
that are characteristic of toxic documents (a likelihood-ratio test over documents
of either class, copies left out) and toxic words that begin so, behind the
ordinary content.  Between the two
lie the ordinary words that look most like them.  Windows of ordinary language
then compress alike with both dictionaries, and the distance is nearly free of
noise.

Labels are learnt only from rows that are not held out, at most ``most_toxic``
and ``most_ordinary`` of those that the documents have, in hash order.  The
sampled texts hold at most about ``sample_bytes``: beyond that each is thinned to
the same share of its words, in runs spread over the whole text.  Of the sampled
ordinary texts, zstandard's trainer sees at most about ``trainer_bytes``, as it
holds some sixteen times as much: windows spread evenly over all of them.  All
else reads every row and whole texts.

Calibration sees no document through dictionaries that it helped to make: the
sample is halved by hash, each half is measured with dictionaries of the other,
and the final dictionaries, of the whole sample, score the documents.  The three
trainings are tasks of one job.

Defined results: null and empty texts have no windows and get the calibrated
score of none; null ids are scored and never learnt from; null labels and
labels without a document are ignored, and an id labelled both ways counts for
both; rows that repeat id and text are learnt from once; without both classes
every score is 0, and if a half lacks one, the whole sample's dictionaries
measure the other; repeated rows are scored alike; very long texts are scored
whole; ties of the sample's hash go by the row's own hash; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, learnable, rows_of, sampled, scored, tasks, tidy, written

LEVEL = 12
WINDOW = 8
ORDINARY_BYTES, ALIKE_BYTES, TOXIC_BYTES = 100_000, 16_000, 4_096
THRESHOLDS = (1, 2, 3, 4, 5, 6)
EDGES = b".,;:!?\"'()[]{}*&%$#|<>-_"
#: Lengths of the beginnings of words that are tested.
SHORTEST, LONGEST = 4, 12


def words_of(text: str) -> list[bytes]:
    return [w for w in (x.strip(EDGES) for x in text.lower().encode("utf-8", "surrogatepass").split()) if w]


def unlike(texts: list[str]) -> list[str]:
    """Without texts that share one of three min-hashes of four-word windows with an earlier one."""
    seen: set[tuple[int, int]] = set()
    out = []
    for t in texts:
        w = t.lower().encode("utf-8", "surrogatepass").split()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))), np.uint64)
        keys = {(k, int((hashes * np.uint64(m)).min())) for k, m in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))}
        if not keys & seen:
            seen |= keys
            out.append(t)
    return out


def beginnings(words: Iterable[bytes]) -> set[bytes]:
    return {w[:k] for w in words for k in range(min(SHORTEST, len(w)), min(LONGEST, len(w)) + 1)}


def characteristic(toxic: list[tuple[bytes, ...]], ordinary: list[tuple[bytes, ...]], least: int = 4, odds: float = 4.0, evidence: float = 20.0) -> list[bytes]:
    """Beginnings of words that toxic documents hold far more often, the strongest first; arguments: distinct words of each document.

    One gives way to a longer one that nearly all its documents hold, and a longer
    one goes when a shorter one is chosen.
    """
    found = Counter(s for words in toxic for s in beginnings(words))
    found = {s: n for s, n in found.items() if n >= least}
    usual = Counter(s for words in ordinary for s in beginnings(words) if s in found)
    n_toxic, n_ordinary = len(toxic), len(ordinary)
    share = n_toxic / (n_toxic + n_ordinary)
    strength = {}
    for s, x in found.items():
        y, n = usual[s], found[s] + usual[s]
        if (x + 0.5) / (n_toxic + 1) > odds * (y + 0.5) / (n_ordinary + 1):
            g = 2 * (x * math.log(x / (n * share)) + (y * math.log(y / (n * (1 - share))) if y else 0.0))
            if g >= evidence:
                strength[s] = g
    longer = Counter()
    for s in strength:
        longer[s[:-1]] = max(longer[s[:-1]], found[s])
    chosen: list[bytes] = []
    for s in sorted(strength, key=lambda s: (-strength[s], s)):
        if longer[s] < 0.8 * found[s] and not any(s[:k] in chosen for k in range(1, len(s))):
            chosen.append(s)
    return chosen


def trainer_windows(texts: list[str], trainer_bytes: int | None) -> list[bytes]:
    """Windows of the texts, at most about ``trainer_bytes`` in all (None: every window), spread evenly over all texts."""
    share = 1.0
    if trainer_bytes is not None:
        share = min(1.0, trainer_bytes / max(1, sum(len(t.encode("utf-8", "surrogatepass")) for t in texts)))
    out, taken, passed = [], 0, 0
    for t in texts:
        words = t.lower().encode("utf-8", "surrogatepass").split()
        for i in range(0, len(words), WINDOW):
            w = b" " + b" ".join(words[i : i + WINDOW]) + b" "
            passed += len(w) - 1
            if share == 1.0 or taken + len(w) - 1 <= share * passed:
                out.append(w)
                taken += len(w) - 1
    return out


def train_dictionaries(toxic: list[str], ordinary: list[str], trainer_bytes: int | None = 16 << 20) -> tuple[bytes, bytes]:
    """Raw contents of the ordinary and of the toxic dictionary."""
    known: dict[bytes, bytes] = {}
    distinct = lambda t: tuple(known.setdefault(w, w) for w in set(words_of(t)))
    toxic_words, ordinary_words = ([distinct(t) for t in unlike(texts)] for texts in (toxic, ordinary))
    marks = characteristic(toxic_words, ordinary_words)
    marked = set(marks)
    of_mark = lambda w: any(w[:k] in marked for k in range(1, len(w) + 1))
    counts, in_toxic = (Counter(w for words in documents for w in words) for documents in (ordinary_words, toxic_words))
    plain = {w: n for w, n in counts.items() if not of_mark(w)}
    whole = sorted(((n, w) for w, n in in_toxic.items() if n >= 2 and n > 4 * counts[w] and w not in marked and of_mark(w)), reverse=True)
    held, size = [], 0
    for s in [*marks, *(w for _, w in whole)]:
        size += len(s) + 2
        if size > TOXIC_BYTES:
            break
        held.append(s)
    pieces = {s[i : i + 4] for s in marks for i in range(len(s) - 3)}
    alike = sorted((n, w) for w, n in plain.items() if any(w[i : i + 4] in pieces for i in range(len(w) - 3)))
    try:
        base = zstandard.train_dictionary(ORDINARY_BYTES, trainer_windows(ordinary, trainer_bytes)).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: the words that save most
        base = b"  ".join(w for _, w in sorted((n * len(w), w) for w, n in plain.items()))[-ORDINARY_BYTES:]
    base += b" " + b"  ".join(w for _, w in alike)[-ALIKE_BYTES:] + b" "
    return base, b" " + b"  ".join(reversed(held))


class Distance:
    """Bytes that the toxic dictionary saves in each window of a text."""

    def __init__(self, base: bytes, special: bytes, level: int = LEVEL, window: int = WINDOW):
        self.window = window
        self.ordinary, self.toxic = (self._compressor(x, level) for x in (base, base + special))

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def windows(self, text: str | None) -> np.ndarray:
        words, k = (text or "").lower().encode("utf-8", "surrogatepass").split(), self.window
        a, b = self.ordinary.compress, self.toxic.compress
        out = []
        for i in range(0, len(words), k):
            w = b" " + b" ".join(words[i : i + k]) + b" "
            out.append(len(a(w)) - len(b(w)))
        return np.array(out, np.int32)

    def features(self, text: str | None) -> list[float]:
        saved = self.windows(text)
        n = len(saved)
        reach = [int((saved >= t).sum()) for t in THRESHOLDS]
        return [*(math.log1p(1000 * c / max(n, 1)) for c in reach), math.log1p(reach[2]), math.log1p(reach[4]), math.log1p(n)]


class Calibration:
    """Logistic regression on the threshold counts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1e-3):
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-9
        z = self._z(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + l2 * np.eye(z.shape[1])
            self.w -= np.linalg.solve(h, z.T @ (p - y) / len(y) + l2 * self.w)

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.sd, np.ones(len(x))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._z(x) @ self.w, -30, 30)))


def spread(text: str, share: float, runs: int = 20) -> str:
    """About ``share`` of a text's words, in runs spread over all of it."""
    words = text.split()
    each = int(len(words) * share / runs)
    if share >= 1 or not each:
        return text if share >= 1 else " ".join(words[: math.ceil(len(words) * share)])
    starts = [r * (len(words) - each) // (runs - 1) for r in range(runs)]
    return " ".join(w for at in starts for w in words[at : at + each])


@dataclass
class Toxicity:
    """Contents of the two dictionaries, and the calibration of what they save."""

    ordinary: bytes
    toxic: bytes
    calibration: Calibration

    def scorer(self) -> Callable[[list], np.ndarray]:
        features = Distance(self.ordinary, self.toxic).features
        return lambda texts: self.calibration.score(np.array([features(t) for t in texts], np.float64).reshape(-1, len(THRESHOLDS) + 3))


#: The whole sample, and its halves; a training leaves out the half of its number.
WHOLE, HALVES = 2, (0, 1)


def _trained(texts: DataFrame, trainer_bytes: int | None) -> dict[int, tuple[bytes, bytes]]:
    """Dictionaries of the whole sample and of each half's complement, where both classes are there; ``texts``: (text, y, half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[set, set]] = {}
        for batch in batches:
            for text, y, fit in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "fit")), strict=True):
                held.setdefault(fit, (set(), set()))[y].add(text)
        for fit in sorted(held):
            ordinary, toxic = (sorted(x, key=lambda t: xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))) for x in held.pop(fit))
            if toxic and ordinary:
                a, b = train_dictionaries(toxic, ordinary, trainer_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([a]), pa.array([b])], ["fit", "ordinary", "toxic"])

    fits = texts.select("text", "y", F.explode(F.array(F.lit(WHOLE), 1 - F.col("half"))).alias("fit"))
    run = tidy(run)
    return {r.fit: (bytes(r.ordinary), bytes(r.toxic)) for r in fits.repartitionByRange(3, "fit").mapInArrow(run, "fit int, ordinary binary, toxic binary").collect()}


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", most_toxic: int = 3_000, most_ordinary: int = 5_000, sample_bytes: int = 64 << 20, trainer_bytes: int | None = 16 << 20
) -> Toxicity | None:
    """The model, or None without documents of both classes."""
    spark = docs.sparkSession
    bound_batches(spark)
    keys, chosen = learnable(docs), []
    for y, most in ((1, most_toxic), (0, most_ordinary)):
        marked = labels.where(F.col(label) == y).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
        chosen += [(*r, y) for r in sampled(keys.join(marked, "doc_id", "left_semi"), most, y)]
    discard(keys)
    if len({y for _, _, y in chosen}) < 2:
        return None
    # At most most_toxic + most_ordinary rows.
    some = rows_of(docs, spark.createDataFrame(chosen, "doc_id bigint, h bigint, y int"))
    some = written(some.select(F.coalesce("text", F.lit("")).alias("text"), "y", F.pmod(F.xxhash64("h"), F.lit(2)).cast("int").alias("half")), "toxicity-sample")
    share = min(1.0, sample_bytes / max(1, some.agg(F.sum(F.octet_length("text"))).first()[0]))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spread(t, share) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], ["text", "y", "half"])

    dictionaries = _trained(some if share == 1 else some.mapInArrow(thin, "text string, y int, half int"), trainer_bytes)
    whole = dictionaries[WHOLE]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_half = {half: Distance(*dictionaries.get(half, whole)) for half in HALVES}
        for batch in batches:
            x = [by_half[half].features(t) for t, half in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    learn = sorted((r.y, r.x) for r in some.repartition(tasks(spark)).mapInArrow(measure, "y int, x array<double>").collect())
    discard(some)
    return Toxicity(*whole, Calibration(np.array([x for _, x in learn]), np.array([y for y, _ in learn], np.float64)))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", most_toxic: int = 3_000, most_ordinary: int = 5_000, sample_bytes: int = 64 << 20, cut: float = 0.5, carry: bool = False,
    trainer_bytes: int | None = 16 << 20,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; ``carry`` adds the row itself as the struct ``doc``."""
    model = fit_toxicity(docs, labels, label, most_toxic, most_ordinary, sample_bytes, trainer_bytes)
    return scored(docs, model.scorer if model else lambda: lambda texts: np.zeros(len(texts)), cut, carry)
