"""Operator 2: token counts by a count-only Viterbi.

A text's tokens under a unigram vocabulary are those of the segmentation with
the highest sum of piece scores.  An Aho-Corasick automaton enumerates every
vocabulary match by its end, longest first; dynamic programming carries, for each
position, only the best score and the number of pieces that reach it.  No
lattice and no back pointers are kept.

Exact tie rules, as unigram tokenizers have them: sums are 64-bit floats in
order of the text; a later candidate replaces the best only if strictly greater,
candidates of one end coming in order of their starts; a character without a
one-character piece may also be unknown, with the lowest score minus 10, and
counts one piece for each of its UTF-8 bytes.

Where no piece holds the word mark after another character and every score is a
whole number, sums of scores are exact, so that a text falls apart at its word
marks: segments are counted once and kept in a bounded table.  Other
vocabularies are run over the whole text.

Defined results: null and empty texts have 0 tokens and score 0; very long
texts are read whole; repeated rows, empty tables and extra columns are of no
account.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments that a worker remembers before it starts anew.
REMEMBERED = 400_000


class CountingViterbi:
    """Counts pieces; ``pieces`` maps text to score, ``dummy_prefix`` puts a word mark before the text."""

    def __init__(self, pieces: dict[str, float], dummy_prefix: bool = True):
        self.pieces = {p: s for p, s in pieces.items() if p}
        self.dummy_prefix = dummy_prefix
        self.unknown = min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), float(score)))
        if self.pieces:
            self.automaton.make_automaton()
        self.splits = all(s == int(s) for s in self.pieces.values()) and not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.known: dict[str, tuple[float, int]] = {}
        self.segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    @classmethod
    def from_sentencepiece(cls, path: str) -> CountingViterbi:
        """The normal and user-defined pieces of a model file with their scores, read as a unigram vocabulary."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not skip(i)})

    def normal(self, text: str) -> str:
        return (MARK * self.dummy_prefix + text.replace(" ", MARK)) if text else ""

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation of a normalised text."""
        scores, counts = [0.0], [0]
        at, best, pieces, single = 0, None, 0, False

        def close() -> None:
            """Position ``at + 1`` has seen all its matches."""
            nonlocal best, pieces
            if not single:
                x = scores[at] + self.unknown
                if best is None or x > best:
                    best, pieces = x, counts[at] + len(text[at].encode("utf-8", "surrogatepass"))
            scores.append(best)
            counts.append(pieces)

        for end, (length, score) in self.automaton.iter(text) if self.pieces else ():
            while at < end:
                close()
                at, best, single = at + 1, None, False
            start = end + 1 - length
            x = scores[start] + score
            if best is None or x > best:
                best, pieces = x, counts[start] + 1
            single = single or length == 1
        while at < len(text):
            close()
            at, best, single = at + 1, None, False
        return scores[-1], counts[-1]

    def count(self, text: str | None) -> tuple[float, int]:
        whole = self.normal(text or "")
        if not whole or not self.splits:
            return self.best(whole) if whole else (0.0, 0)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        score, pieces, known = 0.0, 0, self.known
        for segment, n in Counter(self.segments.findall(whole)).items():
            got = known.get(segment)
            if got is None:
                got = known[segment] = self.best(segment)
            score += n * got[0]
            pieces += n * got[1]
        return score, pieces


_LOADED: dict[str, CountingViterbi] = {}


def _loaded(model: str) -> CountingViterbi:
    if model not in _LOADED:
        _LOADED[model] = CountingViterbi.from_sentencepiece(model)
    return _LOADED[model]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, best_score; ``model`` is a vocabulary file that every executor has under this path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded(model)
        for batch in batches:
            got = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())],
                ["doc_id", "n_tokens", "best_score"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, best_score double")
