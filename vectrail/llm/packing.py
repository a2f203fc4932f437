"""Operator 3: packing by power-of-two decomposition.

A document's ids, closed by an end id, are cut into pieces whose lengths are
powers of two: as many of ``longest`` as fit, then the binary digits of what is
left, largest first.  A piece is a sequence by itself and goes to the bucket of
its length, so that a training batch drawn from one bucket needs no padding and
no sequence crosses documents.

The plan is one pass without a shuffle.  Sequence ids are made of the partition
and a counter, so a task that runs again gives the same ids.

Defined results: null text is empty and yields the end id alone; very long
texts are read whole; rows that repeat are packed once each; extra columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy

LONGEST = 1024
END = 0


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """``n`` as a sum of powers of two up to ``longest``, largest first."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Ids:
    """Ids of a byte-level BPE vocabulary, as its ``tokenizers`` file gives them.

    With the same vocabulary as ranks (``ranks``), texts are encoded by the
    faster ``tiktoken``.  The file's special strings, and characters outside the
    blocks in ``PLAIN``, for which the two libraries' Unicode tables could
    differ, always go to ``tokenizers``.

    Long texts are encoded run by run of about ``RUN`` characters, as an encoding takes
    many times its text's memory.  Runs end before a single space between letters, digits
    or marks of ASCII: the pattern of byte-level BPE always starts a new word there, so
    the ids are those of the whole text.  A text without such a place is one run.
    """

    PLAIN = re.compile("[^\u0000-ɏ‐-‧€]")
    RUN = 1 << 16
    CUT = re.compile(r"(?<=[A-Za-z0-9.,;:!?]) (?=[A-Za-z0-9])")

    def __init__(self, model: str, ranks: str | None = None, pattern: str | None = None):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        with open(model, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file.get("added_tokens", [])]
        split = file.get("pre_tokenizer") or {}
        known = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.in_runs = known and not file.get("normalizer") and not file.get("truncation") and not any(self.CUT.search(s) for s in self.special)
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def runs(self, text: str) -> Iterator[str]:
        at = 0
        while self.in_runs and len(text) - at > self.RUN and (cut := self.CUT.search(text, at + self.RUN)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if len(text) <= self.RUN:
            return self._run(text)
        return np.concatenate([self._run(x) for x in self.runs(text)])

    def _run(self, text: str) -> np.ndarray:
        if self.fast and not self.PLAIN.search(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


_LOADED: dict[tuple, Ids] = {}

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int"


def pack(docs: DataFrame, model: str, ranks: str | None = None, pattern: str | None = None, longest: int = LONGEST, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves as array<int>. ``bucket`` is the length's logarithm."""
    lengths(1, longest)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model, ranks, pattern)
        if key not in _LOADED:
            _LOADED[key] = Ids(*key)
        encode, tail, sequence = _LOADED[key].encode, np.array([end], "<u4"), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, own = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([encode(text), tail])
                    start = 0
                    for n in lengths(len(ids), longest):
                        piece = ids[start : start + n]
                        rows.append((doc, start, n, zlib.crc32(piece), len(ids), sequence, 0, n.bit_length() - 1))
                        if with_ids:
                            own.append(piece)
                        start += n
                        sequence += 1
                kinds = [pa.int64()] * 7 + [pa.int32()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), SCHEMA + ", ids array<int>" * with_ids)
