"""Operator 5: chat formatting with typed content parts.

A turn's content is a list of typed parts.  A visitor flattens them in order:
text is escaped, images, audio and documents become numbered placeholders, and
each attachment is recorded with its reference and the number of tokens that it
expands to.  A turn is formatted as::

    <turn ROLE>TEXT</turn>\\n

Control strings start with ``<`` and end with ``>``; these and the escape
``\\`` are written with a ``\\`` before them inside texts and roles, so what
texts say can always be told from the template and read back exactly.

A formatted conversation is its segments, one row per turn, in order: it is
never gathered into one value, so a conversation may hold any number of turns.
The reader streams the sorted segments of a conversation and keeps digests only.

Order: turn (null last), then role and content.  Defined results: null role,
text and reference are empty; null conv_id is a conversation of its own; unknown
part types raise; repeated rows are repeated turns; an empty table has no
conversations; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
SEGMENT = "conv_id bigint, turn bigint, role string, segment string, loss_start bigint, loss_length bigint, attachments array<struct<type:string,ref:string,tokens:bigint>>, attached_tokens bigint"

_ESCAPE = re.compile(r"[\\<>]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.|<(?:image|audio|document) \d+>)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class PartVisitor:
    """Flattens parts; one ``visit_<type>`` method per type. Subclass to change the token costs."""

    patch, audio_per_second, per_page = 28, 25, 512

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part['type']}", None)
        if method is None:
            raise ValueError(f"unknown content part {part['type']!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(k) or 0) / self.patch) for k in ("width", "height"))
        self._attach(part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("seconds") or 0) * self.audio_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * self.per_page)

    def _attach(self, part: dict, tokens: int) -> None:
        self.out.append(f"<{part['type']} {len(self.attachments)}>")
        self.attachments.append({"type": part["type"], "ref": part.get("ref") or "", "tokens": tokens})


def format_turn(role: str, parts: list[dict], loss_role: str = "assistant", visitor: type[PartVisitor] = PartVisitor) -> dict:
    v = visitor()
    for part in parts:
        v.visit(part)
    head, body = f"<turn {escape(role)}>", "".join(v.out)
    return {
        "segment": f"{head}{body}</turn>\n", "loss_start": len(head), "loss_length": len(body) if role == loss_role else 0,
        "attachments": v.attachments, "attached_tokens": sum(a["tokens"] for a in v.attachments),
    }


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; placeholders stay as they are written."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def text_part(text: str | Column) -> Column:
    """A content column that holds one text part."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).cast("array<struct<type:string,text:string>>")


def format_turns(turns: DataFrame, content: str = "content", loss_role: str = "assistant", visitor: type[PartVisitor] = PartVisitor) -> DataFrame:
    """One formatted segment per row of (conv_id, turn, role, content); each row by itself, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            got = [format_turn(r, c or [], loss_role, visitor) for r, c in zip(roles, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array([g["segment"] for g in got], pa.string()),
                    pa.array([g["loss_start"] for g in got], pa.int64()), pa.array([g["loss_length"] for g in got], pa.int64()),
                    pa.array([g["attachments"] for g in got], kind), pa.array([g["attached_tokens"] for g in got], pa.int64()),
                ],
                ["conv_id", "turn", "role", "segment", "loss_start", "loss_length", "attachments", "attached_tokens"],
            )

    return turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", content).mapInArrow(run, SEGMENT)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class _Digest:
    def __init__(self, conv):
        self.conv, self.n, self.chars, self.loss_chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, length: int) -> None:
        for role, text in read_turns(segment):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        masked = unescape(segment[start : start + length])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each formatted conversation, read from its segments in order, in bounded memory."""
    names = DIGEST.replace(" bigint", "").replace(" string", "").split(", ")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None

        def out(done: list[_Digest]) -> pa.RecordBatch:
            rows = pd.DataFrame([d.row() for d in done], columns=names).astype({"conv_id": "Int64"})
            return pa.RecordBatch.from_pandas(rows, preserve_index=False)

        for batch in frames:
            done = []
            for conv, segment, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now)
                    now = _Digest(conv)
                now.add(segment, start, length)
            if done:
                yield out(done)
        if now is not None:
            yield out([now])

    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("segment")]
    dealt = segments.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(run, DIGEST)
