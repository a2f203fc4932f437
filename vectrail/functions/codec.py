"""Vectors as bytes, in either byte order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ORDERS = {"big": ">f4", "little": "<f4"}


def floats_to_bytes(column, order: str = "big") -> Column:
    kind = _ORDERS[order]

    def run(v: pa.Array) -> pa.Array:
        offsets = v.offsets.to_numpy()
        body = v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes()
        valid = pa.array(v.is_valid().to_numpy(zero_copy_only=False)).buffers()[1]
        return pa.Array.from_buffers(pa.binary(), len(v), [valid, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(body)])

    return F.arrow_udf(run, "binary")(column)


def bytes_to_floats(column, order: str = "big") -> Column:
    kind = _ORDERS[order]

    def run(b: pa.Array) -> pa.Array:
        rows = b.to_pylist()
        ends = np.cumsum([0, *(0 if x is None else len(x) // 4 for x in rows)]).astype(np.int32)
        values = np.frombuffer(b"".join(x for x in rows if x is not None), kind).astype(np.float32)
        mask = pa.array([x is None for x in rows]) if b.null_count else None
        return pa.ListArray.from_arrays(ends, pa.array(values), mask=mask)

    return F.arrow_udf(run, "array<float>")(column)
