"""Metadata as JSON, vectors from JSON, times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def metadata_json(rid, extra) -> Column:
    """``{"rid": .., "extra": ..}``; extra is JSON text, and missing extra is a JSON null."""
    return F.concat(F.lit('{"rid":'), F.coalesce(F.to_json(F.array(_col(rid))).substr(F.lit(2), F.length(F.to_json(F.array(_col(rid)))) - 2), F.lit("null")), F.lit(',"extra":'), F.coalesce(_col(extra), F.lit("null")), F.lit("}"))


def metadata_field(meta, path: str) -> Column:
    return F.get_json_object(_col(meta), path)


def vector_from_json(text) -> Column:
    """A JSON array of numbers as floats; anything else raises."""
    parsed = F.from_json(_col(text), "array<float>", {"mode": "FAILFAST"})
    bad = parsed.isNull() | F.exists(parsed, lambda x: x.isNull())
    return F.when(_col(text).isNull(), F.lit(None)).when(bad, F.raise_error(F.lit("not an array of numbers"))).otherwise(parsed)


def millis_text(millis) -> Column:
    return F.date_format(F.timestamp_millis(_col(millis)), "yyyy-MM-dd HH:mm:ss.SSS")


def duration_text(millis) -> Column:
    """Days, hours, minutes and seconds."""
    s = F.floor(_col(millis) / 1000).cast("bigint")
    return F.format_string("%dd %dH %dm %ds", F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
