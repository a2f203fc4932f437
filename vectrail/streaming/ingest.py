"""Streaming ingest into a collection.

Each micro-batch is one part of the collection, tagged by stream and batch: a
batch that runs again after a failure replaces itself.  Rows can be searched as
soon as their batch is written; an index takes them in at its next build, and
until then they are searched beside it.  Refused rows go to the quarantine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, name: str = "ingest", once: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Append a stream of (vector, rid, extra) rows; ``once`` takes what is there and ends."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            collection.add(batch, tag=f"{name}-{batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
