"""Streaming ingest: each micro-batch becomes one segment of a memory, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def ingest(stream: DataFrame, engine: Engine, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds the rows (session, message, role, author, ts, body, ord) of a stream to a memory. A batch that is tried again
    after a failure finds its segment written and adds nothing."""

    def add(batch: DataFrame, number: int) -> None:
        key = f"batch-{number}"
        if any(s.split("-", 1)[1] == key for s in engine.store.segments(name)) or batch.isEmpty():
            return
        engine.add_all(name, batch, key)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
