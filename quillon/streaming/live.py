"""Streams: filtered and projected rows as they come, and running aggregates."""

from __future__ import annotations

from pyspark.sql.streaming.query import StreamingQuery

from ..operators.table import Table


def append_to(table: Table, folder: str, checkpoint: str, once: bool = True, kind: str = "parquet") -> StreamingQuery:
    """Appends the rows of a stream to a folder; once ends when what has arrived is done. The checkpoint makes restarts exact."""
    writer = table.to_df().writeStream.format(kind).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def running(table: Table, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps a grouped stream as an in-memory table that is rewritten after every batch."""
    writer = table.to_df().writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("complete")
    return (writer.trigger(availableNow=True) if once else writer).start()
