"""Append-only ingest of relationship streams: late repeats are dropped within a watermark, batches are written exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_edges(stream: DataFrame, folder: str, checkpoint: str, delay: str = "1 day", once: bool = True) -> StreamingQuery:
    """Write a stream of ``(edge_id, …, loaded_at)`` rows as Parquet, each `edge_id` once within `delay` of event time.

    Rows without `loaded_at` or `edge_id` cannot be ordered or told apart and are dropped. With `once` all
    available input is taken and the query ends.
    """
    seen = (
        stream.where("edge_id IS NOT NULL AND loaded_at IS NOT NULL")
        .withColumn("loaded_at", stream["loaded_at"].cast("timestamp"))
        .withWatermark("loaded_at", delay)
        .dropDuplicatesWithinWatermark(["edge_id"])
    )
    writer = seen.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
