"""Scoring of streams by fitted models: the same pass over Arrow batches as for tables, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(model, stream: DataFrame, path: str, checkpoint: str, key: str, available_now: bool = True, **options) -> StreamingQuery:
    """Starts a query that appends model.predict(stream) to Parquet at path, exactly once by its checkpoint."""
    if not stream.isStreaming:
        raise ValueError("a streaming frame is needed")
    writer = model.predict(stream, key=key, **options).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
