"""Row-local distortions on streams of pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def attack_stream(pixels: DataFrame, attack: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that distorts what arrives and appends it as Parquet. For distortions without state only."""
    if not pixels.isStreaming:
        raise ValueError("pixels is not a stream")
    return attack(pixels).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
