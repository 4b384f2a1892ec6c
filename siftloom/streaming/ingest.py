"""Streaming extensions: file ingest with exact deduplication and stateless text measures; event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftloom.functions import text as t
from siftloom.operators import dedup, profile


def measured(stream: DataFrame, column: str = "question") -> DataFrame:
    """A stream with difficulty and lengths; no state."""
    return profile.difficulty(stream, column).withColumn("chars", t.count_chars(column))


def deduplicated(stream: DataFrame, column: str, event_time: str, lateness: str = "1 day") -> DataFrame:
    return dedup.streaming_exact_dedup(stream, column, event_time, lateness)


def windowed_counts(stream: DataFrame, event_time: str, key: str, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """(start, key, n) by event-time window; late rows count until the watermark passes their window."""
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append of a stream to a Parquet folder, over what is there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
