"""Content-addressed streams: each content once, and running counts by kind of value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import hashing, values


def first_seen(stream: DataFrame, content: list[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """The stream with content_hash, each hash once within the watermark; state is dropped beyond it."""
    hashed = stream.withColumn("content_hash", hashing.content_hash(*content))
    return hashed.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["content_hash"])


def counts_by_kind(stream: DataFrame, json: str, time: str, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Values of each kind in tumbling windows."""
    kind = values.kind(values.parsed(json))
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window), kind.alias("kind")).agg(F.count("*").alias("n"))
