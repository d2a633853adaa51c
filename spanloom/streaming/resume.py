"""A stream over append-only record logs: each key is handled once, results are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def resumable(spark: SparkSession, source: str, schema, key: str, event_time: str, handle: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "1 day"):
    """Starts a stream of new JSON files; repeated keys within delay are dropped, and handle gets each batch.

    State is bounded by the watermark; the checkpoint carries progress over restarts."""
    rows = spark.readStream.schema(schema).json(source).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
