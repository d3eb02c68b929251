"""Streams of raw items: late data by overlap, each item once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def once(items: DataFrame, keys: list[str], time_col: str, late: str = "3 days") -> DataFrame:
    """Items that may come again within ``late`` of their first arrival; time may be without a zone."""
    timed = items.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.dropDuplicatesWithinWatermark(keys) if items.isStreaming else items.dropDuplicates(keys)


def drain(spark: SparkSession, source: str, schema, checkpoint: str, each: Callable[[DataFrame, int], None], keys: list[str], time_col: str, late: str = "3 days", files: int = 100, patience: int | None = None) -> bool:
    """Everything that has arrived since the last call, then stop: a scheduled run.

    ``each`` writes one micro-batch; its number makes the write repeatable.
    After ``patience`` seconds the run is stopped, and the next one goes on from
    its last complete micro-batch; returns whether all was drained.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = once(stream, keys, time_col, late).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done = query.awaitTermination(patience)
    if not done and patience is not None:
        query.stop()
    return done is not False
