"""Streams: structures that arrive as files, and windowed counts of events.

Detectors look at one structure at a time, so they run on a stream of structure
rows in micro-batches; what they find is appended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema, files_a_batch: int = 64) -> DataFrame:
    """Parquet atoms as they arrive; a file holds whole structures."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def detect_stream(atoms: DataFrame, detector: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch detector on every micro-batch; a batch that is repeated after a failure writes the same folder."""

    def batch(df: DataFrame, number: int) -> None:
        detector(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return atoms.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_hour(events: DataFrame, late: str | None = None) -> DataFrame:
    """hour, event_type, n; on a stream with a watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late is not None:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
