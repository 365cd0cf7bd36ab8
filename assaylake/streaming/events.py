"""Streaming counterparts of batch aggregations over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total: works on a stream (with a watermark) and on a table alike."""
    source = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = source.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(24,6)")).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))
