"""Keep user-item counts up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over event files as they arrive."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path)


def running_counts(events: DataFrame) -> DataFrame:
    """customer, item, w: complete counts so far; state is one number for each pair."""
    return events.groupBy(F.col("user_id").alias("customer"), F.col("event_type").alias("item")).agg(F.count("*").cast("double").alias("w"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """item, window, w: counts of closed windows; state older than the watermark goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("item")).agg(F.count("*").alias("w"))
