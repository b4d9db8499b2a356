"""Event streams: windowed counts with a watermark, sessions, and repeated events dropped. Beyond the original's scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, at: str = "ts", late: str = "1 day", length: str = "1 day", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(start, kind, n, total): counts and sums for each window; the same on a table and, with a watermark, on a stream."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    source = timed.withWatermark(at, late) if events.isStreaming else timed
    return source.groupBy(F.window(at, length), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str = "ts", user: str = "user_id", gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(user, start, end, n): runs of a user's events without a longer gap."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    source = timed.withWatermark(at, late) if events.isStreaming else timed
    return source.groupBy(user, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 day") -> DataFrame:
    """Events without repeats of a key that come within the watermark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])
