"""Structured Streaming over append-only tables: windowed counts with a watermark, and the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts by window and key. On a stream, rows later than ``late`` are dropped and state older than that is freed."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__t", late)
    span = F.window("__t", size, slide) if slide else F.window("__t", size)
    return rows.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a key's rows with no gap of that length."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__t", late)
    return rows.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_key(events: DataFrame, time: str, key: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key that arrives, later ones dropped, with state bounded by the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
