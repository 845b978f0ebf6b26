"""Streams: an extension beyond batch, for append-only event logs.

Each function takes a streaming or a static DataFrame; on a static one the watermark has
no effect, so the same plan is the batch query that its results are checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, max_files: int = 16) -> DataFrame:
    """A file stream with event time as a timestamp (watermarks reject those without zone)."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and window."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "3 hours", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type")
    return g.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no more than a gap apart."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """One row for each key; state is dropped behind the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the checkpoint makes a second run take only new files."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
