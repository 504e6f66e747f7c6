"""Structured Streaming: files into extractors as they come, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """New files below a folder: (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)


def extract_stream(spark: SparkSession, root: str, extractor: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each new file through an extractor once; its rows are appended to *out*.

    A batch goes to a folder of its own number, which a repeated attempt
    overwrites, so rows never double.
    """

    def batch(df: DataFrame, number: int) -> None:
        extractor(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return file_stream(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(events: DataFrame) -> DataFrame:
    """Events with a time that can have a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts and sums by time window; on a stream late rows beyond the lateness are dropped."""
    t = timed(events)
    t = t.withWatermark("ts", lateness) if t.isStreaming else t
    out = t.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    t = timed(events)
    t = t.withWatermark("ts", lateness) if t.isStreaming else t
    return t.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no longer gap."""
    t = timed(events)
    t = t.withWatermark("ts", lateness) if t.isStreaming else t
    out = t.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
