"""Streaming extensions (the batch operators have no stream of their own): windows over events, growing degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the files of a folder. Watermarks need an instant, so ts without a zone is read in the session's."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, *, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total): tumbling or sliding windows over ts; rows later than `late` are dropped. Batch or stream."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): sessions that end after a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def growing_degrees(edges: DataFrame) -> DataFrame:
    """(id, n): links of each node so far, from a stream or table of (src, dst); insert-only."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def rolling_status(events: DataFrame) -> DataFrame:
    """(day, last_event, last_type, n): the newest event of each day and how many there were."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"), F.count(F.lit(1)).alias("n")).select("day", F.col("m.event_id").alias("last_event"), F.col("m.event_type").alias("last_type"), "n")
