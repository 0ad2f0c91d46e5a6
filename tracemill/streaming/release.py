"""Extension: releasing windowed counts of a stream of visits, with small counts suppressed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def windowed(visits: DataFrame, length: str = "1 hour", k: int = 0, late: str | None = None) -> DataFrame:
    """(day, roi, cnt): visits(ts, roi) counted by window start (Unix seconds) and ROI; `late` is how long a stream waits."""
    if visits.isStreaming:
        visits = visits.withWatermark("ts", late or "1 hour")
    counted = visits.groupBy(F.window("ts", length), "roi").agg(F.count("*").alias("cnt"))
    return counted.where(F.col("cnt") > k).select(F.unix_seconds("window.start").alias("day"), "roi", "cnt")


def sessions(visits: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): sessions of each user's visits, a gap apart."""
    if visits.isStreaming:
        visits = visits.withWatermark("ts", late or "1 hour")
    counted = visits.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def publish(released: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends closed windows to Parquet, each once."""
    return released.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
