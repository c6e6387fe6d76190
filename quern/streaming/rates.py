"""Windowed metrics over event streams, with watermarks for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_rates(stream: DataFrame, size: str, slide: str, late: str, by: list[str], seconds: float) -> DataFrame:
    """Count and rate per second in sliding windows; works on streams and tables alike."""
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n", (F.col("n") / seconds).alias("rate"))


def alert_sink(stream: DataFrame, path: str, checkpoint: str):
    """Append alert lines of notifications as text; one file set per micro-batch."""
    from quern.sources.sinks import alert_lines

    lines = alert_lines(stream, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss 'UTC'"))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
