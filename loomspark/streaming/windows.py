"""Event-time windows. The same functions take batch and streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, keys: list[str], time: str = "ts", late: str | None = None) -> DataFrame:
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, slide: str, keys: list[str], time: str = "ts", late: str | None = None) -> DataFrame:
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.window(time, size, slide), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def session(events: DataFrame, gap: str, keys: list[str], time: str = "ts", late: str | None = None) -> DataFrame:
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
