"""Streaming statistics of event-time windows, with watermarks for late samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.exprs import crest, rms


def windowed_stats(stream: DataFrame, window: str, step: str | None = None, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Tumbling or sliding statistics of ``stream(ts timestamp, <key>, value)``."""
    v = F.col("value")
    span = F.window("ts", window, step) if step else F.window("ts", window)
    return (
        stream.withWatermark("ts", late)
        .groupBy(span, key)
        .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), rms(v).alias("rms"), crest(v).alias("crest_factor"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n", "mean", "min", "max", "rms", "crest_factor")
    )


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Runs of samples that are less than ``gap`` apart."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), key)
        .agg(F.count(F.lit(1)).alias("n"), rms(F.col("value")).alias("rms"))
        .select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n", "rms")
    )
