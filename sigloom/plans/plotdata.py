"""The data behind each plot, as DataFrames; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.exprs import decibels
from sigloom.operators import samples as S
from sigloom.operators import spectral


def time_window(samples: DataFrame, rate: float, start_seconds: float = 0.0, duration_seconds: float | None = None) -> DataFrame:
    """Samples of [start, start + duration), at least one where the record has any there."""
    first = max(0, round(start_seconds * rate))
    out = samples.where(F.col("sample_index") >= first)
    if duration_seconds is not None:
        if duration_seconds <= 0:
            raise ValueError("duration_seconds must be positive.")
        out = out.where(F.col("sample_index") < first + max(1, round(duration_seconds * rate)))
    return out.withColumn("time_seconds", F.col("sample_index") / F.lit(float(rate)))


def time_signal(samples: DataFrame, rate: float, start_seconds=0.0, duration_seconds=None, max_points: int = 2000, method: str = "envelope") -> DataFrame:
    window = time_window(samples, rate, start_seconds, duration_seconds)
    first = window.groupBy("record_id").agg(F.min("sample_index").alias("_first"))
    local = window.join(first, "record_id").select("record_id", (F.col("sample_index") - F.col("_first")).alias("sample_index"), "value", "_first")
    if method not in ("envelope", "stride"):
        raise ValueError("method must be 'envelope' or 'stride'.")
    made = (S.downsample_envelope if method == "envelope" else S.downsample_stride)(local.drop("_first"), max_points)
    out = made.join(first, "record_id")
    return out.select("record_id", (F.col("sample_index") + F.col("_first")).alias("sample_index"), ((F.col("sample_index") + F.col("_first")) / F.lit(float(rate))).alias("time_seconds"), "value")


def frequency_spectrum(signals: DataFrame, kind: str = "fft", log_frequency: bool = False) -> DataFrame:
    if kind not in ("fft", "psd"):
        raise ValueError("kind must be 'fft' or 'psd'.")
    spectra = spectral.spectrum(signals) if kind == "fft" else spectral.power_spectrum(signals)
    bins = spectral.explode_spectrum(spectra, "magnitudes" if kind == "fft" else "power")
    return bins.where("frequency_hz > 0") if log_frequency else bins


def spectrogram_db(signals: DataFrame, window_seconds=0.1, step_seconds=None, dynamic_range_db: float | None = None, log_frequency: bool = False) -> DataFrame:
    """power_db of each cell, and the colour limits of its record."""
    grid = spectral.spectrogram(signals, window_seconds, step_seconds).withColumn("power_db", decibels(F.col("power")))
    grid = grid.where("frequency_hz > 0") if log_frequency else grid
    ends = grid.groupBy("record_id").agg(F.min("power_db").alias("low_db"), F.max("power_db").alias("high_db"))
    if dynamic_range_db is not None:
        ends = ends.withColumn("low_db", F.col("high_db") - F.lit(float(dynamic_range_db)))
    return grid.join(ends, "record_id")


def feature_importance(importances: dict[str, float], spark, n: int = 10) -> DataFrame:
    rows = spark.createDataFrame(list(importances.items()), "feature string, importance double")
    return rows.orderBy(F.desc(F.abs("importance")), "feature").limit(n)
