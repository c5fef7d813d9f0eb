"""Feature tables: one row a record, or one row a sliding window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import kernels as K
from sigloom.session import ship


@dataclass(frozen=True)
class Band:
    name: str
    low_hz: float
    high_hz: float


def bands_from_mapping(bands: dict[str, tuple[float, float]]) -> tuple[Band, ...]:
    return tuple(Band(k, float(a), float(b)) for k, (a, b) in bands.items())


@dataclass(frozen=True)
class FeatureConfig:
    bands: tuple[Band, ...] = ()
    spectrogram_window_seconds: float = 0.1
    spectrogram_step_seconds: float | None = None
    high_frequency_cutoff_hz: float | None = None

    def __post_init__(self) -> None:
        if self.spectrogram_window_seconds <= 0:
            raise ValueError("A spectrogram window must last some time.")
        if self.spectrogram_step_seconds is not None and self.spectrogram_step_seconds <= 0:
            raise ValueError("A spectrogram step must last some time.")
        if self.high_frequency_cutoff_hz is not None and self.high_frequency_cutoff_hz < 0:
            raise ValueError("The high-frequency cutoff cannot lie below 0.")
        check_bands(self.bands)


@dataclass(frozen=True)
class SlidingConfig:
    window_seconds: float
    step_seconds: float
    bands: tuple[Band, ...] = ()
    include_time_domain: bool = True
    include_frequency_domain: bool = True
    frequency_window: str | None = "hann"
    normalize_power: bool = True

    def __post_init__(self) -> None:
        if self.window_seconds <= 0 or self.step_seconds <= 0:
            raise ValueError("Windows and steps must last some time.")
        if self.step_seconds > self.window_seconds:
            raise ValueError("A step cannot be longer than its window.")
        if not (self.include_time_domain or self.include_frequency_domain):
            raise ValueError("At least one feature group must be included.")


def check_bands(bands: tuple[Band, ...]) -> None:
    for band in bands:
        if band.low_hz < 0 or band.high_hz <= band.low_hz:
            raise ValueError(f"Band '{band.name}' must have 0 <= low_hz < high_hz.")


TIME = ("mean", "std", "min", "max", "peak_to_peak", "rms", "crest_factor", "zero_crossing_rate", "skewness", "kurtosis")
FREQUENCY = ("dominant_frequency_hz", "spectral_centroid_hz", "spectral_bandwidth_hz", "spectral_rolloff_85_hz", "spectral_flatness")
GRID = ("mean_spectrogram_energy", "max_spectrogram_energy", "high_frequency_transient_energy")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def time_block(x: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """Time-domain features of the rows of x."""
    n = x.shape[1]
    mean, low, high = x.mean(axis=1), x.min(axis=1), x.max(axis=1)
    level = np.sqrt((x**2).mean(axis=1))
    d = x - mean[:, None]
    m2, m3, m4 = ((d**k).mean(axis=1) for k in (2, 3, 4))
    same = low == high
    g = _ratio(m3, m2**1.5)
    skew = g * np.sqrt(n * (n - 1)) / (n - 2) if n > 2 else g
    k = _ratio(m4, m2**2)
    kurt = ((n * n - 1) * k - 3 * (n - 1) ** 2) / ((n - 2) * (n - 3)) + 3 if n > 3 else k
    crossings = np.zeros(len(x))
    if n > 1:
        for i, row in enumerate(x):
            signs = np.signbit(row[row != 0])
            crossings[i] = (signs[1:] != signs[:-1]).sum() / (n - 1) * rate
    return {
        "mean": mean, "std": x.std(axis=1), "min": low, "max": high, "peak_to_peak": high - low, "rms": level,
        "crest_factor": _ratio(np.abs(x).max(axis=1), level), "zero_crossing_rate": crossings,
        "skewness": np.where(same, 0.0, skew), "kurtosis": np.where(same, 0.0, kurt),
    }


def frequency_block(x: np.ndarray, rate: float, bands: tuple[Band, ...]) -> dict[str, np.ndarray]:
    """Spectral features of the rows of x from one transform."""
    f, m = K.one_sided(x, rate)
    total = m.sum(axis=1)
    first = 1 if m.shape[1] > 1 else 0
    # of equal peaks the lowest, whichever way they are rounded
    top = (m[:, first:] >= m[:, first:].max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1) + first
    centroid = _ratio((m * f).sum(axis=1), total)
    cum = np.cumsum(m, axis=1)
    reached = np.minimum((cum < 0.85 * total[:, None]).sum(axis=1), m.shape[1] - 1)
    floor = np.maximum(m, 1e-12)
    out = {
        "dominant_frequency_hz": np.where(m[:, first:].max(axis=1) == 0, 0.0, f[top]),
        "spectral_centroid_hz": centroid,
        "spectral_bandwidth_hz": np.sqrt(_ratio((m * (f[None, :] - centroid[:, None]) ** 2).sum(axis=1), total)),
        "spectral_rolloff_85_hz": np.where(total == 0, 0.0, f[reached]),
        "spectral_flatness": np.exp(np.log(floor).mean(axis=1)) / floor.mean(axis=1),
    }
    nyquist = rate / 2
    for band in bands:
        if band.low_hz >= nyquist:
            out[f"band_energy_{band.name}"] = np.full(len(x), np.nan)
        else:
            out[f"band_energy_{band.name}"] = K.band_sum(f, m.copy(), x.shape[1], band.low_hz, min(band.high_hz, nyquist), nyquist)
    return out


def entropy_block(x: np.ndarray, rate: float) -> np.ndarray:
    _, m = K.one_sided(x, rate)
    w = m**2
    p = _ratio(w, w.sum(axis=1, keepdims=True))
    bits = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)
    return bits / (np.log2(w.shape[1]) if w.shape[1] > 1 else 1.0)


def grid_block(x: np.ndarray, rate: float, config: FeatureConfig) -> dict[str, np.ndarray]:
    window = min(config.spectrogram_window_seconds, x.shape[1] / rate)
    if config.spectrogram_step_seconds is not None and config.spectrogram_step_seconds > window:
        return {name: np.full(len(x), np.nan) for name in GRID}
    cutoff = 0.75 * rate / 2 if config.high_frequency_cutoff_hz is None else config.high_frequency_cutoff_hz
    mean, top, high = (np.zeros(len(x)) for _ in range(3))
    for i, row in enumerate(x):
        f, _, p = K.spectrogram(row, rate, window, config.spectrogram_step_seconds)
        mean[i], top[i] = p.mean(), p.max()
        inside = f >= cutoff
        high[i] = p[:, inside].sum(axis=1).max() if inside.any() else 0.0
    return dict(zip(GRID, (mean, top, high)))


def feature_columns(config: FeatureConfig) -> list[str]:
    return [*TIME, *FREQUENCY, *[f"band_energy_{b.name}" for b in config.bands], "spectral_entropy", *GRID]


def extract_features(signals: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """One row for each record of ``signals`` in array form, in one pass.

    A record with missing samples or none has null features and a reason in
    ``status``; all others have status ok.
    """
    ship(signals.sparkSession)
    kind = dict(signals.dtypes)["record_id"]
    names = feature_columns(config)
    head = ["record_id", "record_name", "label", "sampling_rate_hz", "n_samples", "duration_seconds"]
    schema = f"record_id {kind}, record_name string, label string, sampling_rate_hz double, n_samples double, duration_seconds double, " + ", ".join(
        f"`{n}` double" for n in names
    ) + ", status string"

    def kernel(x: np.ndarray, rate: float) -> dict[str, np.ndarray]:
        return time_block(x, rate) | frequency_block(x, rate, config.bands) | {"spectral_entropy": entropy_block(x, rate)} | grid_block(x, rate, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = batch.column(3).to_numpy(zero_copy_only=False)
            values = [np.array(v.values.to_numpy(zero_copy_only=False), np.float64) if v.is_valid else np.zeros(0) for v in batch.column(4)]
            out = {n: np.full(len(values), np.nan) for n in names}
            status = np.full(len(values), "ok", dtype=object)
            like: dict[tuple[int, float], list[int]] = {}
            for i, v in enumerate(values):
                if not len(v) or not rates[i] > 0:
                    status[i] = "The record has no samples or no sampling rate."
                elif not np.isfinite(v).all():
                    status[i] = "The record contains non-finite samples."
                else:
                    like.setdefault((len(v), float(rates[i])), []).append(i)
            for (_, rate), rows in like.items():
                for name, column in kernel(np.stack([values[i] for i in rows]), rate).items():
                    out[name][rows] = column
            size = np.array([len(v) for v in values], np.float64)
            base = [*batch.columns[:4], pa.array(size), pa.array(np.divide(size, rates, out=np.zeros(len(size)), where=rates > 0))]
            bad = status != "ok"
            yield pa.RecordBatch.from_arrays(
                [*base, *[pa.array(out[n], mask=bad) for n in names], pa.array(status, pa.string())], [*head, *names, "status"]
            )

    return signals.select("record_id", "record_name", "label", "sampling_rate_hz", "values").mapInArrow(run, schema)


def sliding_features(signals: DataFrame, config: SlidingConfig) -> DataFrame:
    """One row for each full window of each record; records shorter than a window, or with
    missing samples, give no row.  Time features are of the raw window, spectral ones of the
    tapered window."""
    ship(signals.sparkSession)
    kind = dict(signals.dtypes)["record_id"]
    names = [*(TIME if config.include_time_domain else ()), *((*FREQUENCY, *[f"band_energy_{b.name}" for b in config.bands]) if config.include_frequency_domain else ())]
    schema = (
        f"record_id {kind}, record_name string, label string, window_index long, window_start_seconds double, window_end_seconds double, "
        "window_center_seconds double, window_n_samples double, frequency_window string, " + ", ".join(f"`{n}` double" for n in names)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.array(batch.column(4)[i].values.to_numpy(zero_copy_only=False), np.float64)
                rate = batch.column(3)[i].as_py()
                size = max(1, round(config.window_seconds * rate))
                step = max(1, round(config.step_seconds * rate))
                if size > len(x) or not np.isfinite(x).all():
                    continue
                w = K.frames(x, size, step)
                out: dict[str, np.ndarray] = {}
                if config.include_time_domain:
                    out |= time_block(w, rate)
                if config.include_frequency_domain:
                    y = w
                    if config.frequency_window is not None:
                        weights = K.window_weights(config.frequency_window, size)
                        y = w * (weights / np.sqrt((weights**2).mean()) if config.normalize_power else weights)
                    out |= frequency_block(y, rate, config.bands)
                k = len(w)
                start = np.arange(k) * step / rate
                end = (np.arange(k) * step + size) / rate
                at = pa.array(np.full(k, i))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(np.arange(k)),
                        pa.array(start), pa.array(end), pa.array((start + end) / 2), pa.array(np.full(k, float(size))),
                        pa.array([str(config.frequency_window)] * k), *[pa.array(out[n]) for n in names],
                    ],
                    ["record_id", "record_name", "label", "window_index", "window_start_seconds", "window_end_seconds",
                     "window_center_seconds", "window_n_samples", "frequency_window", *names],
                )

    return signals.select("record_id", "record_name", "label", "sampling_rate_hz", "values").mapInArrow(run, schema)


def band_means(table: DataFrame) -> DataFrame:
    """(band, mean_energy) over all rows of a feature table; a band that no row has is null."""
    prefix = "band_energy_"
    names = [c for c in table.columns if c.startswith(prefix)]
    means = table.agg(*[F.avg(F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double"))).alias(c) for c in names])
    return means.select(F.explode(F.array(*[F.struct(F.lit(c[len(prefix) :]).alias("band"), F.col(f"`{c}`").alias("mean_energy")) for c in names])).alias("x")).select("x.*")
