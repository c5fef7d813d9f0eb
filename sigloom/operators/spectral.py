"""Spectra and time-frequency tables of signals in array form.

Transforms run as Arrow batches through NumPy kernels, all records of one length
and rate in one call; what follows a transform is plain DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import kernels as K
from sigloom.session import ship


MOST_BANDS = 1_000


def run_kernel(signals: DataFrame, kernel: Callable, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``kernel(values as rows x samples, rate) -> dict of one array or list a column`` per block of like records.

    Rows of a block keep their record_id and the columns named in ``carry``.
    """
    ship(signals.sparkSession)
    kinds = dict(signals.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in ("record_id", *carry))
    keep = len(carry) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(keep)
            rates = batch.column(keep + 1).to_numpy(zero_copy_only=False)
            sizes = values.value_lengths().to_numpy(zero_copy_only=False)
            like: dict[tuple[int, float], list[int]] = {}
            for i, key in enumerate(zip(sizes.tolist(), rates.tolist())):
                like.setdefault(key, []).append(i)
            for (size, rate), rows in like.items():
                block = np.array(values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), size)
                made = kernel(block, rate)
                ids = batch.select(range(keep)).take(pa.array(rows))
                columns = [*ids.columns, *[_column(x, len(rows)) for x in made.values()]]
                yield pa.RecordBatch.from_arrays(columns, [*ids.schema.names, *made])

    return signals.select("record_id", *carry, "values", "sampling_rate_hz").mapInArrow(run, f"{head}, {schema}")


def _column(x, rows: int) -> pa.Array:
    x = np.asarray(x)
    if x.ndim == 1:
        return pa.array(x)
    flat = pa.array(np.ascontiguousarray(x).reshape(-1))
    for size in reversed(x.shape[1:]):
        count = len(flat) // size if size else rows
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (count + 1) * size, size, dtype=np.int32) if size else np.zeros(count + 1, np.int32)), flat)
    return flat


def spectrum(signals: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """record_id, frequencies, magnitudes: one-sided amplitudes of the mean-free values."""

    def kernel(x: np.ndarray, rate: float) -> dict:
        f, m = K.one_sided(x, rate)
        return {"frequencies": np.broadcast_to(f, m.shape), "magnitudes": m}

    return run_kernel(signals, kernel, "frequencies array<double>, magnitudes array<double>", carry)


def power_spectrum(signals: DataFrame, segment: int | None = None) -> DataFrame:
    """record_id, frequencies, power: Welch's mean of half-overlapping Hann segments."""

    def kernel(x: np.ndarray, rate: float) -> dict:
        f, p = K.welch(x, rate, segment)
        return {"frequencies": np.broadcast_to(f, p.shape), "power": p}

    return run_kernel(signals, kernel, "frequencies array<double>, power array<double>")


def explode_spectrum(spectra: DataFrame, weight: str = "magnitudes") -> DataFrame:
    """record_id, bin, frequency_hz, weight: one row a bin."""
    pairs = F.arrays_zip("frequencies", weight)
    return spectra.select("record_id", F.posexplode(pairs).alias("bin", "p")).select(
        "record_id", F.col("bin").cast("long").alias("bin"), F.col("p.frequencies").alias("frequency_hz"), F.col(f"p.{weight}").alias("weight")
    )


def dominant_frequency(bins: DataFrame, ignore_dc: bool = True) -> DataFrame:
    """(record_id, dominant_frequency_hz): the first of the largest bins; 0 where all are 0."""
    top = F.max("bin").over(_whole())
    use = bins.withColumn("_top", top).where((F.col("bin") > 0) | (F.col("_top") == 0)) if ignore_dc else bins
    # of equal peaks the lowest, whichever way they are rounded
    peaks = use.withColumn("_best", F.max("weight").over(_whole()))
    near = F.when(F.col("weight") >= F.col("_best") * (1 - 1e-9), F.col("frequency_hz"))
    return peaks.groupBy("record_id").agg(F.when(F.max("_best") == 0, F.lit(0.0)).otherwise(F.min(near)).alias("dominant_frequency_hz"))


def _whole():
    from pyspark.sql import Window as W

    return W.partitionBy("record_id")


def descriptors(bins: DataFrame, rolloff: float = 0.85, epsilon: float = 1e-12) -> DataFrame:
    """Centroid, bandwidth, roll-off, flatness and entropy of exploded bins."""
    from pyspark.sql import Window as W

    if not 0 < rolloff <= 1:
        raise ValueError("rolloff must lie above 0 and at most at 1.")
    f, w = F.col("frequency_hz"), F.col("weight")
    whole = W.partitionBy("record_id")
    order = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    floor = F.greatest(w, F.lit(epsilon))
    marked = (
        bins.withColumn("_sum", F.sum("weight").over(whole))
        .withColumn("_centroid", F.when(F.col("_sum") == 0, 0.0).otherwise(F.sum(f * w).over(whole) / F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_sum"))))
        .withColumn("_cum", F.sum("weight").over(order))
        .withColumn("_square", F.sum(w * w).over(whole))
    )
    p = F.when(F.col("_square") > 0, w * w / F.when(F.col("_square") > 0, F.col("_square")).otherwise(1.0)).otherwise(0.0)
    part = F.when(p > 0, -p * F.log2(F.when(p > 0, p).otherwise(1.0))).otherwise(0.0)
    total = F.first("_sum")
    off = F.col("frequency_hz") - F.col("_centroid")
    return marked.groupBy("record_id").agg(
        F.first("_centroid").alias("spectral_centroid_hz"),
        F.when(total == 0, 0.0).otherwise(F.sqrt(F.sum(w * off * off) / F.when(total == 0, 1.0).otherwise(total))).alias("spectral_bandwidth_hz"),
        F.when(total == 0, 0.0)
        .otherwise(F.coalesce(F.min(F.when(F.col("_cum") >= F.lit(rolloff) * F.col("_sum"), f)), F.max(f)))
        .alias("spectral_rolloff_85_hz"),
        (F.exp(F.avg(F.log(floor))) / F.avg(floor)).alias("spectral_flatness"),
        (F.sum(part) / F.when(F.count(F.lit(1)) > 1, F.log2(F.count(F.lit(1)).cast("double"))).otherwise(1.0)).alias("spectral_entropy"),
    )


def band_energy(bins: DataFrame, bands: DataFrame, samples: int, rate: float) -> DataFrame:
    """Energy of each (record, band): amplitude bins within ``bands(band, low_hz, high_hz)``, names of their own.

    Half-open bands; one that ends at the Nyquist frequency is closed there, one
    that begins at or above it has a null energy.
    """
    nyquist = rate / 2
    last = samples // 2
    single = (F.col("bin") == 0) | ((F.col("bin") == last) & F.lit(samples % 2 == 0))
    power = F.when(single, F.col("weight") * F.col("weight")).otherwise(F.col("weight") * F.col("weight") / 2)
    high = F.least(F.col("high_hz"), F.lit(nyquist))
    inside = (F.col("frequency_hz") >= F.col("low_hz")) & (
        (F.col("frequency_hz") < high) | ((high == nyquist) & (F.col("frequency_hz") == nyquist))
    )
    few = bands.select("band", "low_hz", "high_hz").limit(MOST_BANDS + 1).collect()
    if len(few) > MOST_BANDS:
        raise ValueError(f"More than {MOST_BANDS} bands.")
    if not few:
        return bins.limit(0).select("record_id", F.lit("").alias("band"), F.lit(0.0).alias("band_energy"))
    # bands are a literal of the plan: each bin meets them in its own row
    table = F.array(*[F.struct(F.lit(r["band"]).alias("band"), F.lit(float(r["low_hz"])).alias("low_hz"), F.lit(float(r["high_hz"])).alias("high_hz")) for r in few])
    met = bins.withColumn("_b", F.explode(table)).select("record_id", "bin", "frequency_hz", "weight", "_b.*")
    return met.groupBy("record_id", "band").agg(
        F.when(F.first("low_hz") < nyquist, F.coalesce(F.sum(F.when(inside, power)), F.lit(0.0))).alias("band_energy")
    )


def stft(signals: DataFrame, window_seconds: float = 0.1, step_seconds: float | None = None, window="hann") -> DataFrame:
    """record_id, frame, bin, time_seconds, frequency_hz, re, im, magnitude."""

    def one(x: np.ndarray, rate: float):
        f, t, z = K.stft(x, rate, window_seconds, step_seconds, window)
        return f, t, (z.real, z.imag, np.abs(z))

    return _grid(signals, one, ("re", "im", "magnitude"))


def spectrogram(signals: DataFrame, window_seconds: float = 0.1, step_seconds: float | None = None, window="hann") -> DataFrame:
    """record_id, frame, bin, time_seconds, frequency_hz, power."""

    def one(x: np.ndarray, rate: float):
        f, t, p = K.spectrogram(x, rate, window_seconds, step_seconds, window)
        return f, t, (p,)

    return _grid(signals, one, ("power",))


def _grid(signals: DataFrame, one: Callable, names: tuple[str, ...]) -> DataFrame:
    ship(signals.sparkSession)
    kind = dict(signals.dtypes)["record_id"]
    schema = f"record_id {kind}, frame long, bin long, time_seconds double, frequency_hz double, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.array(batch.column(1)[i].values.to_numpy(zero_copy_only=False), np.float64)
                f, t, grids = one(x, batch.column(2)[i].as_py())
                frame, bin_ = (a.reshape(-1) for a in np.meshgrid(np.arange(len(t)), np.arange(len(f)), indexing="ij"))
                ids = batch.column(0).take(pa.array(np.full(len(frame), i)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(frame), pa.array(bin_), pa.array(t[frame]), pa.array(f[bin_]), *[pa.array(g.reshape(-1)) for g in grids]],
                    ["record_id", "frame", "bin", "time_seconds", "frequency_hz", *names],
                )

    return signals.select("record_id", "values", "sampling_rate_hz").mapInArrow(run, schema)


def spectrogram_features(grid: DataFrame, cutoff_hz: float) -> DataFrame:
    """Mean and largest power, and the largest high-frequency energy of a frame."""
    high = F.coalesce(F.sum(F.when(F.col("frequency_hz") >= cutoff_hz, F.col("power"))), F.lit(0.0))
    frames = grid.groupBy("record_id", "frame").agg(
        F.sum("power").alias("s"), F.count(F.lit(1)).alias("n"), F.max("power").alias("m"), high.alias("h")
    )
    return frames.groupBy("record_id").agg(
        (F.sum("s") / F.sum("n")).alias("mean_spectrogram_energy"),
        F.max("m").alias("max_spectrogram_energy"),
        F.max("h").alias("high_frequency_transient_energy"),
    )


def hilbert(signals: DataFrame) -> DataFrame:
    """record_id, sample_index, re, im, envelope, phase, instantaneous_frequency_hz."""

    def kernel(x: np.ndarray, rate: float) -> dict:
        got = [K.hilbert(row, rate) for row in x]
        z, e, p, f = (np.stack(c) for c in zip(*got))
        return {"re": z.real, "im": z.imag, "envelope": e, "phase": p, "instantaneous_frequency_hz": f}

    names = ("re", "im", "envelope", "phase", "instantaneous_frequency_hz")
    arrays = run_kernel(signals, kernel, ", ".join(f"{n} array<double>" for n in names))
    zipped = arrays.select("record_id", F.posexplode(F.arrays_zip(*names)).alias("sample_index", "p"))
    return zipped.select("record_id", F.col("sample_index").cast("long").alias("sample_index"), *[F.col(f"p.{n}").alias(n) for n in names])


def scalogram(signals: DataFrame, frequencies: list[float]) -> DataFrame:
    """record_id, scale_index, frequency_hz, width, sample_index, re, im, power of a complex Morlet transform."""
    wanted = np.array(frequencies, np.float64)

    def kernel(x: np.ndarray, rate: float) -> dict:
        got = [K.morlet(row, rate, wanted) for row in x]
        z = np.stack([c for _, c in got])
        return {"width": np.stack([w for w, _ in got]), "re": z.real, "im": z.imag}

    made = run_kernel(signals, kernel, "width array<double>, re array<array<double>>, im array<array<double>>")
    scales = made.select("record_id", F.posexplode(F.arrays_zip("width", "re", "im")).alias("scale_index", "s"))
    table = F.array(*[F.lit(float(f)) for f in frequencies])
    rows = scales.select(
        "record_id",
        F.col("scale_index").cast("long").alias("scale_index"),
        F.element_at(table, F.col("scale_index") + 1).alias("frequency_hz"),
        F.col("s.width").alias("width"),
        F.posexplode(F.arrays_zip(F.col("s.re").alias("re"), F.col("s.im").alias("im"))).alias("sample_index", "z"),
    )
    return rows.select(
        "record_id", "scale_index", "frequency_hz", "width", F.col("sample_index").cast("long").alias("sample_index"),
        F.col("z.re").alias("re"), F.col("z.im").alias("im"), (F.col("z.re") ** 2 + F.col("z.im") ** 2).alias("power"),
    )


def filter_signals(
    signals: DataFrame, kind: str, low_cut_hz: float | None = None, high_cut_hz: float | None = None, order: int = 4,
    zero_phase: bool = True, allow_causal_fallback: bool = False,
) -> DataFrame:
    """Butterworth low-pass, high-pass or band-pass; a record that cannot be filtered keeps its values and says why in ``status``."""

    def kernel(x: np.ndarray, rate: float) -> dict:
        status = "ok"
        try:
            sos = K.butterworth(kind, order, rate, low_cut_hz, high_cut_hz)
            if not zero_phase:
                y = K.sos_filter(sos, x)
            elif x.shape[1] > K.pad_length(sos):
                y = K.zero_phase(sos, x)
            elif allow_causal_fallback:
                y, status = K.sos_filter(sos, x), "causal_fallback"
            else:
                y, status = x, "The record is too short for zero-phase filtering."
        except K.SignalError as error:
            y, status = x, str(error)
        return {"values": y, "status": np.full(len(x), status, dtype=object)}

    carry = tuple(c for c in ("record_name", "label") if c in signals.columns)
    with_rate = signals.withColumn("_rate", F.col("sampling_rate_hz"))
    out = run_kernel(with_rate, kernel, "values array<double>, status string", (*carry, "_rate"))
    return out.withColumnRenamed("_rate", "sampling_rate_hz")
