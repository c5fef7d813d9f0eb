"""Signal generators as table-valued sources in long form (sample_index, value)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.exprs import sinc, taper
from sigloom.session import ship

TWO_PI = 2.0 * math.pi
BLOCK = 16_384  # samples of a block of a convolution
DIRECT = 64  # a block that is shorter is multiplied sample by sample


def _axis(spark: SparkSession, seconds: float, rate: float) -> DataFrame:
    if seconds <= 0 or rate <= 0:
        raise ValueError("duration_seconds and sampling_rate_hz must be positive.")
    n = round(seconds * rate)
    if n < 1:
        raise ValueError("The signal must hold at least one sample.")
    return spark.range(n).select(F.col("id").alias("sample_index"), (F.col("id") / F.lit(float(rate))).alias("t"))


def _signal(axis: DataFrame, value: Column) -> DataFrame:
    return axis.select("sample_index", value.cast("double").alias("value"))


def _sine(f: float, a: float, phase: float = 0.0) -> Column:
    return F.lit(float(a)) * F.sin(F.lit(TWO_PI * f) * F.col("t") + F.lit(float(phase)))


def sine_wave(spark, frequency_hz=50.0, duration_seconds=1.0, sampling_rate_hz=1000.0, amplitude=1.0, phase_radians=0.0) -> DataFrame:
    return _signal(_axis(spark, duration_seconds, sampling_rate_hz), _sine(frequency_hz, amplitude, phase_radians))


def noisy_sine_wave(spark, frequency_hz=50.0, duration_seconds=1.0, sampling_rate_hz=1000.0, amplitude=1.0, noise_std=0.1, seed=0) -> DataFrame:
    """A sine with seeded normal noise (the generator's stream is sequential, so it is drawn on the driver)."""
    if noise_std < 0:
        raise ValueError("The noise needs a spread of 0 or more.")
    axis = _axis(spark, duration_seconds, sampling_rate_hz)
    n = round(duration_seconds * sampling_rate_hz)
    noise = np.random.default_rng(seed).normal(0.0, noise_std, n)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(noise)], "sample_index long, noise double")
    return _signal(axis.join(rows, "sample_index"), _sine(frequency_hz, amplitude) + F.col("noise"))


def impulse_train(spark, impulse_rate_hz=20.0, duration_seconds=1.0, sampling_rate_hz=1000.0, amplitude=1.0) -> DataFrame:
    if impulse_rate_hz <= 0:
        raise ValueError("Impulses need a rate above 0.")
    gap = max(1, round(sampling_rate_hz / impulse_rate_hz))
    return _signal(_axis(spark, duration_seconds, sampling_rate_hz), F.when(F.col("sample_index") % gap == 0, float(amplitude)).otherwise(0.0))


def chirp_signal(spark, start_frequency_hz=20.0, end_frequency_hz=200.0, duration_seconds=1.0, sampling_rate_hz=1000.0, amplitude=1.0) -> DataFrame:
    slope = (end_frequency_hz - start_frequency_hz) / duration_seconds
    phase = F.lit(TWO_PI) * (F.lit(float(start_frequency_hz)) * F.col("t") + F.lit(0.5 * slope) * F.col("t") * F.col("t"))
    return _signal(_axis(spark, duration_seconds, sampling_rate_hz), F.lit(float(amplitude)) * F.sin(phase))


def clipped_signal(spark, frequency_hz=50.0, duration_seconds=1.0, sampling_rate_hz=1000.0, amplitude=1.5, clip_limit=1.0) -> DataFrame:
    if clip_limit <= 0:
        raise ValueError("The clip level must lie above 0.")
    wave = _sine(frequency_hz, amplitude)
    return _signal(_axis(spark, duration_seconds, sampling_rate_hz), F.least(F.greatest(wave, F.lit(-float(clip_limit))), F.lit(float(clip_limit))))


def transient_burst(
    spark, burst_frequency_hz=500.0, burst_start_seconds=0.4, burst_duration_seconds=0.05, duration_seconds=1.0, sampling_rate_hz=2000.0, amplitude=1.0
) -> DataFrame:
    if burst_start_seconds < 0 or burst_duration_seconds <= 0:
        raise ValueError("The burst must start at or after 0 and last some time.")
    inside = (F.col("t") >= burst_start_seconds) & (F.col("t") < burst_start_seconds + burst_duration_seconds)
    return _signal(_axis(spark, duration_seconds, sampling_rate_hz), F.when(inside, _sine(burst_frequency_hz, amplitude)).otherwise(0.0))


def window_signal(spark, window_type="hann", window_seconds=0.5, start_seconds=0.25, duration_seconds=1.0, sampling_rate_hz=1000.0, amplitude=1.0) -> DataFrame:
    """A symmetric window of its own length, zeros around it."""
    size = max(1, round(window_seconds * sampling_rate_hz))
    first = round(start_seconds * sampling_rate_hz)
    i = F.col("sample_index") - first
    weight = F.lit(float(amplitude)) * taper(window_type, i, F.lit(size), periodic=False)
    return _signal(_axis(spark, duration_seconds, sampling_rate_hz), F.when((i >= 0) & (i < size), weight).otherwise(0.0))


def sinc_signal(spark, bandwidth_hz=50.0, duration_seconds=1.0, sampling_rate_hz=1000.0, amplitude=1.0, center_seconds=None) -> DataFrame:
    if bandwidth_hz <= 0:
        raise ValueError("The bandwidth must lie above 0.")
    n = round(duration_seconds * sampling_rate_hz)
    centre = (n - 1) / sampling_rate_hz / 2 if center_seconds is None else center_seconds
    return _signal(_axis(spark, duration_seconds, sampling_rate_hz), F.lit(float(amplitude)) * sinc(F.lit(2.0 * bandwidth_hz) * (F.col("t") - F.lit(float(centre)))))


def add_signals(*signals: DataFrame) -> DataFrame:
    """Sample-wise sum; all signals must have the same samples."""
    return _combine(signals, lambda xs: sum(xs[1:], xs[0]))


def multiply_signals(*signals: DataFrame) -> DataFrame:
    def product(xs):
        out = xs[0]
        for x in xs[1:]:
            out = out * x
        return out

    return _combine(signals, product)


def _combine(signals, fold) -> DataFrame:
    if not signals:
        raise ValueError("At least one signal is needed.")
    out = signals[0].select("sample_index", F.col("value").alias("v0"))
    for k, other in enumerate(signals[1:], 1):
        out = out.join(other.select("sample_index", F.col("value").alias(f"v{k}")), "sample_index", "full")
    values = [F.col(f"v{k}") for k in range(len(signals))]
    complete = F.lit(True)
    for v in values:
        complete = complete & v.isNotNull()
    checked = F.when(complete, fold(values)).otherwise(F.raise_error(F.lit("The signals differ in length.")).cast("double"))
    return out.select("sample_index", checked.alias("value"))


def convolve_signals(first: DataFrame, second: DataFrame, mode: str = "same") -> DataFrame:
    """Discrete convolution of two signals of any lengths, by overlap-add of blocks of BLOCK samples.

    A sample that a signal lacks counts as 0.  Each pair of blocks is one product, in a task that
    holds these two blocks alone; the products' overlapping ends are added by sample.
    """
    if mode not in ("full", "same", "valid"):
        raise ValueError("mode must be full, same or valid.")
    n, m = (s.agg(F.coalesce(F.max("sample_index") + 1, F.lit(0))).first()[0] for s in (first, second))
    a, b = _blocks(first).withColumnsRenamed({"block": "i", "x": "x"}), _blocks(second).withColumnsRenamed({"block": "j", "x": "y"})
    dealt = a.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(-(-m // BLOCK) - 1, 0)).cast("long"))))
    pairs = dealt.join(b, "j").select(((F.col("i") + F.col("j")) * BLOCK).alias("at"), "x", "y")
    ship(first.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_product(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) for x, y in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["at", "z"])

    each = pairs.mapInArrow(run, "at long, z array<double>").select("at", F.posexplode("z").alias("k", "v"))
    full = each.groupBy((F.col("at") + F.col("k")).alias("i")).agg(F.sum("v").alias("value"))
    if mode == "full":
        start, size = 0, n + m - 1
    elif mode == "same":
        start, size = (min(n, m) - 1) // 2, max(n, m)
    else:
        start, size = min(n, m) - 1, max(n, m) - min(n, m) + 1
    return full.where((F.col("i") >= start) & (F.col("i") < start + size)).select((F.col("i") - start).alias("sample_index"), "value")


def _blocks(signal: DataFrame) -> DataFrame:
    """(block, x): BLOCK samples in order from the block's first, as far as the block's last one."""
    at = F.col("sample_index")
    rows = signal.groupBy(F.floor(at / BLOCK).cast("long").alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct((at % BLOCK).cast("int"), "value"))).alias("v"), F.max(at % BLOCK).cast("int").alias("last")
    )
    return rows.select("block", F.transform(F.sequence(F.lit(0), "last"), lambda k: F.coalesce(F.try_element_at("v", k), F.lit(0.0))).alias("x"))


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if min(len(x), len(y)) <= DIRECT:
        return np.convolve(x, y)
    size = len(x) + len(y) - 1
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)


def synthetic_dataset(spark: SparkSession) -> DataFrame:
    """The six default records in array form, in fixed order."""
    made = [
        ("sine_wave", sine_wave(spark), 1000.0),
        ("noisy_sine_wave", noisy_sine_wave(spark), 1000.0),
        ("impulse_train", impulse_train(spark), 1000.0),
        ("chirp", chirp_signal(spark), 1000.0),
        ("clipped_signal", clipped_signal(spark), 1000.0),
        ("transient_burst", transient_burst(spark), 2000.0),
    ]
    out = None
    for k, (name, signal, rate) in enumerate(made):
        part = signal.withColumns({"record_id": F.lit(k).cast("long"), "record_name": F.lit(name), "sampling_rate_hz": F.lit(rate)})
        out = part if out is None else out.unionByName(part)
    ordered = F.array_sort(F.collect_list(F.struct("sample_index", "value")))
    return out.groupBy("record_id", "record_name", "sampling_rate_hz").agg(F.transform(ordered, lambda s: s["value"]).alias("values")).select(
        "record_id", "record_name", F.lit(None).cast("string").alias("label"), "sampling_rate_hz", "values"
    )
