"""Demonstration data sets: harmonic records with injected anomalies, as tables and CSV files."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.exprs import taper

KINDS = ("transient_tone", "broadband_impulse")


@dataclass(frozen=True)
class DemoConfig:
    train: int = 8
    test_normal: int = 3
    test_anomalous: int = 3
    duration_seconds: float = 4.0
    sampling_rate_hz: float = 2000.0
    seed: int = 1

    def __post_init__(self) -> None:
        if self.train < 1 or self.test_normal < 0 or self.test_anomalous < 1:
            raise ValueError("Training and anomalous test records are needed, and no count may be negative.")
        if self.duration_seconds <= 0 or self.sampling_rate_hz <= 0:
            raise ValueError("duration_seconds and sampling_rate_hz must be positive.")


def _draw(seed: int, name: str, low: float, high: float) -> Column:
    """A fixed number of each record, between low and high."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("record_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.lit(low) + F.lit(high - low) * u


def demo_metadata(spark: SparkSession, config: DemoConfig = DemoConfig()) -> DataFrame:
    """One row a record: file_name, source_path, split, label, is_anomalous, anomaly times, rate, length, seed."""
    train, normal = F.col("record_id") < config.train, F.col("record_id") < config.train + config.test_normal
    kind = F.when(normal, None).otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (F.col("record_id") % len(KINDS) + 1).cast("int")))
    rows = spark.range(config.train + config.test_normal + config.test_anomalous).withColumnRenamed("id", "record_id")
    length = F.when(F.col("anomaly_kind") == KINDS[0], 0.24).otherwise(0.12)
    latest = F.greatest(F.lit(0.0), F.lit(config.duration_seconds) - length)
    earliest = F.least(F.lit(1.2), latest)
    start = F.when(F.col("anomaly_kind").isNotNull(), earliest + (latest - earliest) * _draw(config.seed, "start", 0.0, 1.0))
    return (
        rows.withColumn("split", F.when(train, "train").otherwise("test"))
        .withColumn("label", F.when(normal, "normal").otherwise("anomalous"))
        .withColumn("anomaly_kind", kind)
        .withColumn("is_anomalous", F.col("anomaly_kind").isNotNull())
        .withColumn("file_name", F.format_string("%s_%s_%03d.csv", "split", "label", "record_id"))
        .withColumn("source_path", F.concat(F.lit("records/"), F.col("file_name")))
        .withColumn("anomaly_start_seconds", start)
        .withColumn("anomaly_end_seconds", F.least(F.col("anomaly_start_seconds") + length, F.lit(config.duration_seconds)))
        .withColumn("sampling_rate_hz", F.lit(config.sampling_rate_hz))
        .withColumn("duration_seconds", F.lit(config.duration_seconds))
        .withColumn("seed", F.lit(config.seed).cast("long") + F.col("record_id"))
    )


def demo_samples(spark: SparkSession, config: DemoConfig = DemoConfig()) -> DataFrame:
    """(record_id, sample_index, time, voltage): three drifting harmonics and noise, with the anomalies of the metadata."""
    n = round(config.duration_seconds * config.sampling_rate_hz)
    meta = demo_metadata(spark, config).select("record_id", "anomaly_kind", "anomaly_start_seconds", "anomaly_end_seconds")
    t = F.col("sample_index") / F.lit(config.sampling_rate_hz)
    rows = meta.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_index")).withColumn("t", t)
    wave: Column = F.lit(0.0)
    for k, (a, f) in enumerate(((0.35, 45.0), (0.18, 130.0), (0.08, 260.0))):
        phase = _draw(config.seed, f"phase{k}", 0.0, 2 * math.pi)
        wave = wave + _draw(config.seed, f"a{k}", 0.85 * a, 1.15 * a) * F.sin(2 * math.pi * _draw(config.seed, f"f{k}", 0.96 * f, 1.04 * f) * F.col("t") + phase)
    drift = 1 + 0.08 * F.sin(0.5 * math.pi * F.col("t"))
    inside = F.coalesce((F.col("t") >= F.col("anomaly_start_seconds")) & (F.col("t") < F.col("anomaly_end_seconds")), F.lit(False))
    span = F.rint((F.col("anomaly_end_seconds") - F.col("anomaly_start_seconds")) * config.sampling_rate_hz)
    at = F.rint((F.col("t") - F.col("anomaly_start_seconds")) * config.sampling_rate_hz)
    shape = taper("hann", at, F.greatest(span, F.lit(2.0)), periodic=False)
    burst = F.when(F.col("anomaly_kind") == KINDS[0], 0.9 * F.sin(2 * math.pi * 620.0 * F.col("t"))).otherwise(0.7 * _normal(config.seed, "burst"))
    voltage = drift * wave + 0.035 * _normal(config.seed, "noise") + F.when(inside, shape * burst).otherwise(0.0)
    return rows.select("record_id", F.col("sample_index").cast("long").alias("sample_index"), F.round("t", 8).alias("time"), F.round(voltage, 8).alias("voltage"))


def _normal(seed: int, name: str) -> Column:
    """Normal noise that depends on nothing but record, sample and name (Box and Muller)."""

    def uniform(part: str) -> Column:
        h = F.pmod(F.xxhash64(F.lit(seed), F.lit(name + part), F.col("record_id"), F.col("sample_index")), F.lit(1 << 52))
        return (h + 0.5) / F.lit(float(1 << 52))

    return F.sqrt(-2 * F.log(uniform("r"))) * F.cos(2 * math.pi * uniform("a"))


def write_demo(spark: SparkSession, folder: str, config: DemoConfig = DemoConfig()) -> DataFrame:
    """Write ``records/<split>/...`` CSV files, one folder a record, and ``metadata``; earlier ones are replaced."""
    meta = demo_metadata(spark, config)
    named = demo_samples(spark, config).join(F.broadcast(meta.select("record_id", F.regexp_replace("file_name", r"\.csv$", "").alias("record"))), "record_id")
    ordered = named.repartition("record").sortWithinPartitions("record", "sample_index").select("record", "time", "voltage")
    ordered.write.mode("overwrite").partitionBy("record").option("header", True).csv(f"{folder}/records")
    meta.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/metadata")
    return meta
