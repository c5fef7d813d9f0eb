"""Adapters from Parquet tables to the two signal forms.

Long form: record_id, sample_index, value.  Array form: record_id, record_name,
label, sampling_rate_hz, values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def events_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in time order are one record."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("record_id"), (F.row_number().over(order) - 1).cast("long").alias("sample_index"), "ts", "value", "event_id", "event_type"
    )


def embedding_signals(spark: SparkSession, sf_dir: str, rate: float = 64.0) -> DataFrame:
    """Each vector is one record of 64 samples at 64 Hz, so that bin k lies at k Hz."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("record_id"),
        F.concat(F.lit("vec_"), F.col("vec_id")).alias("record_name"),
        F.col("label").cast("string").alias("label"),
        F.lit(float(rate)).alias("sampling_rate_hz"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


def lineitem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's line prices in shipping order are one record."""
    order = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("record_id"),
        (F.row_number().over(order) - 1).cast("long").alias("sample_index"),
        F.col("l_extendedprice").alias("value"),
    )


def to_long(signals: DataFrame, *carry: str) -> DataFrame:
    """Array form to long form, keeping the named columns."""
    return signals.select("record_id", *carry, F.posexplode("values").alias("sample_index", "value")).withColumn(
        "sample_index", F.col("sample_index").cast("long")
    )


def to_arrays(samples: DataFrame, rate: float = 1.0) -> DataFrame:
    """Long form to array form; order comes from sample_index."""
    ordered = F.array_sort(F.collect_list(F.struct("sample_index", "value")))
    return samples.groupBy("record_id").agg(F.transform(ordered, lambda s: s["value"]).alias("values")).select(
        "record_id",
        F.concat(F.lit("record_"), F.col("record_id")).alias("record_name"),
        F.lit(None).cast("string").alias("label"),
        F.lit(float(rate)).alias("sampling_rate_hz"),
        "values",
    )
