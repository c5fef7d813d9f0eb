"""Checks of records in array form, and the trail of what was done to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import exprs as X

TRAIL = "preprocessing"


def status_of(values: Column, rate: Column) -> Column:
    """Why a record cannot be analysed, or ok."""
    empty = F.coalesce(F.size(values) < 1, F.lit(True)) | ~F.coalesce(X.is_finite(rate) & (rate > 0), F.lit(False))
    holes = F.exists(values, lambda v: ~X.is_finite(v))
    return F.when(empty, F.lit("The record has no samples or no sampling rate.")).when(holes, F.lit("The record contains non-finite samples.")).otherwise(F.lit("ok"))


def checked(signals: DataFrame) -> DataFrame:
    """``signals`` with a ``status``; nothing is dropped."""
    return signals.withColumn("status", status_of(F.col("values"), F.col("sampling_rate_hz")))


def with_step(signals: DataFrame, step: str, **facts) -> DataFrame:
    """``signals`` whose trail, a list of maps, ends with ``step`` and its facts; those that are None are left out."""
    known = {"step": step} | {k: str(v) for k, v in facts.items() if v is not None}
    own = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    before = F.col(TRAIL) if TRAIL in signals.columns else F.array().cast("array<map<string,string>>")
    return signals.withColumn(TRAIL, F.concat(before, F.array(own)))
