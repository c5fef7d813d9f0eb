"""Operators on samples in long form: record_id, sample_index, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigloom.functions import exprs as X



def time_stats(samples: DataFrame, by: tuple[str, ...] = ("record_id",)) -> DataFrame:
    v = F.col("value")
    return samples.groupBy(*by).agg(*basic_aggregates(v))


def basic_aggregates(v: Column) -> list[Column]:
    return [
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("peak_to_peak"),
    ]


def time_features(samples: DataFrame, by: tuple[str, ...] = ("record_id",), rate: float | None = None) -> DataFrame:
    """All time-domain features of each group in one aggregation over one ordering."""
    v = F.col("value")
    order = W.partitionBy(*by).orderBy("sample_index")
    sign = F.when(v != 0, v < 0)
    before = F.last(sign, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    crossed = samples.withColumn("_cross", F.coalesce((sign.isNotNull() & before.isNotNull() & (sign != before)).cast("long"), F.lit(0)))
    n = F.count(F.lit(1))
    crossings = F.when(n > 1, F.sum("_cross") / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0)) * F.lit(1.0 if rate is None else float(rate))
    return crossed.groupBy(*by).agg(
        *basic_aggregates(v),
        X.rms(v).alias("rms"),
        X.crest(v).alias("crest_factor"),
        crossings.alias("zero_crossing_rate"),
        X.skew_corrected(v).alias("skewness"),
        X.kurtosis_corrected(v).alias("kurtosis"),
    )


def segment(samples: DataFrame, window: int, step: int | None = None, include_partial: bool = False) -> DataFrame:
    """Each sample once for every window that holds it: adds window_index, window_start_sample, window_end_sample.

    Windows start every ``step`` samples; partial ones at the end are dropped unless
    asked for, and none follows the first that reaches the end.
    """
    step = window if step is None else step
    if window < 1 or step < 1:
        raise ValueError("window and step must be at least one sample.")
    if step > window:
        raise ValueError("step must not exceed the window.")
    i = F.col("sample_index")
    first = F.greatest(F.lit(0), F.floor((i - window) / F.lit(step)) + 1).cast("long")
    spread = samples.withColumn("window_index", F.explode(F.sequence(first, F.floor(i / F.lit(step)).cast("long"))))
    size = samples.groupBy("record_id").agg((F.max("sample_index") + 1).alias("record_samples"))
    start = F.col("window_index") * step
    out = spread.join(size, "record_id").withColumn("window_start_sample", start)
    out = out.withColumn("window_end_sample", F.least(start + window, F.col("record_samples")))
    if include_partial:
        # the last window is the first one that reaches the end
        keep = (F.col("window_index") == 0) | (start + (window - step) < F.col("record_samples"))
    else:
        keep = start + window <= F.col("record_samples")
    return out.where(keep).drop("record_samples")


def interpolate_missing(samples: DataFrame, max_missing_fraction: float = 1.0) -> DataFrame:
    """Null, NaN and infinite values filled linearly by index; the ends hold the nearest value.

    Adds missing_fraction and status: ok, all_missing or too_many_missing; in the
    last two cases the values stay as they are.
    """
    if not 0 <= max_missing_fraction <= 1:
        raise ValueError("max_missing_fraction must lie between 0 and 1.")
    order = W.partitionBy("record_id").orderBy("sample_index")
    v = X.finite_or_null(F.col("value"))
    at = F.when(v.isNotNull(), F.col("sample_index"))
    back, ahead = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy("record_id")
    known = (
        samples.withColumn("_v0", F.last(v, ignorenulls=True).over(back))
        .withColumn("_i0", F.last(at, ignorenulls=True).over(back))
        .withColumn("_v1", F.first(v, ignorenulls=True).over(ahead))
        .withColumn("_i1", F.first(at, ignorenulls=True).over(ahead))
        .withColumn("missing_fraction", F.lit(1.0) - F.count(v).over(whole) / F.count(F.lit(1)).over(whole))
    )
    gap = F.col("_i1") - F.col("_i0")
    blend = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("sample_index") - F.col("_i0")) / F.when(gap == 0, F.lit(1)).otherwise(gap)
    filled = F.when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull() | (gap == 0), F.col("_v0")).otherwise(blend)
    status = (
        F.when(F.col("missing_fraction") == 1, F.lit("all_missing"))
        .when(F.col("missing_fraction") > max_missing_fraction, F.lit("too_many_missing"))
        .otherwise(F.lit("ok"))
    )
    return (
        known.withColumn("status", status)
        .withColumn("value", F.when(F.col("status") == "ok", filled).otherwise(F.col("value")))
        .drop("_v0", "_i0", "_v1", "_i1")
    )


def apply_window(samples: DataFrame, window: str = "hann", normalize_power: bool = False) -> DataFrame:
    """Values times a periodic taper over the record; optionally over the taper's root mean square."""
    whole = W.partitionBy("record_id")
    sized = samples.withColumn("_n", F.count(F.lit(1)).over(whole))
    weighted = sized.withColumn("_w", X.taper(window, F.col("sample_index"), F.col("_n")))
    scale = F.sqrt(F.avg(F.col("_w") * F.col("_w")).over(whole)) if normalize_power else F.lit(1.0)
    return weighted.withColumn("value", F.col("value") * F.col("_w") / scale).drop("_n", "_w")


def downsample_stride(samples: DataFrame, max_points: int) -> DataFrame:
    """Every k-th sample of a record, k the least that leaves at most max_points."""
    n = F.count(F.lit(1)).over(W.partitionBy("record_id"))
    every = F.ceil(n / F.lit(max_points))
    return samples.withColumn("_k", F.greatest(every, F.lit(1))).where(F.col("sample_index") % F.col("_k") == 0).drop("_k")


def downsample_envelope(samples: DataFrame, max_points: int) -> DataFrame:
    """The least and the largest sample of each of max_points // 2 bins of a record."""
    if max_points < 2:
        raise ValueError("max_points must be at least 2.")
    bins = max(1, max_points // 2)
    n = F.count(F.lit(1)).over(W.partitionBy("record_id"))
    sized = samples.withColumn("_n", n)
    # bin b holds the indices from int(b n / bins) to int((b + 1) n / bins)
    binned = sized.withColumn("_bin", F.floor((F.col("sample_index") * bins + bins - 1) / F.col("_n")).cast("long"))
    some = binned.where(X.is_finite(F.col("value")) & (F.col("_n") > max_points))
    ends = some.groupBy("record_id", "_bin").agg(
        F.min(F.struct("value", "sample_index")).alias("lo"),
        F.min(F.struct((-F.col("value")).alias("value"), "sample_index")).alias("hi"),
    )
    picked = ends.select(
        "record_id",
        F.explode(
            F.array_distinct(
                F.array(
                    F.struct(F.col("lo.sample_index").alias("sample_index"), F.col("lo.value").alias("value")),
                    F.struct(F.col("hi.sample_index").alias("sample_index"), (-F.col("hi.value")).alias("value")),
                )
            )
        ).alias("p"),
    ).select("record_id", "p.sample_index", "p.value")
    short = binned.where(F.col("_n") <= max_points).select("record_id", "sample_index", "value")
    return picked.unionByName(short)


def time_axis(samples: DataFrame, time: Column) -> DataFrame:
    """Diagnostics of a time axis in seconds over its finite times, one row a record."""
    finite = samples.select("record_id", "sample_index", X.finite_or_null(time).alias("t")).where("t is not null")
    step = F.col("t") - F.lag("t").over(W.partitionBy("record_id").orderBy("sample_index"))
    steps = finite.withColumn("d", step)
    base = steps.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_times"),
        F.min_by("t", "sample_index").alias("time_start_seconds"),
        F.max_by("t", "sample_index").alias("time_end_seconds"),
        F.median("d").alias("time_step_median_seconds"),
        F.count(F.when(F.col("d") <= 0, 1)).alias("time_axis_nonmonotonic_count"),
    )
    second = steps.where("d is not null").join(base.select("record_id", "time_step_median_seconds"), "record_id")
    med = F.col("time_step_median_seconds")
    spread = second.groupBy("record_id").agg(
        F.max(F.abs(F.col("d") - med)).alias("_dev"), F.count(F.when(F.col("d") > 1.5 * med, 1)).alias("_gaps")
    )
    valid = (F.col("n_times") >= 2) & (F.col("time_axis_nonmonotonic_count") == 0)
    safe = F.when(valid, med)
    return base.join(spread, "record_id", "left").select(
        "record_id",
        "time_start_seconds",
        "time_end_seconds",
        valid.alias("time_axis_valid"),
        "time_axis_nonmonotonic_count",
        safe.alias("time_step_median_seconds"),
        F.when(valid, F.col("_dev") / med).alias("time_step_jitter_fraction"),
        F.when(valid, F.col("_gaps")).alias("time_gap_count"),
        F.when(valid, F.lit(1.0) / med).alias("inferred_sampling_rate_hz"),
    )


def clipping(samples: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(record_id, clipping_fraction): share of finite samples in runs of two and more at either extreme."""
    finite = samples.where(X.is_finite(F.col("value"))).select("record_id", "sample_index", "value")
    order = W.partitionBy("record_id").orderBy("sample_index")
    whole = W.partitionBy("record_id")
    v = F.col("value")
    marked = (
        finite.withColumn("_lo", F.min(v).over(whole))
        .withColumn("_hi", F.max(v).over(whole))
        .withColumn("_at", F.row_number().over(order))
        .withColumn("up", F.abs(v - F.col("_hi")) <= tolerance)
        .withColumn("down", F.abs(v - F.col("_lo")) <= tolerance)
    )
    for side in ("up", "down"):
        island = F.col("_at") - F.row_number().over(W.partitionBy("record_id", side).orderBy("sample_index"))
        marked = marked.withColumn(f"_{side}_run", island)
        length = F.count(F.lit(1)).over(W.partitionBy("record_id", side, f"_{side}_run"))
        marked = marked.withColumn(f"_{side}", F.col(side) & (length >= 2))
    constant = F.max("_hi") - F.min("_lo") <= tolerance
    share = F.count(F.when(F.col("_up") | F.col("_down"), 1)) / F.count(F.lit(1))
    return marked.groupBy("record_id").agg(F.when(constant, F.lit(0.0)).otherwise(share).alias("clipping_fraction"))


def stationarity(samples: DataFrame, window: int | Column | None = None) -> DataFrame:
    """(record_id, stationarity_mean_drift, stationarity_std_cv) over tumbling windows (default a quarter)."""
    whole = W.partitionBy("record_id")
    v = X.finite_or_null(F.col("value"))
    sized = samples.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_sd", F.stddev_pop(v).over(whole))
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / 4)) if window is None else (window if isinstance(window, Column) else F.lit(window))
    sized = sized.withColumn("_size", size.cast("long")).withColumn("_w", F.floor(F.col("sample_index") / F.col("_size")))
    full = sized.where((F.col("_w") + 1) * F.col("_size") <= F.col("_n"))
    each = full.groupBy("record_id", "_w").agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.first("_sd").alias("_sd")).where("m is not null")
    enough = F.count(F.lit(1)) >= 2
    drift = X.safe_div(F.max("m") - F.min("m"), F.first("_sd"))
    spread = X.safe_div(F.stddev_pop("s"), F.avg("s"))
    return each.groupBy("record_id").agg(
        F.when(enough, drift).otherwise(0.0).alias("stationarity_mean_drift"), F.when(enough, spread).otherwise(0.0).alias("stationarity_std_cv")
    )
