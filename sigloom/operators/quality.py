"""The signal quality table: 24 columns, one row a record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import exprs as X
from sigloom.operators import samples as S

COLUMNS = (
    "record_name label n_samples sampling_rate_hz duration_seconds missing_fraction has_missing_values max_abs_amplitude mean std rms "
    "clipping_fraction is_clipped is_near_constant has_large_amplitude stationarity_mean_drift stationarity_std_cv is_likely_nonstationary "
    "time_step_jitter_fraction time_gap_count has_time_axis_irregularity sampling_rate_mismatch_fraction has_sampling_rate_mismatch issues"
).split()


@dataclass(frozen=True)
class QualityConfig:
    min_duration_seconds: float | None = None
    clipping_fraction_threshold: float = 0.01
    clipping_tolerance: float = 1e-9
    near_constant_std_threshold: float = 1e-12
    large_amplitude_threshold: float | None = None
    stationarity_window_seconds: float | None = None
    stationarity_mean_drift_threshold: float = 0.25
    stationarity_std_cv_threshold: float = 0.5
    time_step_jitter_threshold: float = 0.01
    time_gap_count_threshold: int = 0
    sampling_rate_mismatch_threshold: float = 0.01

    def __post_init__(self) -> None:
        for name in ("min_duration_seconds", "large_amplitude_threshold", "stationarity_window_seconds"):
            if getattr(self, name) is not None and getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive.")
        if not 0 <= self.clipping_fraction_threshold <= 1:
            raise ValueError("clipping_fraction_threshold must lie between 0 and 1.")
        for name in self.__dataclass_fields__:
            value = getattr(self, name)
            if value is not None and value < 0:
                raise ValueError(f"{name}: a threshold cannot be below 0.")


def quality_table(samples: DataFrame, records: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Quality of ``samples`` (long form) for ``records(record_id, record_name, label, sampling_rate_hz)``.

    ``records`` may carry the acquisition facts time_step_jitter_fraction,
    time_gap_count, time_axis_valid and sampling_rate_mismatch_fraction; what is
    missing counts as 0.  A record whose samples are all missing has null
    statistics.
    """
    v = X.finite_or_null(F.col("value"))
    base = samples.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count(v).alias("_finite"),
        F.max(F.abs(v)).alias("max_abs_amplitude"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        X.rms(v).alias("rms"),
    )
    window = None
    if config.stationarity_window_seconds:
        # each record's own rate says how many samples a window has
        window = X.seconds_to_samples(config.stationarity_window_seconds, F.col("sampling_rate_hz"))
        steady = S.stationarity(samples.join(records.select("record_id", "sampling_rate_hz"), "record_id"), window)
    else:
        steady = S.stationarity(samples)
    have = set(records.columns)
    fact = lambda name, kind: F.coalesce(F.col(name).try_cast(kind), F.lit(0).cast(kind)) if name in have else F.lit(0).cast(kind)
    out = (
        records.join(base, "record_id")
        .join(S.clipping(samples, config.clipping_tolerance), "record_id", "left")
        .join(steady, "record_id", "left")
        .withColumn("clipping_fraction", F.coalesce("clipping_fraction", F.lit(0.0)))
        .withColumn("duration_seconds", F.col("n_samples") / F.col("sampling_rate_hz"))
        .withColumn("missing_fraction", F.lit(1.0) - F.col("_finite") / F.col("n_samples"))
        .withColumn("has_missing_values", F.col("_finite") < F.col("n_samples"))
        .withColumn("is_clipped", F.col("clipping_fraction") >= config.clipping_fraction_threshold)
        .withColumn("is_near_constant", F.coalesce(F.col("std") <= config.near_constant_std_threshold, F.lit(False)))
        .withColumn("has_large_amplitude", _above("max_abs_amplitude", config.large_amplitude_threshold))
        .withColumn(
            "is_likely_nonstationary",
            _above("stationarity_mean_drift", config.stationarity_mean_drift_threshold)
            | _above("stationarity_std_cv", config.stationarity_std_cv_threshold),
        )
        .withColumn("time_step_jitter_fraction", fact("time_step_jitter_fraction", "double"))
        .withColumn("time_gap_count", fact("time_gap_count", "long"))
        .withColumn("sampling_rate_mismatch_fraction", fact("sampling_rate_mismatch_fraction", "double"))
    )
    invalid = F.coalesce(~F.col("time_axis_valid"), F.lit(False)) if "time_axis_valid" in have else F.lit(False)
    out = out.withColumn(
        "has_time_axis_irregularity",
        invalid
        | (F.col("time_step_jitter_fraction") > config.time_step_jitter_threshold)
        | (F.col("time_gap_count") > config.time_gap_count_threshold),
    ).withColumn("has_sampling_rate_mismatch", F.col("sampling_rate_mismatch_fraction") > config.sampling_rate_mismatch_threshold)
    short = F.lit(False) if config.min_duration_seconds is None else F.col("duration_seconds") < config.min_duration_seconds
    codes = [
        (short, "duration_below_minimum"),
        (F.col("has_missing_values"), "missing_values"),
        (F.col("_finite") == 0, "all_values_missing"),
        (F.col("is_clipped"), "possible_clipping"),
        (F.col("is_near_constant"), "near_constant"),
        (F.col("has_large_amplitude"), "large_amplitude"),
        (F.col("is_likely_nonstationary"), "nonstationarity_indicator"),
        (F.col("has_time_axis_irregularity"), "time_axis_irregularity"),
        (F.col("has_sampling_rate_mismatch"), "sampling_rate_mismatch"),
    ]
    issues = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in codes])), "; ")
    return out.withColumn("issues", issues).select("record_id", *COLUMNS)


def _above(name: str, limit: float | None):
    return F.lit(False) if limit is None else F.coalesce(F.col(name) > limit, F.lit(False))


def issue_counts(table: DataFrame) -> DataFrame:
    """(issue, n): how many records have each issue, most frequent first."""
    each = table.select(F.explode(F.split("issues", "; ")).alias("issue")).where("issue <> ''")
    return each.groupBy("issue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue")
