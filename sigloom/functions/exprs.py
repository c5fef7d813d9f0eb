"""Pure column expressions; everything here stays inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOWS = ("rectangular", "hann", "hamming", "blackman", "bartlett")


def is_finite(v: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def finite_or_null(v: Column) -> Column:
    return F.when(is_finite(v), v)


def safe_div(a: Column, b: Column, other: float | None = 0.0) -> Column:
    """a / b, and ``other`` where b is 0."""
    return F.when(b == 0, F.lit(other).cast("double")).otherwise(a / b)


def seconds_to_samples(seconds: float | Column, rate: float | Column) -> Column:
    """At least one sample; halves go to the even number."""
    s = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return F.greatest(F.lit(1), F.rint(s * r)).cast("long")


def decibels(power: Column, floor: float = 1e-24) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(power, F.lit(floor)))


def rms(v: Column) -> Column:
    return F.sqrt(F.avg(v * v))


def crest(v: Column) -> Column:
    level = rms(v)
    return F.when(level == 0, F.lit(0.0)).otherwise(F.max(F.abs(v)) / F.when(level == 0, F.lit(1.0)).otherwise(level))


def skew_corrected(v: Column) -> Column:
    """Bias-corrected skewness; 0 for constant values, uncorrected below three."""
    n = F.count(v).cast("double")
    g = F.skewness(v)
    fixed = F.when(n > 2, g * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0))).otherwise(g)
    return F.when(F.min(v) == F.max(v), F.lit(0.0)).otherwise(fixed)


def kurtosis_corrected(v: Column) -> Column:
    """Bias-corrected Pearson kurtosis (3 for a normal law); 0 for constant values."""
    n = F.count(v).cast("double")
    k = F.kurtosis(v)
    base = F.greatest((n - 2) * (n - 3), F.lit(1.0))
    fixed = F.when(n > 3, ((n * n - 1) * (k + 3) - 3 * (n - 1) * (n - 1)) / base + 3).otherwise(k + 3)
    return F.when(F.min(v) == F.max(v), F.lit(0.0)).otherwise(fixed)


def taper(kind: str, i: Column, n: Column, periodic: bool = True) -> Column:
    """Window weight i of n: periodic for spectra, symmetric for generated windows."""
    if kind not in WINDOWS and kind != "boxcar":
        raise ValueError(f"Unsupported window '{kind}'.")
    if kind in ("rectangular", "boxcar"):
        return F.lit(1.0)
    span = n.cast("double") if periodic else (n - 1).cast("double")
    x = F.when(span == 0, F.lit(0.0)).otherwise(i / F.when(span == 0, F.lit(1.0)).otherwise(span))
    angle = F.lit(2.0 * math.pi) * x
    weight = {
        "hann": F.lit(0.5) - F.lit(0.5) * F.cos(angle),
        "hamming": F.lit(0.54) - F.lit(0.46) * F.cos(angle),
        "blackman": F.lit(0.42) - F.lit(0.5) * F.cos(angle) + F.lit(0.08) * F.cos(F.lit(2.0) * angle),
        "bartlett": F.lit(1.0) - F.abs(F.lit(2.0) * x - F.lit(1.0)),
    }[kind]
    return F.when(n == 1, F.lit(1.0)).otherwise(weight)


def sinc(x: Column) -> Column:
    a = F.lit(math.pi) * x
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(a) / F.when(x == 0, F.lit(1.0)).otherwise(a))
