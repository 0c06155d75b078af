"""Waveform features of one array of samples, as array expressions inside the JVM.

Arrays of fewer samples than a feature needs give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def differences(x: Column) -> Column:
    return F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda b, a: b.cast("double") - a.cast("double"))


def variance(x: Column) -> Column:
    """Population variance."""
    sums = F.aggregate(
        x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, v: F.struct((a["s"] + v.cast("double")).alias("s"), (a["q"] + v.cast("double") * v.cast("double")).alias("q")),
    )
    n = F.size(x)
    return F.when(n > 0, F.greatest(sums["q"] / n - (sums["s"] / n) * (sums["s"] / n), F.lit(0.0)))


def slope(t: Column, x: Column) -> Column:
    """Least-squares slope of ``x`` over ``t``, arrays of one length."""
    both = F.aggregate(F.zip_with(t, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    n = F.size(x)
    return F.try_divide(both / n - mean(t) * mean(x), F.nullif(variance(t), F.lit(0.0)))


def rms(x: Column) -> Column:
    return F.sqrt(F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")), F.size(x)))


def peak_to_peak(x: Column) -> Column:
    return F.array_max(x).cast("double") - F.array_min(x).cast("double")


def line_length(x: Column) -> Column:
    return F.when(F.size(x) > 1, F.aggregate(differences(x), F.lit(0.0), lambda a, d: a + F.abs(d)))


def zero_crossing_rate(x: Column) -> Column:
    signs = F.transform(x, lambda v: F.signum(v.cast("double")))
    flips = F.aggregate(differences(signs), F.lit(0.0), lambda a, d: a + F.when(d != 0, 1.0).otherwise(0.0))
    return F.when(F.size(x) > 1, flips / (F.size(x) - 1))


def hjorth_mobility(x: Column) -> Column:
    return F.sqrt(F.try_divide(variance(differences(x)), F.nullif(variance(x), F.lit(0.0))))


def hjorth_complexity(x: Column) -> Column:
    return F.try_divide(hjorth_mobility(differences(x)), F.nullif(hjorth_mobility(x), F.lit(0.0)))


def share(x: Column, test) -> Column:
    """Share of the samples that meet ``test``."""
    return F.try_divide(F.size(F.filter(x, test)).cast("double"), F.size(x))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of two arrays of one length; null where either doesn't vary."""
    product = F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    n = F.size(x)
    covariance = F.try_divide(product, n) - mean(x) * mean(y)
    return F.when((n > 1) & (n == F.size(y)), F.try_divide(covariance, F.nullif(F.sqrt(variance(x) * variance(y)), F.lit(0.0))))
