"""Shapes of event phases: functions of the elapsed share of a phase, 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smoothstep(x: Column) -> Column:
    return x * x * (F.lit(3.0) - F.lit(2.0) * x)


def exponential_rise(x: Column, rate: float = 3.0) -> Column:
    return (F.exp(F.lit(rate) * x) - 1) / (F.exp(F.lit(rate)) - 1)


def sigmoid(x: Column, steepness: float = 10.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-steepness) * (x - F.lit(0.5))))


def plateau(x: Column, swing: float = 0.05) -> Column:
    return F.lit(1.0 - swing) + F.lit(swing) * F.cos(F.lit(6.283185307179586) * x)


def biexponential_decay(x: Column, fast: float = 4.0, slow: float = 1.0, share: float = 0.7) -> Column:
    return F.lit(share) * F.exp(F.lit(-fast) * x) + F.lit(1 - share) * F.exp(F.lit(-slow) * x)


def slow_decay(x: Column, rate: float = 2.0) -> Column:
    return F.exp(F.lit(-rate) * x)
