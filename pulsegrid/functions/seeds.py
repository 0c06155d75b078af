"""Random values as pure functions of a named seed and a counter.

Nothing here depends on partitioning, row order or earlier draws: a value is the hash of its name.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tries of a rejection draw; the chance that all fail is below 1e-9 for the distributions in use.
TRIES = 24


def child_seed(*names: Column | str | int) -> Column:
    """60-bit seed of a path of names: the first 15 hex digits of its SHA-256."""
    parts = [n.cast("string") if isinstance(n, Column) else F.lit(str(n)) for n in names]
    return F.conv(F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 15), 16, 10).cast("long")


def child_seed_value(*names: object) -> int:
    """The same seed on the driver."""
    return int(hashlib.sha256("/".join(map(str, names)).encode()).hexdigest()[:15], 16)


def uniform(seed: Column, counter: Column | str | int) -> Column:
    """In [0, 1), from 52 bits of the hash of seed and counter."""
    k = counter.cast("string") if isinstance(counter, Column) else F.lit(str(counter))
    bits = F.conv(F.substring(F.sha2(F.concat_ws("/", seed.cast("string"), k), 256), 1, 13), 16, 10).cast("long")
    return bits.cast("double") / F.lit(float(1 << 52))


def fast_uniform(seed: Column, counter: Column) -> Column:
    """In [0, 1), from XXH64; for sample-rate streams, where a digest for each sample would cost too much."""
    return F.shiftrightunsigned(F.xxhash64(seed, counter), 11).cast("double") / F.lit(float(1 << 53))


def normal(seed: Column, counter: Column | str | int) -> Column:
    """Standard normal by Box and Muller."""
    name = counter if isinstance(counter, Column) else F.lit(str(counter))
    u, v = uniform(seed, F.concat(name.cast("string"), F.lit("a"))), uniform(seed, F.concat(name.cast("string"), F.lit("b")))
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


def fast_normal(seed: Column, counter: Column) -> Column:
    u, v = fast_uniform(seed, counter * 2), fast_uniform(seed, counter * 2 + 1)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


def truncated_normal(seed: Column, name: str, mean: float | Column, std: float, low: float, high: float) -> Column:
    """The first of a fixed series of normal draws that falls in range; clamped if none does."""
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    draws = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda k: mean + F.lit(float(std)) * normal(seed, F.concat(F.lit(f"{name}/"), k.cast("string"))))
    inside = F.filter(draws, lambda x: x.between(low, high))
    return F.coalesce(F.try_element_at(inside, F.lit(1)), F.least(F.greatest(mean, F.lit(float(low))), F.lit(float(high))))


def lognormal(seed: Column, name: str, median: float, geometric_std: float) -> Column:
    return F.lit(float(median)) * F.exp(F.lit(math.log(geometric_std)) * normal(seed, name))


def gamma(seed: Column, name: str, shape: float) -> Column:
    """Unit-scale gamma by Marsaglia and Tsang: the first accepted of a series of draws.

    Shapes below 1 are drawn one higher and scaled by a power of another uniform.
    """
    if shape <= 0:
        raise ValueError("shape must be above 0")
    if shape < 1:
        return gamma(seed, name, shape + 1) * F.pow(F.lit(1.0) - uniform(seed, f"{name}/less"), F.lit(1 / shape))
    d = shape - 1 / 3
    c = 1 / math.sqrt(9 * d)

    def attempt(k: Column) -> Column:
        key = F.concat(F.lit(f"{name}/"), k.cast("string"))
        z, u = normal(seed, key), uniform(seed, F.concat(key, F.lit("u")))
        v = F.pow(F.lit(1.0) + F.lit(c) * z, F.lit(3.0))
        ok = (v > 0) & (F.log(F.lit(1.0) - u) < F.lit(0.5) * z * z + F.lit(d) - F.lit(d) * v + F.lit(d) * F.log(F.greatest(v, F.lit(1e-300))))
        return F.when(ok, F.lit(d) * v)

    tries = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), attempt)
    return F.coalesce(F.try_element_at(F.array_compact(tries), F.lit(1)), F.lit(d))


def beta(seed: Column, name: str, a: float, b: float) -> Column:
    x, y = gamma(seed, f"{name}/x", a), gamma(seed, f"{name}/y", b)
    return x / (x + y)


def discrete_uniform(seed: Column, name: str | Column, low: int | Column, high: int | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (low + F.floor(uniform(seed, name) * (high - low + 1))).cast("long")


def uniform_range(seed: Column, name: str | Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + uniform(seed, name) * F.lit(float(high - low))


def categorical(seed: Column, name: str | Column, weights: dict[str, float]) -> Column:
    """A key, drawn by weight."""
    u, total, upto, out = uniform(seed, name), sum(weights.values()), 0.0, None
    for key, w in weights.items():
        upto += w / total
        out = F.when(u < upto, F.lit(key)) if out is None else out.when(u < upto, F.lit(key))
    return out.otherwise(F.lit(list(weights)[-1]))


def correlated(normals: list[Column], covariance: list[list[float]]) -> list[Column]:
    """Linear combinations of independent normals with the given covariance (its Cholesky factor, as literals)."""
    import numpy as np

    factor = np.linalg.cholesky(np.array(covariance, float))
    return [sum((F.lit(float(factor[i, j])) * normals[j] for j in range(i + 1)), F.lit(0.0)) for i in range(len(normals))]


def value_noise(seed: Column, name: str, t: Column, period: int) -> Column:
    """Smooth noise in [0, 1]: hashed values at every ``period``, joined by smoothstep.  ``t`` is a long."""
    p = F.lit(period).cast("long")
    knot = F.call_function("div", t - F.pmod(t, p), p)
    x = F.pmod(t, p) / F.lit(float(period))
    s = x * x * (F.lit(3.0) - F.lit(2.0) * x)
    at = lambda k: F.shiftrightunsigned(F.xxhash64(seed, F.lit(name), k), 11).cast("double") / F.lit(float(1 << 53))
    return at(knot) + (at(knot + 1) - at(knot)) * s
