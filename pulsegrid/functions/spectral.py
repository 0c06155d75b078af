"""Signal kernels in numpy, called with Arrow batches where no built-in expression will do."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of the bands in Hz.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 45)}


def welch(x: np.ndarray, rate: float, segment: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: mean periodogram of half-overlapping Hann windows."""
    n = min(len(x), segment or max(int(2 * rate), 8))
    if n < 4:
        return np.zeros(0), np.zeros(0)
    taper = np.hanning(n + 1)[:-1]
    starts = range(0, len(x) - n + 1, max(n // 2, 1))
    parts = np.stack([x[s : s + n] for s in starts])
    parts = (parts - parts.mean(axis=1, keepdims=True)) * taper
    power = (np.abs(np.fft.rfft(parts, axis=1)) ** 2).mean(axis=0) / (rate * (taper**2).sum())
    power[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / rate), power


def band_power(freq: np.ndarray, power: np.ndarray, low: float, high: float) -> float:
    inside = (freq >= low) & (freq < high)
    return float(power[inside].sum() * (freq[1] - freq[0])) if inside.any() else 0.0


def spectral_summary(x: np.ndarray, rate: float, mains: float = 60.0) -> dict[str, float | None]:
    """Band powers, shares, ratios, entropy, edges, aperiodic fit and noise shares of one signal."""
    names = [f"{b}_abs_power" for b in BANDS] + [f"{b}_relative_power" for b in BANDS]
    names += ["theta_beta_ratio", "beta_alpha_ratio", "spectral_entropy", "spectral_edge_95hz", "median_frequency_hz", "dominant_frequency_hz"]
    names += ["aperiodic_exponent", "aperiodic_offset", "line_noise_ratio", "high_freq_artifact_ratio"]
    out: dict[str, float | None] = dict.fromkeys(names)
    freq, power = welch(x[np.isfinite(x)], rate)
    used = (freq >= 1) & (freq < min(45, rate / 2))
    whole = power[freq >= 1].sum()
    if used.sum() < 2 or power[used].sum() <= 0:
        return out
    absolute = {b: band_power(freq, power, *lim) for b, lim in BANDS.items()}
    total = sum(absolute.values())
    out |= {f"{b}_abs_power": v for b, v in absolute.items()}
    out |= {f"{b}_relative_power": v / total if total else None for b, v in absolute.items()}
    out["theta_beta_ratio"] = absolute["theta"] / absolute["beta"] if absolute["beta"] else None
    out["beta_alpha_ratio"] = absolute["beta"] / absolute["alpha"] if absolute["alpha"] else None
    p = power[used] / power[used].sum()
    f = freq[used]
    out["spectral_entropy"] = float(-(p[p > 0] * np.log(p[p > 0])).sum() / np.log(len(p)))
    upto = np.cumsum(p)
    out["spectral_edge_95hz"] = float(f[min(np.searchsorted(upto, 0.95), len(f) - 1)])
    out["median_frequency_hz"] = float(f[min(np.searchsorted(upto, 0.5), len(f) - 1)])
    out["dominant_frequency_hz"] = float(f[p.argmax()])
    slope, offset = np.polyfit(np.log10(f), np.log10(np.maximum(power[used], 1e-30)), 1)
    out["aperiodic_exponent"], out["aperiodic_offset"] = float(-slope), float(offset)
    out["line_noise_ratio"] = float(power[np.abs(freq - mains) <= 1].sum() / whole)
    out["high_freq_artifact_ratio"] = float(power[freq > 30].sum() / whole)
    return out


def coherence(x: np.ndarray, y: np.ndarray, rate: float, low: float, high: float) -> float | None:
    """Mean squared coherence over a band, from half-overlapping Hann segments of a second."""
    n = int(rate)
    if len(x) < 2 * n or len(x) != len(y):
        return None
    taper = np.hanning(n + 1)[:-1]
    cut = lambda v: np.fft.rfft(np.stack([(v[s : s + n] - v[s : s + n].mean()) * taper for s in range(0, len(v) - n + 1, n // 2)]), axis=1)
    a, b = cut(x), cut(y)
    cross = np.abs((a * b.conj()).mean(axis=0)) ** 2
    own = (np.abs(a) ** 2).mean(axis=0) * (np.abs(b) ** 2).mean(axis=0)
    freq = np.fft.rfftfreq(n, 1 / rate)
    inside = (freq >= low) & (freq < high) & (own > 0)
    return float((cross[inside] / own[inside]).mean()) if inside.any() else None


def analytic(x: np.ndarray) -> np.ndarray:
    n = len(x)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * weight)


def band_pass(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    spectrum, freq = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / rate)
    spectrum[(freq < low) | (freq >= high)] = 0
    return np.fft.irfft(spectrum, len(x))


def phase_locking(x: np.ndarray, y: np.ndarray, rate: float, low: float, high: float) -> float | None:
    if len(x) < 2 * int(rate) or len(x) != len(y):
        return None
    a, b = (np.angle(analytic(band_pass(v - v.mean(), rate, low, high))) for v in (x, y))
    return float(np.abs(np.exp(1j * (a - b)).mean()))


def sample_entropy(x: np.ndarray, m: int = 2, tolerance: float = 0.2) -> float | None:
    """-ln of the share of m-long matches that go on for one more; null if it can't be formed.

    Up to 2,048 samples are compared at once (4 MB); beyond, rows of comparisons are made one lag at a time, so
    memory stays linear.
    """
    n, r = len(x), tolerance * x.std()
    if n < m + 2 or r == 0:
        return None
    short = long = 0
    if n <= 2048:
        near = np.abs(np.subtract.outer(x, x)) <= r
        start = near[: n - m, : n - m].copy()
        for k in range(1, m):
            start &= near[k : n - m + k, k : n - m + k]
        short = (int(start.sum()) - (n - m)) // 2  # each pair once, none with itself
        start &= near[m:, m:]
        long = (int(start.sum()) - (n - m)) // 2
        return float(-np.log(long / short)) if short and long else None
    short = long = 0
    for lag in range(1, n - m):
        step = np.abs(x[lag:] - x[:-lag]) <= r
        run = np.lib.stride_tricks.sliding_window_view(step, m).all(axis=1)[: n - m - lag]
        short += int(run.sum())
        long += int((run & step[m : m + len(run)]).sum())
    return float(-np.log(long / short)) if short and long else None


def permutation_entropy(x: np.ndarray, order: int = 3) -> float | None:
    if len(x) < order + 1:
        return None
    ranks = np.argsort(np.lib.stride_tricks.sliding_window_view(x, order), axis=1, kind="stable")
    _, n = np.unique(ranks @ (order ** np.arange(order)), return_counts=True)
    p = n / n.sum()
    from math import factorial

    return float(-(p * np.log(p)).sum() / np.log(factorial(order)))


def autocorrelation_peak(x: np.ndarray, rate: float, low: float = 0.5, high: float = 5.0) -> tuple[float | None, float | None]:
    """Highest autocorrelation at a lag of ``low`` to ``high`` Hz, and that frequency."""
    x = x - x.mean()
    first, last = max(int(rate / high), 1), min(int(rate / low), len(x) - 2)
    if last <= first or not (x @ x):
        return None, None
    size = 1 << (2 * len(x) - 1).bit_length()
    c = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[: len(x)]
    c = c / c[0]
    k = first + int(c[first : last + 1].argmax())
    return float(c[k]), rate / k


def harmonic_sums(t: np.ndarray, y: np.ndarray, first: float, step: float, n: int) -> np.ndarray:
    """sum of y exp(-2 pi i f t) at ``n`` frequencies f = first + k step.

    Times of whole seconds lie on a grid, where a chirp transform gives all sums in two transforms of the length of
    both together (jk = (j^2 + k^2 - (k - j)^2) / 2); other times are summed as they are.
    """
    if not np.array_equal(t, np.floor(t)):
        return np.exp(-2j * np.pi * (first + step * np.arange(n))[:, None] * t[None, :]) @ y
    at = (t - t.min()).astype(int)
    grid = np.zeros(at.max() + 1, complex)
    np.add.at(grid, at, y)
    j = np.arange(max(len(grid), n), dtype=float)
    chirp = np.exp(-1j * np.pi * np.mod(step * j * j, 2))
    size = 1 << (len(grid) + n - 1).bit_length()
    kernel = np.zeros(size, complex)
    kernel[:n] = chirp[:n].conj()
    kernel[size - len(grid) + 1 :] = chirp[1 : len(grid)].conj()[::-1]
    tuned = grid * np.exp(-2j * np.pi * first * np.arange(len(grid))) * chirp[: len(grid)]
    out = np.fft.ifft(np.fft.fft(tuned, size) * np.fft.fft(kernel))[:n] * chirp[:n]
    return out * np.exp(-2j * np.pi * (first + step * np.arange(n)) * t.min())


def lomb_scargle(t: np.ndarray, y: np.ndarray, first: float, step: float, n: int) -> np.ndarray:
    """Power at ``n`` frequencies of values at uneven times, each with the time shift that makes its sine and cosine orthogonal.

    A sinusoid has its variance at its frequency.
    """
    t = t - t[0]
    values, twice = harmonic_sums(t, y - y.mean(), first, step, n), harmonic_sums(t, np.ones(len(t)), 2 * first, 2 * step, n)
    size = np.abs(twice)
    turned = values * np.exp(-0.5j * np.angle(twice))  # exp(i w tau), for tan(2 w tau) = sum of sines / sum of cosines at 2 w
    cosines, sines = (len(t) + size) / 2, (len(t) - size) / 2
    return (turned.real**2 / cosines + np.where(sines > 1e-9 * len(t), turned.imag**2 / np.maximum(sines, 1e-300), 0)) / len(t)


def lomb_powers(times_s: np.ndarray, rr_ms: np.ndarray) -> tuple[float, float, float] | None:
    """VLF, LF and HF power (0.003-0.04, 0.04-0.15, 0.15-0.4 Hz) of unevenly spaced RR intervals."""
    if len(rr_ms) < 30 or times_s[-1] - times_s[0] < 240:
        return None
    freq = np.arange(0.003, 0.4, 1 / (times_s[-1] - times_s[0]))
    power = lomb_scargle(times_s, rr_ms, 0.003, 1 / (times_s[-1] - times_s[0]), len(freq))
    return tuple(float(power[(freq >= a) & (freq < b)].sum()) for a, b in ((0.003, 0.04), (0.04, 0.15), (0.15, 0.4)))


SUMMARY_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in spectral_summary(np.zeros(0), 256.0)])


def spectral_summaries(x: np.ndarray, rate: float, mains: float = 60.0) -> dict[str, np.ndarray]:
    """``spectral_summary`` of each row of a matrix of samples at once; NaN where a value can't be formed."""
    rows, n = x.shape
    out = {name: np.full(rows, np.nan) for name in SUMMARY_TYPE.names}
    size = min(n, max(int(2 * rate), 8))
    if size < 4:
        return out
    taper = np.hanning(size + 1)[:-1]
    starts = range(0, n - size + 1, max(size // 2, 1))
    power = np.zeros((rows, size // 2 + 1))
    for s in starts:
        part = x[:, s : s + size]
        power += np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2
    power /= len(starts) * rate * (taper**2).sum()
    power[:, 1 : -1 if size % 2 == 0 else None] *= 2
    freq = np.fft.rfftfreq(size, 1 / rate)
    used = (freq >= 1) & (freq < min(45, rate / 2))
    if used.sum() < 2:
        return out
    ok = power[:, used].sum(axis=1) > 0
    power, f = power[ok], freq[used]
    whole = power[:, freq >= 1].sum(axis=1)
    bands = {b: power[:, (freq >= lo) & (freq < hi)].sum(axis=1) * (freq[1] - freq[0]) for b, (lo, hi) in BANDS.items()}
    total = sum(bands.values())
    ratio = lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)
    p = power[:, used] / power[:, used].sum(axis=1, keepdims=True)
    upto = np.cumsum(p, axis=1)
    edge = lambda share: f[np.minimum((upto < share).sum(axis=1), len(f) - 1)]
    logs = np.log10(np.maximum(power[:, used], 1e-30))
    u = np.log10(f) - np.log10(f).mean()
    slope = logs @ u / (u @ u)
    values = {f"{b}_abs_power": v for b, v in bands.items()} | {f"{b}_relative_power": ratio(v, total) for b, v in bands.items()}
    values |= {
        "theta_beta_ratio": ratio(bands["theta"], bands["beta"]), "beta_alpha_ratio": ratio(bands["beta"], bands["alpha"]), "spectral_entropy": -np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0).sum(axis=1) / np.log(len(f)),
        "spectral_edge_95hz": edge(0.95), "median_frequency_hz": edge(0.5), "dominant_frequency_hz": f[p.argmax(axis=1)], "aperiodic_exponent": -slope, "aperiodic_offset": logs.mean(axis=1) - slope * np.log10(f).mean(),
        "line_noise_ratio": power[:, np.abs(freq - mains) <= 1].sum(axis=1) / whole, "high_freq_artifact_ratio": power[:, freq > 30].sum(axis=1) / whole,
    }
    for name, v in values.items():
        out[name][ok] = v
    return out


def summary_udf(rate: float, mains: float = 60.0):
    """Column function: spectral summary of an array of samples; arrays of one length are worked on together."""

    @F.pandas_udf(SUMMARY_TYPE)
    def run(x: pd.Series) -> pd.DataFrame:
        values = [np.zeros(0) if v is None else np.asarray(v, float) for v in x]
        values = [v[np.isfinite(v)] for v in values]
        sizes = np.array([len(v) for v in values], int)
        out = {n: np.full(len(values), np.nan) for n in SUMMARY_TYPE.names}
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for name, column in spectral_summaries(np.stack([values[i] for i in rows]), rate, mains).items():
                out[name][rows] = column
        return pd.DataFrame(out, columns=SUMMARY_TYPE.names)

    return run


def entropy_udf():
    @F.pandas_udf("sample_entropy double, permutation_entropy double")
    def run(x: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if v is None else (sample_entropy(np.asarray(v, float)), permutation_entropy(np.asarray(v, float))) for v in x]
        return pd.DataFrame(rows, columns=["sample_entropy", "permutation_entropy"]).astype(float)

    return run


def periodicity_udf(rate: float):
    @F.pandas_udf("autocorr_peak double, autocorr_hz double")
    def run(x: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if v is None or len(v) < 4 else autocorrelation_peak(np.asarray(v, float), rate) for v in x]
        return pd.DataFrame(rows, columns=["autocorr_peak", "autocorr_hz"]).astype(float)

    return run


def hrv_udf():
    """Column function of times (s) and RR intervals (ms): VLF, LF and HF power, and sample entropy."""

    @F.pandas_udf("hrv_vlf_power double, hrv_lf_power double, hrv_hf_power double, rr_sample_entropy double")
    def run(at: pd.Series, rr: pd.Series) -> pd.DataFrame:
        rows = []
        for t, x in zip(at, rr, strict=True):
            t, x = np.asarray(t, float), np.asarray(x, float)
            powers = lomb_powers(t, x) or (None, None, None)
            rows.append((*powers, sample_entropy(x) if len(x) >= 150 else None))
        return pd.DataFrame(rows, columns=["hrv_vlf_power", "hrv_lf_power", "hrv_hf_power", "rr_sample_entropy"]).astype(float)

    return run
