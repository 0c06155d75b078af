"""EEG kernels against sequential and plain definitions."""

import time

import numpy as np
import pytest

from pulsegrid.functions import spectral
from pulsegrid.functions.timecols import SECOND
from pulsegrid.operators import eeg

RATE = 256


def sequential(x, mains=60.0):
    """The recursion sample by sample, of a channel as (seconds, samples)."""
    out, fresh, last = np.full(x.shape, np.nan), True, None
    parts = eeg.sections(RATE, mains)
    state = None
    for s, row in enumerate(x):
        if not np.isfinite(row).any():
            fresh = True
            continue
        if fresh:
            last, state = row[np.isfinite(row)][0], None
        fresh = False
        for k, v in enumerate(row):
            last = v if np.isfinite(v) else last
            y = last
            if state is None:
                state = []
                level = y
                for b, a in parts:
                    gain = b.sum() / a.sum()
                    state.append([gain * level - b[0] * level, b[2] * level - a[2] * gain * level])
                    level *= gain
            for z, (b, a) in zip(state, parts, strict=True):
                v_in, y = y, b[0] * y + z[0]
                z[0], z[1] = b[1] * v_in - a[1] * y + z[1], b[2] * v_in - a[2] * y
            if np.isfinite(v):
                out[s, k] = y
    return out


@pytest.fixture(scope="module")
def signal():
    rng = np.random.default_rng(6)
    t = np.arange(40 * RATE) / RATE
    x = 20 * np.sin(2 * np.pi * 10 * t) + 8 * np.sin(2 * np.pi * 60 * t) + rng.normal(size=len(t)) * 5 + 300 + 2 * t
    x = np.stack([x, x * 0.5 + rng.normal(size=len(t)) * 3, rng.normal(size=len(t)), x]).reshape(4, 40, RATE)
    x[0, 5, 30:60] = x[1, 12:15] = x[0, 20, :1] = x[2, 39, 100:] = x[3, 8, 200:] = np.nan
    return x


def test_filter_equals_the_recursion(signal):
    got = eeg.filtered(signal, RATE, 60.0)
    for c in range(4):
        assert np.allclose(got[c], sequential(signal[c]), atol=1e-9, equal_nan=True)
    whole = got[2][10:39].ravel()
    tone = 50 * np.sin(2 * np.pi * 60 * np.arange(20 * RATE) / RATE).reshape(1, 20, RATE)
    assert np.abs(eeg.filtered(tone, RATE, 60.0)[0, 10:]).max() < 0.05 and whole.std() > 0.3


def table(spark, x, seconds=None):
    rows = [("r", "p", int(s) * SECOND, *[None if k % 3 == 0 and not np.isfinite(x[k, s]).any() else [float(v) if np.isfinite(v) else None for v in x[k, s]] for k in range(4)]) for s in (range(x.shape[1]) if seconds is None else seconds)]
    return spark.createDataFrame(rows, "run_id string, person_id string, canonical_time_ns long, " + ", ".join(f"eeg_{c} array<float>" for c in eeg.CHANNELS)).repartition(3)


def test_blocks_make_no_difference_and_nothing_looks_ahead(spark, signal):
    x = signal.astype(np.float32).astype(float)
    runs = [eeg.kernels(table(spark, x), block=b).toPandas().set_index("canonical_time_ns").sort_index() for b in (7, 1000)]
    cut = eeg.kernels(table(spark, x[:, :26]), block=13).toPandas().set_index("canonical_time_ns").sort_index()
    y = eeg.filtered(x, RATE, 60.0)
    for run in (*runs, cut):
        for s in range(len(run)):
            for k, c in enumerate(eeg.CHANNELS):
                assert np.allclose(np.array(run[f"clean_{c}"][s * SECOND], float), y[k, s], atol=1e-6, equal_nan=True)
                for n in ("sample_entropy", "permutation_entropy"):
                    assert run[f"{c}_{n}"][s * SECOND] == pytest.approx(runs[0][f"{c}_{n}"][s * SECOND], rel=1e-3, nan_ok=True)
    assert len(runs[0]) == 40 and len(cut) == 26


def test_sliding_entropy_equals_the_definition():
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=12 * RATE)).reshape(12, RATE)
    own = np.arange(12)
    got, orders = eeg.sliding_entropies(y, own, 5), eeg.sliding_permutations(y, own, 5)
    for e in own:
        part = y[max(e - 4, 0) : e + 1].ravel()
        assert got[e] == pytest.approx(spectral.sample_entropy(part)) and orders[e] == pytest.approx(spectral.permutation_entropy(part))
    assert np.isnan(eeg.sliding_entropies(np.full((3, RATE), 4.0), np.arange(3), 5)).all()
    gap = y.copy()
    gap[3, 10:40] = np.nan
    found = eeg.sliding_entropies(gap, own, 5)
    x = gap[:5].ravel()
    starts = [i for i in range(len(x) - 2) if np.isfinite(x[i : i + 3]).all()]
    w = np.stack([x[i : i + 3] for i in starts])
    d = np.abs(w[:, None] - w[None]) <= 0.2 * x[np.isfinite(x)].std()
    two, three = d[:, :, :2].all(axis=2), d.all(axis=2)
    assert found[4] == pytest.approx(-np.log((three.sum() - len(w)) / (two.sum() - len(w))))


def test_sliding_entropy_costs_a_tenth():
    y = np.random.default_rng(1).normal(size=(40, RATE))
    began = time.process_time()
    eeg.sliding_entropies(y, np.arange(10, 40), 5)
    sliding = time.process_time() - began
    began = time.process_time()
    for e in range(10, 40):
        spectral.sample_entropy(y[e - 4 : e + 1].ravel())
    assert sliding < 0.4 * (time.process_time() - began)


def test_identical_channels_with_different_gaps(spark, signal):
    x = np.repeat(signal[2:3], 4, axis=0)
    x[:, 39] = signal[3, 39]
    x[0, 20] = x[1, 23] = x[2, 25] = x[3, 28] = np.nan
    found = eeg.pair_tables(table(spark, x), (5, 30), block=11).toPandas()
    assert len(found) == 80
    late = found[found.canonical_time_ns >= 12 * SECOND]
    for c in [n for n in found.columns if n.startswith("eeg_")]:
        assert (late[c].dropna() > 0.99).all() and late[c].notna().mean() > 0.9, c
    own, y = np.arange(40), eeg.filtered(np.repeat(signal[2:3], 2, axis=0), RATE, 60.0)
    y[1][20:24] = np.nan
    same = eeg.pair_features(y[0], np.where(np.isnan(y[1]), np.nan, y[0]), own, (5, 30), RATE)
    for width in (5, 30):
        for n, v in same[width].items():
            assert np.allclose(v[np.isfinite(v)], 1, atol=1e-9), n


def test_pairs_equal_the_definition():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(2, 20, RATE))
    y += 0.8 * x
    got = eeg.pair_features(x, y, np.array([12, 19]), (5, 10), RATE)
    for width in (5, 10):
        for k, e in enumerate((12, 19)):
            a, b = x[e - width + 1 : e + 1].ravel(), y[e - width + 1 : e + 1].ravel()
            for band, lim in spectral.BANDS.items():
                assert got[width][f"coherence_{band}"][k] == pytest.approx(spectral.coherence(a, b, RATE, *lim), abs=1e-9)
            assert got[width]["correlation"][k] == pytest.approx(np.corrcoef(a, b)[0, 1])
    apart = eeg.pair_features(x, rng.normal(size=(20, RATE)), np.array([19]), (20,), RATE)[20]
    assert apart["plv_alpha"][0] < 0.4 and apart["coherence_alpha"][0] < 0.3
