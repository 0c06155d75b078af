"""EEG at every second: causal filters, sliding entropies, and features of pairs of channels over any windows.

Seconds of a person are dealt in blocks of time with a halo, so a person with a third of all rows is many tasks, and
each task works on one block at a time as matrices of (seconds, samples).

* **Filters** (notch, high and low pass, in the order of the specification) are recurrences of two states each.  All
  seconds of a block are filtered side by side from rest; the state at each second's start then follows from the one
  before it by one affine map, and what it adds is a product.  A block starts ``SETTLE`` seconds early, by which time
  nothing of its start is left, so results don't depend on blocks; no sample after a row is used.  Missing samples hold
  the last one and stay missing; after a second without any sample a filter starts anew, at rest at the first value.
* **Sample entropy** of the trailing window: each pair of seconds is compared once, for all windows that hold both, so a
  window moved by a second costs the pairs of that second only.
* **Pairs** use the samples that both channels have, save two seconds after a filter's start.  Spectra of half-overlapping segments of a second, moments and phase
  differences are summed by second and added up over windows of any width.

Defined cases: an array of another length counts as missing, and of repeated rows of a second one is used; templates,
segments and moments leave missing samples out and never close a gap; what can't be formed is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.spectral import BANDS
from pulsegrid.functions.timecols import SECOND, floor_div
from pulsegrid.operators.windows import tasks_of

KEYS, T = ["run_id", "person_id"], "canonical_time_ns"
CHANNELS = ("tp9", "af7", "af8", "tp10")
PAIRS = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1 :]]
#: Seconds after which nothing is left of a filter's start (e^-44 of it at 1 Hz), and seconds of a block.
SETTLE, BLOCK = 10, 600
#: Width of the notch, and limits of the pass band, in Hz.
NOTCH_HZ, LOW_HZ, HIGH_HZ = 2.0, 1.0, 45.0


def sections(rate: float, mains: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numerator, denominator) of the notch, and of second-order Butterworth high and low passes (bilinear transform)."""
    out = []
    for kind, hz, q in (("notch", mains, mains / NOTCH_HZ), ("high", LOW_HZ, 0.5**0.5), ("low", HIGH_HZ, 0.5**0.5)):
        if hz < rate / 2:
            w = 2 * np.pi * hz / rate
            c, s = np.cos(w), np.sin(w) / (2 * q)
            b = {"notch": [1, -2 * c, 1], "high": [(1 + c) / 2, -(1 + c), (1 + c) / 2], "low": [(1 - c) / 2, 1 - c, (1 - c) / 2]}[kind]
            out.append((np.array(b) / (1 + s), np.array([1, -2 * c / (1 + s), (1 - s) / (1 + s)])))
    return out


def filtered(x: np.ndarray, rate: float, mains: float) -> np.ndarray:
    """The causal filters over (channels, seconds, samples), NaN where samples are missing."""
    there = np.isfinite(x)
    some = there.any(axis=2)
    fresh = some & ~np.concatenate([np.zeros((len(x), 1), bool), some[:, :-1]], axis=1)
    flat, known = x.reshape(len(x), -1), there.reshape(len(x), -1)
    last = np.maximum.accumulate(np.where(known, np.arange(flat.shape[1]), -1), axis=1)
    ahead = np.minimum.accumulate(np.where(known, np.arange(flat.shape[1]), flat.shape[1] - 1)[:, ::-1], axis=1)[:, ::-1]
    begun = np.repeat(fresh, x.shape[2], axis=1) & (np.maximum.accumulate(np.where(np.repeat(fresh, x.shape[2], axis=1) & known, np.arange(flat.shape[1]), -1), axis=1) < np.repeat(np.arange(x.shape[1]) * x.shape[2], x.shape[2]))
    held = np.take_along_axis(flat, np.where(begun, ahead, np.maximum(last, 0)), axis=1)  # a fresh second is at rest at its first value
    y = np.nan_to_num(held).reshape(x.shape)
    for b, a in sections(rate, mains):
        y = _recurrence(y, b, a, fresh)
    return np.where(there, y, np.nan)


def _recurrence(x: np.ndarray, b: np.ndarray, a: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    channels, seconds, n = x.shape
    across = np.ascontiguousarray(x.reshape(-1, n).T)
    out, one, two = np.empty_like(across), np.zeros(across.shape[1]), np.zeros(across.shape[1])
    for k in range(n):  # all seconds of all channels step together, from rest
        v = across[k]
        y = b[0] * v + one
        one = b[1] * v - a[1] * y + two
        two = b[2] * v - a[2] * y
        out[k] = y
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    seen, power = np.empty((n, 2)), np.eye(2)
    for k in range(n):
        seen[k] = power[0]
        power = power @ step
    rest = np.linalg.solve(np.eye(2) - step, np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]]))
    ends = np.stack([one, two], axis=-1).reshape(channels, seconds, 2)
    starts, state = np.empty((channels, seconds, 2)), np.zeros((channels, 2))
    for s in range(seconds):
        state = np.where(fresh[:, s, None], x[:, s, :1] * rest, state)
        starts[:, s] = state
        state = state @ power.T + ends[:, s]
    return out.T.reshape(x.shape) + starts @ seen.T


def settled(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Filtered samples without the two seconds after a filter started anew: what a start leaves is no signal."""
    some = np.isfinite(x).any(axis=2)
    fresh = some & ~np.concatenate([np.zeros((len(x), 1), bool), some[:, :-1]], axis=1)
    new = fresh.copy()
    new[:, 1:] |= fresh[:, :-1]
    return np.where(new[:, :, None], np.nan, y)


def sliding_entropies(y: np.ndarray, own: np.ndarray, width: int, m: int = 2, tolerance: float = 0.2) -> np.ndarray:
    """Sample entropy of the ``width`` seconds up to each second of ``own``; NaN where it can't be formed."""
    seconds, n = y.shape
    wanted = np.zeros(seconds + width, bool)
    wanted[own] = True
    out = np.full(seconds, np.nan)
    reach = np.full(seconds + width, -1.0)
    for e in own:
        x = y[max(e - width + 1, 0) : e + 1]
        x = x[np.isfinite(x)]
        reach[e] = tolerance * x.std() if len(x) >= m + 2 else -1.0
    padded = np.concatenate([y.ravel(), np.full(m, np.nan)])
    there = np.isfinite(y).any(axis=1)
    short, long = np.zeros(seconds, np.int64), np.zeros(seconds, np.int64)
    gap, near, close = np.empty((n + m, n + m)), np.empty((n, n)), np.empty((n, n), bool)
    for b in range(seconds):
        for a in range(max(0, b - width + 1), b + 1):
            ends = [e for e in range(b, a + width) if wanted[e] and e < seconds and reach[e] > 0] if there[a] and there[b] else []
            if not ends:
                continue
            np.subtract(padded[a * n : (a + 1) * n + m, None], padded[None, b * n : (b + 1) * n + m], out=gap)
            np.abs(gap, out=gap)
            np.maximum(gap[:n, :n], gap[m - 1 : n + m - 1, m - 1 : n + m - 1], out=near)
            for k in range(1, m - 1):
                np.maximum(near, gap[k : n + k, k : n + k], out=near)
            # few pairs are near at all: what is compared for each window, and with one sample more, is those alone
            i, j = np.divmod(np.flatnonzero(np.less_equal(near, max(reach[e] for e in ends), out=close)), n)
            if a == b:  # each pair once, none with itself
                i, j = i[i < j], j[i < j]
            both, one_more = near[i, j], gap[i + m, j + m]
            i, j, both, one_more = (v[~np.isnan(one_more)] for v in (i, j, both, one_more))  # both lengths count the same templates
            one_more = np.maximum(both, one_more)
            for e in ends:
                inside = (i < n - m if a == b else True) & (j < n - m) if e == b else slice(None)  # templates end with the window
                short[e] += np.count_nonzero(both[inside] <= reach[e])
                long[e] += np.count_nonzero(one_more[inside] <= reach[e])
    ok = (short > 0) & (long > 0)
    out[ok] = -np.log(long[ok] / short[ok])
    return out


def sliding_permutations(y: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
    """Permutation entropy of order 3 of the ``width`` seconds up to each second of ``own``."""
    seconds, n = y.shape
    x = np.concatenate([y.ravel(), [np.nan, np.nan]])
    a, b, c = x[:-2], x[1:-1], x[2:]
    code = np.where(np.isnan(a + b + c), -1, (a > b) * 4 + (b > c) * 2 + (a > c)).reshape(seconds, n)
    kinds = (0, 1, 2, 3, 4, 5, 6, 7)
    every = np.stack([(code == k).sum(axis=1) for k in kinds])
    last = np.stack([(code[:, : n - 2] == k).sum(axis=1) for k in kinds])
    running = np.concatenate([np.zeros((8, 1), np.int64), np.cumsum(every, axis=1)], axis=1)
    first = np.maximum(own - width + 1, 0)
    p = (running[:, own] - running[:, first] + last[:, own]).astype(float)
    total = p.sum(axis=0)
    with np.errstate(all="ignore"):
        p /= total
        return np.where(total > 1, -np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0).sum(axis=0) / np.log(6), np.nan)


def _summed(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of rows [low, high) of a matrix, from running sums in long doubles."""
    running = np.concatenate([np.zeros((1, x.shape[1]), np.longdouble), np.cumsum(x, axis=0, dtype=np.longdouble)])
    return (running[high] - running[low]).astype(np.float64)


def _spectra(x: np.ndarray, there: np.ndarray, taper: np.ndarray, bins: np.ndarray) -> np.ndarray:
    n = there.sum(axis=1, keepdims=True)
    centred = np.where(there, x - np.where(there, x, 0).sum(axis=1, keepdims=True) / np.maximum(n, 1), 0)
    return np.fft.rfft(centred * taper, axis=1)[:, bins] * (2 * n >= x.shape[1])  # at least half of a segment


def pair_features(x: np.ndarray, y: np.ndarray, own: np.ndarray, widths: tuple[int, ...], rate: int) -> dict[int, dict[str, np.ndarray]]:
    """For each width: coherence and phase locking by band, and correlation, of the seconds up to each of ``own``."""
    both = np.isfinite(x) & np.isfinite(y)
    a, b = np.where(both, x, 0.0), np.where(both, y, 0.0)
    shift = [np.median(v[both]) if both.any() else 0.0 for v in (x, y)]
    u, v = np.where(both, a - shift[0], 0), np.where(both, b - shift[1], 0)
    moments = np.stack([both.sum(axis=1), u.sum(axis=1), v.sum(axis=1), (u * u).sum(axis=1), (v * v).sum(axis=1), (u * v).sum(axis=1)], axis=1).astype(float)
    freq = np.fft.rfftfreq(rate, 1 / rate)
    bins = np.flatnonzero((freq >= LOW_HZ) & (freq < HIGH_HZ))
    taper, half = np.hanning(rate + 1)[:-1], rate // 2
    parts = []
    for late in (False, True):  # segments of whole seconds, and those that begin in the middle of the second before
        cut = (lambda z: np.concatenate([np.concatenate([np.zeros((1, rate - half), z.dtype), z[:-1, half:]]), z[:, :half]], axis=1)) if late else lambda z: z
        p, q = (_spectra(cut(z), cut(both), taper, bins) for z in (a, b))
        cross, own_p, own_q = p * q.conj(), np.abs(p) ** 2, np.abs(q) ** 2
        size = np.abs(cross)
        unit = np.divide(cross, size, out=np.zeros_like(cross), where=size > 0)
        parts.append(np.concatenate([cross.real, cross.imag, own_p, own_q, unit.real, unit.imag, size > 0], axis=1))
    out = {}
    for width in widths:
        first = np.maximum(own - width + 1, 0)
        s = (_summed(parts[0], first, own + 1) + _summed(parts[1], np.minimum(first + 1, own + 1), own + 1)).reshape(len(own), 7, len(bins))
        made = {}
        with np.errstate(all="ignore"):
            coherence = (s[:, 0] ** 2 + s[:, 1] ** 2) / (s[:, 2] * s[:, 3])
            locking = np.hypot(s[:, 4], s[:, 5]) / s[:, 6]
            enough = (s[:, 6] >= 3) & (s[:, 2] > 1e-9) & (s[:, 3] > 1e-9)  # one segment is always coherent with itself
            for band, (low, high) in BANDS.items():
                inside = enough & (freq[bins] >= low) & (freq[bins] < high)
                mean = lambda z: np.where(inside.any(axis=1), np.where(inside, z, 0).sum(axis=1) / inside.sum(axis=1), np.nan)  # noqa: B023,E731
                made |= {f"coherence_{band}": np.minimum(mean(coherence), 1), f"plv_{band}": np.minimum(mean(locking), 1)}
            n, sx, sy, xx, yy, xy = _summed(moments, first, own + 1).T
            var_x, var_y = xx - sx * sx / n, yy - sy * sy / n
            flat = (var_x <= 1e-12 * xx) | (var_y <= 1e-12 * yy) | (n < 2)
            made["correlation"] = np.where(flat, np.nan, np.clip((xy - sx * sy / n) / np.sqrt(var_x * var_y), -1, 1))
        out[width] = made
    return out


def _blocks(timeline: DataFrame, reach: int, block: int) -> DataFrame:
    """Light seconds of EEG in blocks with ``reach`` seconds before them, in order, dealt to the session's tasks."""
    at = floor_div(F.col(T), SECOND)
    own = floor_div(at, block)
    light = timeline.select(*KEYS, T, *[F.col(f"eeg_{c}").cast("array<double>").alias(c) for c in CHANNELS], own.alias("_own"), at.alias("_at"))
    spread = light.withColumn("_block", F.explode(F.sequence("_own", floor_div(F.col("_at") + reach, block))))
    return spread.repartition(tasks_of(timeline.sparkSession), *KEYS, "_block").sortWithinPartitions(*KEYS, "_block", T)


def _each_block(batches: Iterator[pa.RecordBatch], rate: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows that are its own, their places, samples by (channel, second, sample)) of each block."""
    held: list[pa.RecordBatch] = []
    name = None

    def made() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        at = table.column("_at").to_numpy()
        place = at - at[0]
        x = np.full((len(CHANNELS), int(place[-1]) + 1, rate), np.nan)
        for k, c in enumerate(CHANNELS):
            column = table.column(c).combine_chunks()
            sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            ok = np.flatnonzero(sizes == rate)
            if len(ok):
                x[k, place[ok]] = column.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, rate)
        mine = np.flatnonzero(table.column("_own").to_numpy() == table.column("_block").to_numpy())
        return table.take(pa.array(mine)), place[mine], x

    for b in batches:
        ids = list(zip(*(b.column(k).to_pylist() for k in (*KEYS, "_block")), strict=True))
        cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if held and ids[low] != name:
                yield made()
                held = []
            name = ids[low]
            held.append(b.slice(low, high - low))
    if held:
        yield made()


def kernels(timeline: DataFrame, width: int = 5, rate: int = 256, mains: float = 60.0, block: int = BLOCK) -> DataFrame:
    """(keys, time, and for each channel ``clean_<c>``, its filtered samples, and entropies of the trailing ``width`` seconds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, own, x in _each_block(batches, rate):
            if not len(own):
                continue
            y = filtered(x, rate, mains)
            columns = [table.column(c) for c in (*KEYS, T)]
            for k in range(len(CHANNELS)):
                rows = y[k][own]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * rate, pa.int32()), pa.array(rows.ravel(), mask=~np.isfinite(rows.ravel())))
                entropy, orders = sliding_entropies(y[k], own, width)[own], sliding_permutations(y[k], own, width)
                columns += [lists, *[pa.array(v, pa.float64(), mask=~np.isfinite(v)) for v in (entropy, orders)]]
            yield from pa.table(columns, names=names).to_batches(max_chunksize=200)

    names = [*KEYS, T, *[n.format(c) for c in CHANNELS for n in ("clean_{}", "{}_sample_entropy", "{}_permutation_entropy")]]
    kinds = {n: timeline.schema[n].dataType.simpleString() for n in KEYS}
    schema = ", ".join(f"{n} {kinds.get(n) or ('long' if n == T else 'array<double>' if n.startswith('clean_') else 'double')}" for n in names)
    return _blocks(timeline, SETTLE + width - 1, block).mapInArrow(run, schema)


PAIR_NAMES = [f"{n}_{b}" for b in BANDS for n in ("coherence", "plv")]


def pair_tables(timeline: DataFrame, widths: tuple[int, ...], rate: int = 256, mains: float = 60.0, block: int = 1800) -> DataFrame:
    """A row for each second and width: features of all pairs, and the mean of the correlations that there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, own, x in _each_block(batches, rate):
            if not len(own):
                continue
            y = dict(zip(CHANNELS, settled(x, filtered(x, rate, mains)), strict=True))
            found = {(a, b): pair_features(y[a], y[b], own, widths, rate) for a, b in PAIRS}
            for width in widths:
                values = [found[p][width][n] for p in PAIRS for n in PAIR_NAMES]
                correlations = np.stack([found[p][width]["correlation"] for p in PAIRS])
                some = np.isfinite(correlations)
                mean = np.where(some.any(axis=0), np.where(some, correlations, 0).sum(axis=0) / np.maximum(some.sum(axis=0), 1), np.nan)
                columns = [pa.array(v, pa.float64(), mask=~np.isfinite(v)) for v in (*values, mean)]
                window = pa.array(np.full(len(own), width, np.int16))
                yield from pa.table([*[table.column(c) for c in (*KEYS, T)], window, *columns], names=names).to_batches(max_chunksize=2000)

    features = [*[f"eeg_pair_{a}_{b}_{n}" for a, b in PAIRS for n in PAIR_NAMES], "eeg_channel_correlation_mean"]
    names = [*KEYS, T, "feature_window_sec", *features]
    kinds = {n: timeline.schema[n].dataType.simpleString() for n in KEYS} | {T: "long", "feature_window_sec": "short"}
    return _blocks(timeline, SETTLE + max(widths) - 1, block).mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))
