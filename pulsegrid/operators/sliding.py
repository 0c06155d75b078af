"""Trailing windows of any widths from one exchange: moments, extremes, order statistics and lags.

Spark evaluates a sliding frame anew for each row and aggregate.  Here features *ask* a ``Frame`` for what they need,
for as many widths as wanted; all answers then come from one pass over blocks of time with a halo of the widest window,
so a person with a third of all rows is many blocks.  Within a block (numpy, a bounded number of rows):

* moments and cross products are mergeable sums, kept to both sides of every cut of a binary splitting of the block: a
  window is the end of one side and the start of the other, so no row outside ever enters and nothing is subtracted;
  values are shifted by their block's median, and a window without spread is told by its extremes and gives exactly zero;
* minima and maxima come from a table of runs of 1, 2, 4, ... rows, of which two overlapping ones cover a window;
* medians and quantiles come from a wavelet matrix of the block's ranks, which selects the k-th value of any stretch in
  one step a bit; the median absolute deviation bisects how many of its values lie below the median.

Cost is rows x (log of a block) for each question, not rows x width.  Everything before and after (the columns that are
asked about, and what features make of the answers) stays in Spark.

Defined cases: null, NaN and infinite values are missing; a window without values gives null (counts 0); rows of equal
time are all in each other's windows; windows may reach back over gaps and never ahead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timecols import floor_div
from pulsegrid.operators.blocks import block_starts, whole_blocks
from pulsegrid.operators.windows import tasks_of

#: Most rows whose blocks are answered together, however large a batch is; a block is never cut.
ROWS_AT_ONCE = 4096


class Frames:
    """Questions about trailing windows of one table, each asked once however often it is needed."""

    def __init__(self, keys: list[str], t: str):
        self.keys, self.t = keys, t
        self.inputs: dict[str, tuple[str, Column]] = {}
        self.rows: dict[str, tuple[str, Column]] = {}
        self.asked: dict[tuple, str] = {}

    def frame(self, width: int, until: int = 0) -> Frame:
        return Frame(self, width, until)

    def input(self, c: Column | str) -> str:
        c = F.col(c) if isinstance(c, str) else c
        return self.inputs.setdefault(repr(c), (f"_in{len(self.inputs)}", c))[0]

    def row(self, c: Column | str) -> Column:
        """A value of the row itself, for use beside answers."""
        c = F.col(c) if isinstance(c, str) else c
        return F.col(self.rows.setdefault(repr(c), (f"_row{len(self.rows)}", c))[0])

    def ask(self, kind: str, width: int, until: int, *what) -> Column:
        return F.col(self.asked.setdefault((kind, width, until, *what), f"_a{len(self.asked)}"))

    def answer(self, df: DataFrame, block: int | None = None) -> DataFrame:
        """(keys, t, values of the row, answers): one row for each row of ``df``; ``block`` defaults to eight halos.

        Blocks are dealt to the session's number of shuffle partitions: they are light to move and heavy to work on,
        and adaptive execution, which goes by bytes, would put them into few tasks.
        """
        reach = max((width - 1 - until for _, width, until, *_ in self.asked), default=0)
        block = block or 8 * (reach + 1)
        own = floor_div(F.col(self.t), block)
        light = df.select(*self.keys, self.t, *[c.alias(n) for n, c in self.rows.values()], *[c.cast("double").alias(n) for n, c in self.inputs.values()], own.alias("_own"))
        spread = light.withColumn("_block", F.explode(F.sequence("_own", floor_div(F.col(self.t) + F.lit(reach).cast("long"), block))))
        dealt = spread.repartition(tasks_of(df.sparkSession), *self.keys, "_block").sortWithinPartitions(*self.keys, "_block", self.t)
        kept = [*self.keys, self.t, *[n for n, _ in self.rows.values()]]
        fields = [f"`{n}` {light.schema[n].dataType.simpleString()}" for n in kept] + [f"{n} double" for n in self.asked.values()]
        asked, keys, t = dict(self.asked), list(self.keys), self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_blocks(batches, keys, ROWS_AT_ONCE):
                yield from _answered(table, asked, keys, kept, t, reach)

        return dealt.mapInArrow(run, ", ".join(fields))


class Frame:
    """One trailing window: times in [t - width + 1 + until, t + until]; ``until`` is 0 or less."""

    def __init__(self, frames: Frames, width: int, until: int):
        if until > 0:
            raise ValueError("a feature window must not look ahead")
        self.frames, self.width, self.until = frames, width, until

    def _one(self, kind: str, c: Column | str, *more) -> Column:
        return self.frames.ask(kind, self.width, self.until, self.frames.input(c), *more)

    def _two(self, kind: str, a: Column | str, b: Column | str) -> Column:
        return self.frames.ask(kind, self.width, self.until, self.frames.input(a), self.frames.input(b))

    def rows(self) -> Column:
        return self.frames.ask("rows", self.width, self.until)

    def row(self, c: Column | str) -> Column:
        return self.frames.row(c)

    def at(self, c: Column | str, back: int) -> Column:
        """Largest value of the rows exactly ``back`` before this one."""
        return self.frames.ask("max", 1, -back, self.frames.input(c))

    def count(self, c) -> Column:
        return self._one("count", c)

    def sum(self, c) -> Column:
        return self._one("sum", c)

    def avg(self, c) -> Column:
        return self._one("avg", c)

    def min(self, c) -> Column:
        return self._one("min", c)

    def max(self, c) -> Column:
        return self._one("max", c)

    def var_samp(self, c) -> Column:
        return self._one("var_samp", c)

    def stddev_samp(self, c) -> Column:
        return F.sqrt(self.var_samp(c))

    def percentile(self, c, q: float) -> Column:
        """By linear interpolation between the two nearest ranks."""
        return self._one("quantile", c, float(q))

    def median(self, c) -> Column:
        return self.percentile(c, 0.5)

    def mad(self, c) -> Column:
        """Median absolute deviation from the median."""
        return self._one("mad", c)

    def slope(self, c) -> Column:
        """Least squares over time, by unit of time; null with fewer than two times."""
        return self.frames.ask("slope", self.width, self.until, self.frames.input(c), self.frames.t)

    def corr(self, a, b) -> Column:
        """Pearson correlation over rows that have both; null where either doesn't vary."""
        return self._two("corr", a, b)

    def regr_slope(self, y, x) -> Column:
        return self._two("slope", y, x)

    def regr_intercept(self, y, x) -> Column:
        return self._two("intercept", y, x)


def _runs(x: np.ndarray, longest: int, of) -> np.ndarray:
    """Extremes of the 2^k rows from each row on, for each k."""
    out = [x]
    while 1 << len(out) <= longest:
        half = 1 << (len(out) - 1)
        last = out[-1].copy()
        last[:-half] = of(out[-1][:-half], out[-1][half:])
        out.append(last)
    return np.stack(out)


def _cuts(x: np.ndarray) -> np.ndarray:
    """Level 0: the values; level k + 1: sums from each place to the middle of its piece of 2^(k+1), towards either side."""
    size = 1 << max(len(x) - 1, 1).bit_length()
    x = np.concatenate([x, np.zeros(size - len(x), x.dtype)])
    out = [x]
    half = 1
    while half < size:
        piece = x.reshape(-1, 2 * half)
        out.append(np.concatenate([np.cumsum(piece[:, half - 1 :: -1], axis=1)[:, ::-1], np.cumsum(piece[:, half:], axis=1)], axis=1).ravel())
        half *= 2
    return np.stack(out)


def _between(cuts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of the stretches [low, high)."""
    first, last = np.minimum(low, cuts.shape[1] - 1), np.maximum(high - 1, 0)
    apart = first ^ last
    level = np.where(apart > 0, np.frexp(apart.astype(np.float64))[1], 0)
    a, b = cuts[level, first], cuts[level, last]
    return np.where(high > low, np.where(apart > 0, a + b, a), 0)


class WaveletMatrix:
    """Selects the k-th smallest value of any stretch; a bit a level, each level the ranks' order after the bits above it."""

    def __init__(self, values: np.ndarray):
        self.distinct, rank = np.unique(values, return_inverse=True)
        self.levels: list[tuple[np.ndarray, int]] = []
        for bit in reversed(range(max(len(self.distinct) - 1, 0).bit_length())):
            one = (rank >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)])
            self.levels.append((zeros, bit))
            rank = np.concatenate([rank[one == 0], rank[one == 1]])

    def select(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of values [low, high); ``k`` must be within."""
        found = np.zeros(len(k), np.int64)
        for zeros, bit in self.levels:
            before, upto = zeros[low], zeros[high]
            right = k >= upto - before
            k = np.where(right, k - (upto - before), k)
            low, high = np.where(right, zeros[-1] + low - before, before), np.where(right, zeros[-1] + high - upto, upto)
            found |= right.astype(np.int64) << bit
        return self.distinct[found]

    def quantile(self, low: np.ndarray, high: np.ndarray, q: float) -> np.ndarray:
        at = (high - low - 1) * q
        below = np.floor(at).astype(np.int64)
        a, b = self.select(low, high, below), self.select(low, high, np.ceil(at).astype(np.int64))
        return a + (b - a) * (at - below)

    def mad(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Deviations are two ordered lists, of the values up to the median going down, and of those above going up."""
        n, m = high - low, self.quantile(low, high, 0.5)
        left = (n + 1) // 2

        def below(i: np.ndarray) -> np.ndarray:  # i-th least deviation (from 1) of the lower values
            d = m - self.select(low, high, np.clip(left - i, 0, n - 1))
            return np.where(i < 1, -np.inf, np.where(i > left, np.inf, d))

        def above(i: np.ndarray) -> np.ndarray:
            d = self.select(low, high, np.clip(left + i - 1, 0, n - 1)) - m
            return np.where(i < 1, -np.inf, np.where(i > n - left, np.inf, d))

        def kth(k: np.ndarray) -> np.ndarray:
            least, most = np.maximum(k - (n - left), 0), np.minimum(k, left)
            while (open_ := least < most).any():
                middle = (least + most) // 2
                enough = above(k - middle) <= below(middle + 1)
                most, least = np.where(open_ & enough, middle, most), np.where(open_ & ~enough, middle + 1, least)
            return np.maximum(below(least), above(k - least))

        return (kth((n - 1) // 2 + 1) + kth(n // 2 + 1)) / 2


class _Block:
    """What is known about one block: each array is made once, for all windows that ask for it."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns, self.made = columns, {}

    def once(self, key: tuple, make):
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]

    def there(self, names: tuple[str, ...]) -> np.ndarray:
        return self.once(("there", *names), lambda: np.logical_and.reduce([np.isfinite(self.columns[n]) for n in names]))

    def counted(self, names: tuple[str, ...]) -> np.ndarray:
        return self.once(("counted", *names), lambda: np.concatenate([[0], np.cumsum(self.there(names))]))

    def sums(self, names: tuple[str, ...], what: tuple[str, ...], shifted: bool) -> np.ndarray:
        """Sums of the product of ``what`` over rows that have all of ``names``, to both sides of every cut."""

        def make():
            there = self.there(names)
            product = np.ones(len(there), np.longdouble)
            for n in what:
                x = self.columns[n]
                product = product * np.where(there, x - (np.median(x[there]) if shifted and there.any() else 0.0), 0.0)
            return _cuts(np.where(there, product, 0))

        return self.once(("sums", names, what, shifted), make)

    def extreme(self, name: str, others: tuple[str, ...], low: np.ndarray, high: np.ndarray, largest: bool) -> np.ndarray:
        """Of the rows that have ``name`` and ``others``; infinite where there are none."""
        none = -np.inf if largest else np.inf
        of = np.maximum if largest else np.minimum
        there = self.there(tuple(sorted({name, *others})))
        table = self.once(("runs", name, others, largest), lambda: _runs(np.where(there, self.columns[name], none), len(there), of))
        n = np.maximum(high - low, 1)
        k = np.floor(np.log2(n)).astype(np.int64)
        last = len(there) - 1
        found = of(table[k, np.minimum(low, last)], table[k, np.clip(high - (1 << k), 0, last)])
        return np.where(high > low, found, none)

    def ranks(self, name: str) -> tuple[np.ndarray, WaveletMatrix]:
        def make():
            return self.counted((name,)), WaveletMatrix(self.columns[name][self.there((name,))])

        return self.once(("ranks", name), make)


def _answered(table: pa.Table, asked: dict[tuple, str], keys: list[str], kept: list[str], t: str, reach: int) -> Iterator[pa.RecordBatch]:
    """Answers of whole blocks, many at a time: their times are set so far apart that no window reaches another block."""
    starts = block_starts(table, keys)
    times = table.column(t).to_numpy()
    sizes = np.diff(np.append(starts, len(times)))
    since = times - np.repeat(times[starts], sizes)
    apart = int(since.max(initial=0)) + reach + 2
    most = max((1 << 61) // apart, 1)  # blocks whose times fit 64 bits
    for k in range(0, len(starts), most):
        low, high = int(starts[k]), int(starts[k + most]) if k + most < len(starts) else len(times)
        placed = since[low:high] + np.repeat(np.arange(len(sizes[k : k + most]), dtype=np.int64), sizes[k : k + most]) * apart
        yield from _of_blocks(table.slice(low, high - low), asked, kept, t, placed, since[low:high]).to_batches()


def _of_blocks(table: pa.Table, asked: dict[tuple, str], kept: list[str], t: str, times: np.ndarray, since: np.ndarray) -> pa.Table:
    here = table.column("_own").to_numpy() == table.column("_block").to_numpy()
    names = {n for question in asked for n in question[3:] if isinstance(n, str) and n != t}
    columns = {n: table.column(n).to_numpy().astype(np.float64) for n in names}
    block = _Block(columns | {t: since.astype(np.float64)})
    now = times[here]
    windows, out = {}, {}
    for _, width, until, *_ in asked:
        if (width, until) not in windows:
            windows[width, until] = np.searchsorted(times, now + until - width + 1, "left"), np.searchsorted(times, now + until, "right")
    with np.errstate(all="ignore"):
        for (kind, width, until, *what), name in asked.items():
            out[name] = _one_answer(block, kind, *windows[width, until], *what)
    own = table.select(kept).filter(pa.array(here))
    return pa.table([*own.columns, *[pa.array(v, pa.float64(), mask=~np.isfinite(v)) for v in out.values()]], names=[*kept, *out])


def _one_answer(block: _Block, kind: str, low: np.ndarray, high: np.ndarray, *what) -> np.ndarray:
    if kind == "rows":
        return (high - low).astype(np.float64)
    names = tuple(sorted({n for n in what if isinstance(n, str)}))

    def total(*product: str, shifted: bool = True) -> np.ndarray:
        return _between(block.sums(names, tuple(sorted(product)), shifted), low, high)

    counted = block.counted(names)
    n = counted[high] - counted[low]
    if kind == "count":
        return n.astype(np.float64)
    x = what[0]
    some = n > 0
    if kind in ("sum", "avg"):
        s = total(x, shifted=False)
        return np.where(some, s if kind == "sum" else s / n, np.nan).astype(np.float64)
    if kind in ("min", "max"):
        return block.extreme(x, (), low, high, kind == "max")
    if kind in ("quantile", "mad"):
        counted, matrix = block.ranks(x)
        a, b = counted[low[some]], counted[high[some]]
        found = np.full(len(low), np.nan)
        if some.any():
            found[some] = matrix.quantile(a, b, what[1]) if kind == "quantile" else matrix.mad(a, b)
        return found
    flat = lambda c: block.extreme(c, names, low, high, True) <= block.extreme(c, names, low, high, False)
    squares = lambda c: np.where(flat(c), 0, np.maximum(total(c, c) - total(c) ** 2 / n, 0))
    if kind == "var_samp":
        return np.where(n > 1, squares(x) / (n - 1), np.nan).astype(np.float64)
    y = what[1]
    if x == y:  # a column against itself
        together = squares(x)
    else:
        together = np.where(flat(x) | flat(y), 0, total(x, y) - total(x) * total(y) / n)
    if kind == "corr":
        return np.clip(together / np.sqrt(squares(x) * squares(y)), -1, 1).astype(np.float64)
    slope = np.where(n > 1, together / squares(y), np.nan)
    if kind == "slope":
        return slope.astype(np.float64)
    if kind == "intercept":
        return ((total(x, shifted=False) - slope * total(y, shifted=False)) / n).astype(np.float64)
    raise ValueError(kind)
