"""Exponentially decayed median and MAD over a whole past, from sketches that can be merged.

A sketch holds, for each whole multiple of ``step`` (a cell), the decayed weight of the values nearest to it.  Decay
goes forward: a value at u weighs 2^((u - landmark) / half_life), which no later row changes, so sketches of stretches
are added up once they are brought to one landmark.  Each block of time makes its sketch where its rows are, the
sketches of a key are folded in order of time, and a row is answered from what its block was handed and from the
block's own earlier rows, in a Fenwick tree over cells.  Memory is that of the cells in use and of one block's rows,
whatever came before.

Error: a value is off by at most ``step / 2`` from its cell, so the median is off by at most ``step / 2`` and the MAD
by at most ``step`` from those of the values themselves.  Of a folded sketch, cells below 2^-64 of its weight are left
out, which doubles cannot tell; a gap longer than ``LONGEST_GAP`` half-lives counts as so long.

Defined cases: a row sees strictly earlier times only, so rows of one time don't see each other; null, NaN and
infinite values weigh nothing, and their rows are answered all the same; rows without any earlier value get nulls;
null keys are a key of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.timecols import floor_div

#: Half-lives between two sketches beyond which the earlier one's weight is not lowered any more.
LONGEST_GAP = 200
#: Share of a sketch's weight below which a cell is left out.
LEAST_SHARE = 2.0**-64
#: A half, less what sums of doubles may be off by.
HALF = 0.5 - 1e-12


def merged(a: dict[int, float], b: dict[int, float], half_lives: float) -> dict[int, float]:
    """The sketch of both, at the landmark of ``b``, which lies so many half-lives after that of ``a``."""
    scale = 2.0 ** -min(half_lives, LONGEST_GAP)
    out = {c: w * scale for c, w in a.items()}
    for c, w in b.items():
        out[c] = out.get(c, 0.0) + w
    least = LEAST_SHARE * sum(out.values())
    return {c: w for c, w in out.items() if w > least}


class Cells:
    """Decayed weights over a known set of cells: added to, and asked for median and MAD, in logarithmic time."""

    def __init__(self, cells: list[int]) -> None:
        self.cells, self.tree, self.total = cells, [0.0] * (len(cells) + 1), 0.0
        self.top = 1 << max(len(cells).bit_length() - 1, 0)

    def add(self, cell: int, weight: float) -> None:
        i = bisect_left(self.cells, cell) + 1
        self.total += weight
        while i < len(self.tree):
            self.tree[i] += weight
            i += i & -i

    def upto(self, n: int) -> float:
        """Weight of the first ``n`` cells."""
        out = 0.0
        while n:
            out += self.tree[n]
            n -= n & -n
        return out

    def median(self) -> int:
        """The least cell up to which half of the weight lies."""
        at, left, jump = 0, self.total * HALF, self.top
        while jump:
            if at + jump < len(self.tree) and self.tree[at + jump] < left:
                at += jump
                left -= self.tree[at]
            jump >>= 1
        return self.cells[min(at, len(self.cells) - 1)]

    def mad(self, middle: int) -> int:
        """The least distance from ``middle`` within which half of the weight lies."""
        low, high = 0, max(middle - self.cells[0], self.cells[-1] - middle)
        while low < high:
            d = (low + high) // 2
            within = self.upto(bisect_right(self.cells, middle + d)) - self.upto(bisect_left(self.cells, middle - d))
            low, high = (low, d) if within >= self.total * HALF else (d + 1, high)
        return low


def block_sketches(df: DataFrame, value: Column, t: str, half_life: int, step: float, block: int) -> DataFrame:
    """(_key, _block, _cells, _weights) of ``df`` (_key, _block, t, ...): each block's own sketch, at its start."""
    there = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    cell = F.when(there, F.floor(value / F.lit(step) + F.lit(0.5)))
    weight = F.pow(F.lit(2.0), (F.col(t) - F.col("_block") * F.lit(block)) / F.lit(float(half_life)))
    counted = df.groupBy("_key", "_block", cell.alias("_c")).agg(F.sum(weight).alias("_w"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("_c").isNotNull(), F.struct("_c", "_w"))))
    return counted.groupBy("_key", "_block").agg(pairs.alias("_pairs")).select("_key", "_block", F.col("_pairs._c").alias("_cells"), F.col("_pairs._w").alias("_weights"))


def carried(sketches: DataFrame, half_life: int, block: int) -> DataFrame:
    """The same rows with the sketch of all earlier blocks of the key, at the start of the row's block."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, at = None, {}, 0
        for batch in batches:
            cells, weights = [], []
            for k, b, c, w in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if k != key:
                    key, held, at = k, {}, b
                now = merged(held, {}, (b - at) * block / half_life)
                cells.append(list(now))
                weights.append(list(now.values()))
                if c:  # a block without values leaves the sketch where it is
                    held, at = merged(held, dict(zip(c, w, strict=True)), (b - at) * block / half_life), b
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64()))], names=batch.schema.names)

    ordered = sketches.repartition("_key").sortWithinPartitions("_key", "_block")  # a row for each block of time
    return ordered.mapInArrow(fold, "_key string, _block long, _cells array<bigint>, _weights array<double>")


def decayed_median_mad(df: DataFrame, keys: list[str], t: str, value: str, half_life: int, step: float, block: int | None = None) -> DataFrame:
    """``df`` with ``ew_median`` and ``ew_mad`` of all strictly earlier values of the same keys, as the module has them.

    ``block`` defaults to four half-lives; it must not hold more than 64, lest weights grow out of doubles.
    """
    block = block or 4 * half_life
    if step <= 0 or half_life <= 0 or not 0 < block <= 64 * half_life:
        raise ValueError("step and half-life must be above 0, and a block at most 64 half-lives")
    key = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"})
    marked = df.withColumns({"_key": key, "_block": floor_div(F.col(t), block)})
    before = carried(block_sketches(marked, F.col(value).cast("double"), t, half_life, step, block), half_life, block)
    schema = T.StructType([*df.schema.fields, T.StructField("ew_median", T.DoubleType()), T.StructField("ew_mad", T.DoubleType())])
    names = df.columns

    def answer(rows: pa.Table, handed: pa.Table) -> pa.Table:
        rows = rows.sort_by(t)
        start = rows.column("_block")[0].as_py() * block
        times = rows.column(t).to_numpy()
        x = rows.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False) / step
        there = np.isfinite(x)
        cells = np.floor(np.where(there, x, 0.0) + 0.5).astype(np.int64)
        weights = np.exp2((times - start) / half_life)
        old = dict(zip(handed.column("_cells")[0].as_py(), handed.column("_weights")[0].as_py(), strict=True))
        held = Cells(sorted({*old, *cells[there].tolist()}))
        for c, w in old.items():
            held.add(c, w)
        middles, spreads = [], []
        edges = [*np.flatnonzero(np.diff(times)) + 1, len(times)]
        begin = 0
        for end in edges:  # rows of one time are answered before any of them is added
            m = held.median() if held.total > 0 else None
            d = held.mad(m) if m is not None else None
            middles += [None if m is None else m * step] * (end - begin)
            spreads += [None if d is None else d * step] * (end - begin)
            for i in range(begin, end):
                if there[i]:
                    held.add(int(cells[i]), float(weights[i]))
            begin = end
        return rows.select(names).append_column("ew_median", pa.array(middles, pa.float64())).append_column("ew_mad", pa.array(spreads, pa.float64()))

    return marked.groupBy("_key", "_block").cogroup(before.groupBy("_key", "_block")).applyInArrow(answer, schema)
