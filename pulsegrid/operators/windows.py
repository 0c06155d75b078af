"""Causal windows and as-of lookups over time series whose keys may be hot.

A plain ``Window.partitionBy(person)`` puts all rows of a person into one task.  Here time is cut into blocks, each
block is a partition of its own, and rows are repeated into the later blocks that their window reaches; lookups
without a bound in time carry one summary row a block.  Frames never look ahead, except where a label asks for it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pulsegrid.functions.timecols import floor_div
from pulsegrid.operators.blocks import block_starts, whole_blocks

Aggregate = Callable[[object], Column]


def tasks_of(spark: SparkSession) -> int:
    """Tasks for rows that are light to move and heavy to work on: adaptive execution, which goes by bytes, would put them into few."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trailing(df: DataFrame, keys: list[str], t: str, width: int, aggregates: dict[str, Aggregate], block: int | None = None, until: int = 0, tasks: int | None = None) -> DataFrame:
    """Add ``aggregates`` over the rows of the same keys with time in ``[t - width + 1 + until, t + until]``.

    ``until`` is 0 or less (-1 leaves the present out).  Each aggregate takes the window and returns a column.
    ``block`` defaults to eight widths, so that a row is read 1.1 times on average.  With ``tasks`` the blocks are
    dealt to so many tasks whatever their size.
    """
    if until > 0:
        raise ValueError("a feature window must not look ahead")
    block = block or 8 * width
    own, reach = floor_div(F.col(t), block), floor_div(F.col(t) + F.lit(width - 1 - until), block)
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, reach)))
    if tasks:
        spread = spread.repartition(tasks, *keys, "_block")
    frame = Window.partitionBy(*keys, "_block").orderBy(t).rangeBetween(until - width + 1, until)
    out = spread.select("*", *[make(frame).alias(name) for name, make in aggregates.items()])
    return out.filter(F.col("_own") == F.col("_block")).drop("_own", "_block")


def moments(pairs: Column) -> Column:
    """(n, mean, slope) of an array of (x, y): count and average of y and its least-squares slope over x, summed as Spark's own aggregates do."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "sum", "x", "y", "together", "squares")])

    def step(a: Column, p: Column) -> Column:
        n, dx = a["n"] + 1, p["x"] - a["x"]
        y = a["y"] + (p["y"] - a["y"]) / n
        new = {"n": n, "sum": a["sum"] + p["y"], "x": a["x"] + dx / n, "y": y, "together": a["together"] + dx * (p["y"] - y), "squares": a["squares"] + dx * (dx - dx / n)}
        return F.struct(*[c.alias(k) for k, c in new.items()])

    done = lambda a: F.struct(a["n"].cast("long").alias("n"), F.try_divide(a["sum"], a["n"]).alias("mean"), F.try_divide(a["together"], a["squares"]).alias("slope"))
    return F.aggregate(pairs, zero, step, done)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not wherever it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mad(values: Column) -> Column:
    """Median absolute deviation of an array; null for an empty one."""
    pair = F.struct(values.alias("v"), median(values).alias("m"))
    return _let(pair, lambda p: median(F.transform(p["v"], lambda x: F.abs(x - p["m"]))))


def median(values: Column) -> Column:
    """Median of an array without nulls; null for an empty one."""
    at = lambda s, k: F.try_element_at(s, F.floor(k).cast("int"))
    return _let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, (at(s, (F.size(s) + 1) / 2) + at(s, F.size(s) / 2 + 1)) / 2))


def _carry(df: DataFrame, keys: list[str], t: str, columns: list[str], block: int, backward: bool) -> DataFrame:
    """The nearest non-null value of each column at or before (else: at or after) each row, within its keys."""
    own = floor_div(F.col(t), block)
    pick = F.last if backward else F.first
    local = Window.partitionBy(*keys, "_block").orderBy(t)
    local = local.rangeBetween(Window.unboundedPreceding, 0) if backward else local.rangeBetween(0, Window.unboundedFollowing)
    marked = df.withColumn("_block", own)
    best = F.max_by if backward else F.min_by
    blocks = marked.groupBy(*keys, "_block").agg(*[best(F.col(c), F.when(F.col(c).isNotNull(), F.col(t))).alias(f"_{c}") for c in columns])
    over = Window.partitionBy(*keys).orderBy("_block")  # a row for each block, not for each sample
    over = over.rowsBetween(Window.unboundedPreceding, -1) if backward else over.rowsBetween(1, Window.unboundedFollowing)
    carried = blocks.select(*keys, "_block", *[pick(f"_{c}", ignorenulls=True).over(over).alias(f"_{c}") for c in columns])
    near = marked.select("*", *[pick(c, ignorenulls=True).over(local).alias(f"_near_{c}") for c in columns])
    out = near.join(carried, [*keys, "_block"])
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_near_{c}", f"_{c}")).drop(f"_near_{c}", f"_{c}")
    return out.drop("_block").select(*df.columns)


def nearest(df: DataFrame, keys: list[str], t: str, back: list[str], ahead: list[str], block: int) -> DataFrame:
    """Both lookups in one pass: ``back`` columns take their last value at or before the row, ``ahead`` columns their first strictly after it."""
    local = Window.partitionBy(*keys, "_block").orderBy(t)
    over = Window.partitionBy(*keys).orderBy("_block")  # a row for each block
    marked = df.withColumn("_block", floor_div(F.col(t), block))
    there = lambda c: F.when(F.col(c).isNotNull(), F.col(t))
    blocks = marked.groupBy(*keys, "_block").agg(*[F.max_by(F.col(c), there(c)).alias(f"_{c}") for c in back], *[F.min_by(F.col(c), there(c)).alias(f"_{c}") for c in ahead])
    carried = blocks.select(
        *keys, "_block", *[F.last(f"_{c}", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{c}") for c in back],
        *[F.first(f"_{c}", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias(f"_{c}") for c in ahead],
    )
    near = marked.select(
        "*", *[F.last(c, ignorenulls=True).over(local.rangeBetween(Window.unboundedPreceding, 0)).alias(f"_near_{c}") for c in back],
        *[F.first(c, ignorenulls=True).over(local.rangeBetween(1, Window.unboundedFollowing)).alias(f"_near_{c}") for c in ahead],
    )
    found = {c: F.coalesce(f"_near_{c}", f"_{c}") for c in [*back, *ahead]}
    return near.join(carried, [*keys, "_block"]).select(*[found[c].alias(c) if c in found else F.col(c) for c in df.columns])


def latest(df: DataFrame, keys: list[str], t: str, columns: list[str], block: int) -> DataFrame:
    """Backward as-of: fill each column with its last value at or before the row."""
    return _carry(df, keys, t, columns, block, True)


def upcoming(df: DataFrame, keys: list[str], t: str, columns: list[str], block: int) -> DataFrame:
    """Forward as-of, for labels only: fill each column with its first value at or after the row."""
    return _carry(df, keys, t, columns, block, False)


def lagged(df: DataFrame, keys: list[str], t: str, value: str, name: str, block: int) -> DataFrame:
    """Add ``name``: ``value`` of the row before, within the keys, in order of time.

    Rows are ordered within blocks of time; a block's first row takes the last one of the nearest block before it.
    """
    marked = df.withColumn("_block", floor_div(F.col(t), block))
    last = marked.groupBy(*keys, "_block").agg(F.max(F.struct(F.col(t).alias("t"), F.col(value).alias("v"))).alias("_last"))
    before = last.select(*keys, "_block", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_before"))  # a row for each block
    local = Window.partitionBy(*keys, "_block").orderBy(t, value)
    near = marked.select("*", F.row_number().over(local).alias("_k"), F.lag(value).over(local).alias("_near"))
    joined = near.join(before, [*keys, "_block"])
    return joined.select(*df.columns, F.when(F.col("_k") == 1, F.col("_before")["v"]).otherwise(F.col("_near")).alias(name))


def back(df: DataFrame, totals: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join totals back on keys that may be null."""
    right = totals.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(right, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a temporary folder; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/{label}/{uuid.uuid4().hex}"


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` read back from the shared folder, in folders of the values of ``by``: what is read several times is planned and made once."""
    spark = df.sparkSession
    path = fresh_path(spark, "windows")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


#: Ranges of values in which the order of a group is taken apart.
RANGES = 32
#: Largest group whose distinct values one task holds as they are.
HELD_VALUES = 100_000


def in_ranges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``_part``: the range of ``value`` between approximate quantiles of its group; it depends on the value alone."""
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("_bounds"))
    return back(df, bounds, keys).withColumn("_part", F.size(F.filter("_bounds", lambda b: b <= F.col(value)))).drop("_bounds")


def before_range(parts: DataFrame, keys: list[str], count: Column) -> DataFrame:
    """(keys, _part, _base): the total of ``count`` in the ranges before, by a row for each range."""
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.groupBy(*keys, "_part").agg(F.sum(count).alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))


def group_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): exact median of the values that are there.

    Rows are counted by value first, so repeated values cost one row.  Where each group has few rows Spark's exact
    percentile holds them; else values are counted in ranges between approximate quantiles, and only the range that
    holds the middle is ordered.
    """
    there = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    largest = there.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if (largest or 0) <= HELD_VALUES:
        return there.groupBy(*keys).agg(F.percentile("_v", F.lit(0.5)).alias(name))
    counted = written(there.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    placed = in_ranges(back(counted, counted.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys), keys, "_v")
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"), F.max("_all").alias("_total")).select(*keys, "_part", "_in", "_total", F.coalesce(F.sum("_in").over(over), F.lit(0)).alias("_base"))
    holds = sizes.filter("2 * _base <= _total AND 2 * (_base + _in) >= _total").drop("_in")  # the middle one, or both that meet there
    upto = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = back(placed.drop("_all"), holds, [*keys, "_part"]).withColumn("_r", F.sum("_n").over(upto) + F.col("_base"))
    # ranks (_r - _n, _r] have this value: it is the lower or upper middle, or both
    low, high = F.expr("_r - _n < (_total + 1) div 2 AND (_total + 1) div 2 <= _r"), F.expr("_r - _n < _total div 2 + 1 AND _total div 2 + 1 <= _r")
    return last.groupBy(*keys).agg(((F.max(F.when(low, F.col("_v"))) + F.max(F.when(high, F.col("_v")))) / 2).alias(name))


def group_mad(df: DataFrame, keys: list[str], value: str, center: str, name: str) -> DataFrame:
    """(keys, center, name): exact median and median absolute deviation from it."""
    middle = written(group_median(df, keys, value, center))
    gaps = back(df.select(*keys, value), middle, keys).select(*keys, F.abs(F.col(value) - F.col(center)).alias("_gap"))
    return back(middle, group_median(gaps, keys, "_gap", name), keys)


def sessions(df: DataFrame, keys: list[str], t: str, gap: int) -> DataFrame:
    """Gaps and islands: add ``session_start`` of the run in which rows follow each other within ``gap``."""
    w = Window.partitionBy(*keys).orderBy(t)
    start = F.when(F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True)), F.col(t))
    return df.withColumn("session_start", F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


#: Rows, about, whose blocks are weighted together, and values that are sorted together.
ROWS_AT_ONCE, CELLS_AT_ONCE = 4096, 1 << 16


def _weighted_middles(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each line the least value up to which at least half of the weight lies; weights of equal values ascend, what is missing is NaN without weight at the end."""
    order = np.argsort(v, axis=1, kind="stable")
    upto = np.cumsum(np.take_along_axis(w, order, 1), axis=1)
    at = (upto >= upto[:, -1:] / 2).argmax(axis=1)
    return np.take_along_axis(v, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]


def _exponential_block(t: np.ndarray, v: np.ndarray, there: np.ndarray, here: np.ndarray, length: int, half_life: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(median, MAD, values in the window) of the rows ``here``; ``t`` ascends, and only values ``there`` count."""
    counted, now = np.concatenate([[0], np.cumsum(there)]), t[here]
    low, high = counted[np.searchsorted(t, now - length, "left")], counted[np.searchsorted(t, now, "left")]
    v, t, n = v[there], t[there], high - low
    middle, mad = np.full(len(n), np.nan), np.full(len(n), np.nan)
    rows = np.argsort(n, kind="stable")  # lines of like lengths together
    k = int(np.searchsorted(n[rows], 1))
    while k < len(rows):
        upto = k + 1
        while upto < len(rows) and n[rows[min(2 * upto - k, len(rows)) - 1]] * (min(2 * upto - k, len(rows)) - k) <= CELLS_AT_ONCE:
            upto = min(2 * upto - k, len(rows))
        these = rows[k:upto]
        place = np.arange(n[these[-1]])
        inside = place < n[these, None]
        at = np.where(inside, low[these, None] + place, 0)
        x = np.where(inside, v[at], np.nan)
        w = np.where(inside, np.power(0.5, (now[these, None] - t[at]) / float(half_life)), 0.0)
        middle[these] = _weighted_middles(x, w)
        mad[these] = _weighted_middles(np.abs(x - middle[these, None]), w)
        k = upto
    return middle, mad, n


def exponential_robust(df: DataFrame, keys: list[str], t: str, value: str, half_life: int, length: int, block: int) -> DataFrame:
    """Exponentially weighted median and MAD of the strictly earlier values within ``length``, as ``ew_median`` and ``ew_mad``.

    Weights halve every ``half_life``.  Blocks of time with a halo are dealt to tasks; windows of like sizes are weighted
    and sorted together, a bounded number of values at a time (a single window is never cut).
    """
    own, reach = floor_div(F.col(t), block), floor_div(F.col(t) + F.lit(length).cast("long"), block)
    spread = df.withColumns({"_v": F.col(value).cast("double"), "_own": own}).withColumn("_block", F.explode(F.sequence("_own", reach)))
    dealt = spread.repartition(tasks_of(df.sparkSession), *keys, "_block").sortWithinPartitions(*keys, "_block", t)
    kept, keys = df.columns, list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches, keys, ROWS_AT_ONCE):
            starts, times = block_starts(table, keys), table.column(t).to_numpy()
            sizes = np.diff(np.append(starts, len(times)))
            since = times - np.repeat(times[starts], sizes)
            apart = int(since.max()) + length + 2  # no window reaches another block
            values, there = table.column("_v").to_numpy().astype(np.float64), ~table.column("_v").is_null().to_numpy()
            here = table.column("_own").to_numpy() == table.column("_block").to_numpy()
            most = max((1 << 61) // apart, 1)  # blocks whose times fit 64 bits
            for k in range(0, len(starts), most):
                part = slice(int(starts[k]), int(starts[k + most]) if k + most < len(starts) else len(times))
                placed = since[part] + np.repeat(np.arange(len(sizes[k : k + most]), dtype=np.int64), sizes[k : k + most]) * apart
                middle, mad, n = _exponential_block(placed, values[part], there[part], here[part], length, half_life)
                rows = table.slice(part.start, part.stop - part.start).select(kept).filter(pa.array(here[part]))
                made = [pa.array(x, pa.float64(), mask=n == 0, from_pandas=False) for x in (middle, mad)]
                yield from pa.table([*rows.columns, *made], names=[*kept, "ew_median", "ew_mad"]).to_batches()

    return dealt.mapInArrow(run, StructType([*df.schema.fields, StructField("ew_median", DoubleType()), StructField("ew_mad", DoubleType())]))
