"""Stable matching of wanted moments with free stretches, nearest in time of day, by deferred acceptance in rings.

Every wanted moment proposes to the nearest stretch that has not refused it; a stretch keeps the nearest of its
proposals, the one it held included, and refuses the others.  Both sides rank a pair by the same order (how far apart in
time of day, another day first, the stretch, the turn), so the matching is the only stable one.

A key with few pairs (``HELD_PAIRS``) is matched by one small kernel: its moments and its stretches are two arrays of one
row, moved once, and the nearest pair left is taken again and again, which is the same matching.  Keys with more go in
rounds.  There no pair of all is ever made: a moment sees the stretches in bins of time of day around its own, and looks further, ring
by ring, only when those have all refused it.  Keys (persons) are matched side by side; a round is a few joins, and what
it leaves is a written table.  Rounds end when no moment has a stretch left to ask, so a moment stays alone only where
its person has no free stretch left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pulsegrid.functions.timecols import floor_div
from pulsegrid.operators.windows import tasks_of, written
from pulsegrid.sources.tables import broadcast_if_small

#: Bins of a period.
BINS = 96
#: Most pairs, and most moments and stretches together, of a key that is matched in one row.
HELD_PAIRS, HELD_ROWS = 1 << 16, 1 << 10


def apart_of(a: Column, b: Column, period: int) -> Column:
    """How far two times lie apart on a circle of ``period``."""
    p = F.lit(period).cast("long")
    d = F.pmod(a - b, p)
    return F.least(d, p - d)


def nearest_pairs(like: np.ndarray, turn: np.ndarray, start: np.ndarray, slot: np.ndarray, period: int, epoch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of moments, places of stretches, apart): the least pair by (apart, same day, slot, turn), and again of what is left."""
    turns, slots = np.argsort(turn), np.argsort(slot)
    like, start = like[turns], start[slots][:, None]
    d = (start - like) % period
    apart = np.minimum(d, period - d)
    rank = 2 * apart + ((start - epoch) // period == (like - epoch) // period)  # laid out by slot, then turn: the first of equal ones is wanted
    found = np.empty((min(rank.shape), 2), np.int64)
    for k in range(len(found)):
        i, j = found[k] = divmod(int(rank.argmin()), rank.shape[1])
        rank[i], rank[:, j] = np.iinfo(np.int64).max, np.iinfo(np.int64).max
    i, j = found.T
    return turns[j], slots[i], apart[i, j]


def _held(moments: DataFrame, stretches: DataFrame, keys: list[str], period: int, epoch: int) -> DataFrame:
    """The matching of keys with few pairs, each of them a row with its moments and stretches."""
    lists = lambda df, *names: df.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("_l")).select(*keys, *[F.col(f"_l.{n}").alias(n) for n in names])
    both = lists(moments, "turn", "like").join(lists(stretches, "slot", "start"), keys)
    both = both.repartition(tasks_of(moments.sparkSession), *keys)
    kinds = {f.name: f for f in [*moments.schema.fields, *stretches.schema.fields]}
    out = StructType([*[kinds[n] for n in (*keys, "turn", "like", "slot", "start")], StructField("apart", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = {n: b.column(n).flatten() for n in ("turn", "like", "slot", "start")}
            turn, like, slot, start = (flat[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in flat)
            ends = lambda n: np.concatenate([[0], np.cumsum(b.column(n).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            m, f = ends("turn"), ends("slot")
            made = []
            for k in range(b.num_rows):
                i, j, apart = nearest_pairs(like[m[k] : m[k + 1]], turn[m[k] : m[k + 1]], start[f[k] : f[k + 1]], slot[f[k] : f[k + 1]], period, epoch)
                made.append((np.full(len(i), k), i + m[k], j + f[k], apart))
            if made:
                row, i, j, apart = (pa.array(np.concatenate(x)) for x in zip(*made, strict=True))
                columns = [*[b.column(c).take(row) for c in keys], flat["turn"].take(i), flat["like"].take(i), flat["slot"].take(j), flat["start"].take(j), apart]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return both.mapInArrow(run, out)


def deferred_acceptance(wanted: DataFrame, free: DataFrame, keys: list[str], period: int, epoch: int = 0) -> DataFrame:
    """(keys, turn, like, slot, start, apart): the stretch that each wanted moment gets.

    ``wanted`` (keys, turn, like) and ``free`` (keys, slot, start) have times of whole numbers, of which the remainder by
    ``period`` from ``epoch`` on is the time of day; (keys, turn) and (keys, slot) are unique.
    """
    wanted, free = written(wanted.select(*keys, "turn", "like")), written(free.select(*keys, "slot", "start"))
    asks, offers = wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), free.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    large = written(asks.join(offers, keys).filter((F.col("_n") * F.col("_m") > HELD_PAIRS) | (F.col("_n") + F.col("_m") > HELD_ROWS)).select(*keys))
    if large.isEmpty():
        return _held(wanted, free, keys, period, epoch)
    some = broadcast_if_small(large, 100_000)
    light = [df.join(some, keys, "left_anti") for df in (wanted, free)]
    heavy = [df.join(some, keys, "left_semi") for df in (wanted, free)]
    return _held(*light, keys, period, epoch).unionByName(_in_rounds(*heavy, keys, period, epoch))


def _in_rounds(wanted: DataFrame, free: DataFrame, keys: list[str], period: int, epoch: int) -> DataFrame:
    """The matching of keys with any number of pairs."""
    step = -(-period // BINS)
    zero = F.lit(epoch).cast("long")
    time = lambda c: F.pmod(F.col(c) - zero, F.lit(period).cast("long"))
    stretches = written(free.select(*keys, "slot", "start", floor_div(time("start"), step).alias("_bin")))
    moments = written(wanted.select(*keys, "turn", "like", floor_div(time("like"), step).alias("_own"), F.lit(1).alias("_ring")))
    rank = F.struct("apart", "same", "slot", "turn")
    empty = moments.sparkSession.createDataFrame([], written(moments.select(*keys, "turn", F.lit(0).cast("long").alias("slot"))).schema)
    refused, held = empty, None
    while True:
        waiting = moments if held is None else moments.join(held.select(*keys, "turn"), [*keys, "turn"], "left_anti")
        around = F.array_distinct(F.transform(F.sequence(-F.col("_ring"), F.col("_ring")), lambda k: F.pmod(F.col("_own") + k, F.lit(BINS))))
        seen = waiting.withColumn("_bin", F.explode(around)).join(stretches, [*keys, "_bin"]).join(refused, [*keys, "turn", "slot"], "left_anti")
        same = (floor_div(F.col("start") - zero, period) == floor_div(F.col("like") - zero, period)).cast("int")
        ranked = seen.withColumns({"apart": apart_of(F.col("start"), F.col("like"), period), "same": same})
        # what lies beyond the ring may be nearer than the ring's own edge
        sure = (F.col("apart") <= F.col("_ring") * step) | (2 * F.col("_ring") + 1 >= BINS)
        best = ranked.groupBy(*keys, "turn", "like", "_ring").agg(F.min(rank).alias("best"))
        asked = written(waiting.join(best.select(*keys, "turn", "best"), [*keys, "turn"], "left").select(*keys, "turn", "like", "_own", "_ring", "best"))
        proposals = asked.filter("best IS NOT NULL").withColumns({"apart": F.col("best.apart"), "same": F.col("best.same"), "slot": F.col("best.slot")}).filter(sure)
        further = asked.filter(F.col("best").isNull() | ~((F.col("best.apart") <= F.col("_ring") * step) | (2 * F.col("_ring") + 1 >= BINS))).filter(2 * F.col("_ring") + 1 < BINS)
        if proposals.isEmpty() and further.isEmpty():
            break
        pairs = proposals.select(*keys, "turn", "like", "slot", "apart", "same")
        if held is not None:
            pairs = pairs.unionByName(held)
        pairs = written(pairs)
        winner = pairs.groupBy(*keys, "slot").agg(F.min(rank)["turn"].alias("_turn"))
        judged = written(pairs.join(winner, [*keys, "slot"]))
        held = judged.filter("turn = _turn").drop("_turn")
        refused = written(refused.unionByName(judged.filter("turn <> _turn").select(*keys, "turn", "slot")))
        wider = further.select(*keys, "turn", (2 * F.col("_ring")).alias("_wider"))
        moments = written(moments.join(wider, [*keys, "turn"], "left").select(*keys, "turn", "like", "_own", F.coalesce("_wider", "_ring").cast("int").alias("_ring")))
    if held is None:
        return moments.join(stretches, keys).limit(0).select(*keys, "turn", "like", "slot", "start", F.lit(0).cast("long").alias("apart"))
    return held.join(stretches.select(*keys, "slot", "start"), [*keys, "slot"]).select(*keys, "turn", "like", "slot", "start", "apart")
