"""Decayed medians from merged sketches against the definition over the whole past."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import decayed

STEP, HALF_LIFE = 0.25, 40


def middle(pairs):
    total, upto = math.fsum(w for _, w in pairs), 0.0
    for v, w in sorted(pairs):
        upto += w
        if upto >= total * decayed.HALF:
            return v


def plain(rows, rounded):
    """Of each row: median and MAD of all strictly earlier values of its key."""
    out = {}
    for i, p, t, _ in rows:
        past = [(math.floor(v / STEP + 0.5) * STEP if rounded else v, 2.0 ** ((u - t) / HALF_LIFE)) for _, q, u, v in rows if q == p and u < t and v is not None and math.isfinite(v)]
        m = middle(past) if past else None
        out[i] = (m, middle([(abs(v - m), w) for v, w in past]) if past else None)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = [(k, "hot", int(t), float(v)) for k, (t, v) in enumerate(zip(rng.integers(-900, 900, 500), rng.normal(0, 4, 500)))]
    out += [(1000 + k, None, int(t), float(v)) for k, (t, v) in enumerate(zip(rng.integers(0, 300, 60), rng.normal(50, 1, 60)))]
    # two values, a gap of 500 half-lives, and values that don't count
    out += [(2000, "gap", 0, 1.0), (2001, "gap", 10, 3.0), (2002, "gap", 20_000, None), (2003, "gap", 20_001, float("nan")), (2004, "gap", 20_002, 9.0), (2005, "gap", 20_300, 9.0)]
    return [*out, (3000, "odd", 5, float("inf")), (3001, "odd", 6, 2.0), (3002, "odd", 7, None)]


@pytest.mark.parametrize("block", [None, 7, 64 * HALF_LIFE])
def test_whole_past_whatever_the_blocks(spark, rows, block):
    df = spark.createDataFrame(rows, "id long, p string, t long, v double").repartition(5)
    got = {r.id: (r.ew_median, r.ew_mad) for r in decayed.decayed_median_mad(df, ["p"], "t", "v", HALF_LIFE, STEP, block).collect()}
    assert got == plain(rows, True)
    exact = plain(rows, False)
    for i, (m, d) in got.items():
        assert (m is None) == (exact[i][0] is None)
        if m is not None:
            assert abs(m - exact[i][0]) <= STEP / 2 + 1e-9 and abs(d - exact[i][1]) <= STEP + 1e-9


def test_columns_and_empty_tables_stay(spark, rows):
    df = spark.createDataFrame(rows, "id long, p string, t long, v double").withColumn("big", F.lit(2**62 + 1) + F.col("id")).withColumn("none", F.lit(None).cast("long"))
    out = decayed.decayed_median_mad(df, ["p"], "t", "v", HALF_LIFE, STEP)
    assert out.drop("ew_median", "ew_mad").exceptAll(df).count() == 0 and out.count() == len(rows)
    assert decayed.decayed_median_mad(df.limit(0), ["p"], "t", "v", HALF_LIFE, STEP).count() == 0
    with pytest.raises(ValueError):
        decayed.decayed_median_mad(df, ["p"], "t", "v", HALF_LIFE, STEP, 65 * HALF_LIFE)


def test_sketches_merge_in_any_grouping():
    rng = np.random.default_rng(2)
    a, b, c = ({int(k): float(w) for k, w in zip(rng.integers(0, 9, 6), rng.random(6))} for _ in range(3))
    left, right = decayed.merged(decayed.merged(a, b, 3.0), c, 2.0), decayed.merged(a, decayed.merged(b, c, 2.0), 5.0)
    assert left.keys() == right.keys() and all(left[k] == pytest.approx(right[k]) for k in left)


def test_memory_is_that_of_the_cells_in_use():
    held = {}
    for k in range(5000):  # a level that drifts: cells of long ago are left out
        held = decayed.merged(held, {k: 1.0}, 1.0)
    assert len(held) <= 66
