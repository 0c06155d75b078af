"""Sliding windows against plain versions, row by row."""

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.operators import sliding, windows
from pulsegrid.operators.blocks import whole_blocks
from pulsegrid.operators.sliding import Frames, WaveletMatrix
from pulsegrid.plans import catalogue


def plain(rows, now, width, until):
    return [r for r in rows if now + until - width + 1 <= r[0] <= now + until]


def expected(rows, now, width, until):
    here = plain(rows, now, width, until)
    x = [r[1] for r in here if r[1] is not None and np.isfinite(r[1])]
    both = [(r[1], r[2]) for r in here if r[1] is not None and np.isfinite(r[1]) and r[2] is not None]
    timed = [(r[1], r[0]) for r in here if r[1] is not None and np.isfinite(r[1])]
    m = np.median(x) if x else None

    def slope(pairs):
        y, z = np.array([p[0] for p in pairs]), np.array([float(p[1]) for p in pairs])
        return None if len(pairs) < 2 or np.ptp(z) == 0 else float(((z - z.mean()) * (y - y.mean())).sum() / ((z - z.mean()) ** 2).sum())

    a, b = (np.array([p[k] for p in both]) for k in (0, 1))
    corr = None if len(both) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0 else float(np.corrcoef(a, b)[0, 1])
    return {
        "rows": float(len(here)), "n": float(len(x)), "sum": sum(x) if x else None, "avg": np.mean(x) if x else None, "min": min(x, default=None), "max": max(x, default=None),
        "var": np.var(x, ddof=1) if len(x) > 1 else None, "med": m, "p95": np.quantile(x, 0.95) if x else None, "mad": np.median(np.abs(np.array(x) - m)) if x else None, "slope": slope(timed), "corr": corr, "regr": slope(both),
    }


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_equals_plain_windows(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(160):
        x = [None, 5.0, 5.0, float("nan"), 1e6, float("inf")][k % 6] if 40 <= k < 80 else float(np.round(rng.normal(50, 20), 1))
        rows.append((int(rng.integers(0, 300)) - 60, x, None if k % 5 == 0 else float(rng.integers(0, 4))))
    rows += [(500 + k, 3.25, 1.0) for k in range(30)]
    df = spark.createDataFrame([("p" if k % 2 else None, *r, f"id{k}") for k, r in enumerate(rows)], "p string, t long, x double, y double, name string").repartition(3)
    frames = Frames(["p"], "t")
    name, asked = frames.row("name"), {}
    for width, until in ((1, -4), (9, 0), (40, -1), (150, 0)):
        w = frames.frame(width, until)
        for n, c in {"rows": w.rows(), "n": w.count("x"), "sum": w.sum("x"), "avg": w.avg("x"), "min": w.min("x"), "max": w.max("x"), "var": w.var_samp("x"), "med": w.median("x"), "p95": w.percentile("x", 0.95),
                     "mad": w.mad("x"), "slope": w.slope("x"), "corr": w.corr("x", "y"), "regr": w.regr_slope("x", "y")}.items():
            asked[width, until, n] = c
    found = frames.answer(df, block).select("t", "p", name.alias("name"), *[c.alias(f"{n}_{w}_{-u}") for (w, u, n), c in asked.items()]).collect()
    assert len(found) == len(rows)
    for r in found:
        mine = [x for k, x in enumerate(rows) if ("p" if k % 2 else None) == r.p]
        for (w, u) in {(w, u) for w, u, _ in asked}:
            for n, v in expected(mine, r.t, w, u).items():
                got = r[f"{n}_{w}_{-u}"]
                assert (v is None) == (got is None) and (v is None or abs(got - v) <= 1e-9 * max(1, abs(v))), (r.t, r.p, w, u, n, v, got)
    assert frames.answer(df.limit(0), block).count() == 0


def test_no_look_ahead():
    with pytest.raises(ValueError):
        Frames(["p"], "t").frame(5, 1)


def test_constant_stretch_beside_wide_values(spark):
    """A window without spread gives exactly zero, though its block has values of 1e9."""
    df = spark.createDataFrame([("p", k, 0.1 if k % 100 < 50 else 1e9 * (k % 7)) for k in range(1000)], "p string, t long, x double")
    frames = Frames(["p"], "t")
    w = frames.frame(20)
    v = w.var_samp("x")
    out = {r.t: r.v for r in frames.answer(df, 5000).select("t", v.alias("v")).collect()}
    assert all(out[t] == 0.0 for t in range(1000) if 19 <= t % 100 < 50) and out[60] > 1e17


def test_wavelet_matrix():
    rng = np.random.default_rng(8)
    for values in (np.array([4.0]), np.zeros(9), rng.integers(0, 5, 77).astype(float), rng.normal(size=130)):
        m = WaveletMatrix(values)
        low = rng.integers(0, len(values), 300)
        high = np.array([rng.integers(a + 1, len(values) + 1) for a in low])
        k = np.array([rng.integers(0, b - a) for a, b in zip(low, high, strict=True)])
        assert np.array_equal(m.select(low, high, k), [np.sort(values[a:b])[j] for a, b, j in zip(low, high, k, strict=True)])
        assert np.allclose(m.mad(low, high), [np.median(np.abs(values[a:b] - np.median(values[a:b]))) for a, b in zip(low, high, strict=True)], rtol=0, atol=1e-12)


@pytest.mark.parametrize("held", [100_000, 0])
def test_group_medians(spark, monkeypatch, held):
    monkeypatch.setattr(windows, "HELD_VALUES", held)
    rng = np.random.default_rng(2)
    groups = {"hot": [7.0] * 400 + rng.normal(7, 3, 700).tolist(), "two": [1.0, 2.0], "one": [5.0], None: [3.0, None, 9.0, 4.0], "none": [None], "even": [1.0, 1.0, 9.0, 9.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(4)
    got = {r.k: (r.m, r.d) for r in windows.group_mad(df, ["k"], "v", "m", "d").collect()}
    for k, vs in groups.items():
        x = np.array([v for v in vs if v is not None])
        if len(x):
            assert np.allclose(got[k], (np.median(x), np.median(np.abs(x - np.median(x)))), atol=1e-12), k
        else:
            assert k not in got
    assert windows.group_median(df.limit(0), ["k"], "v", "m").count() == 0


def test_large_batches_are_cut_into_whole_blocks():
    """However many rows a batch has, blocks are answered a bounded number of rows at a time, each whole and once."""
    for sizes, batch in (([50] * 300, 10_000), ([1, 7, 400, 3] * 20 + [9000] + [2] * 50, 1000), ([5], 1), ([4096, 4096], 8192), ([], 10)):
        k = np.repeat(np.arange(len(sizes)), sizes)
        table = pa.table({"p": pa.array([None if i // 3 % 2 else f"p{i // 6}" for i in k], pa.string()), "_block": k % 3, "row": np.arange(len(k))})
        got = [t.to_pydict() for t in whole_blocks(iter(table.to_batches(batch)), ["p"], 4096)]
        assert [r for t in got for r in t["row"]] == list(range(len(k)))
        parts = [set(k[t["row"]].tolist()) for t in got]
        assert all(len(t["row"]) <= 4096 or len(p) == 1 for t, p in zip(got, parts, strict=True)) and sum(map(len, parts)) == len(sizes)


def test_memory_of_a_task_follows_slices_not_batches():
    """The rows that are answered at once stay the same when a batch holds ten times as many."""
    sizes = [3600] * 20  # hours of seconds
    k = np.repeat(np.arange(len(sizes)), sizes)
    table = pa.table({"p": ["p"] * len(k), "_block": k})
    most = [max(t.num_rows for t in whole_blocks(iter(table.to_batches(n)), ["p"], 4096)) for n in (7200, 72_000)]
    assert most == [3600, 3600]


@pytest.mark.parametrize("name", ["poincare_window_features", "motion_window_features"])
def test_queries_answer_few_rows_at_once(spark, tmp_path, monkeypatch, name):
    """In a task with large batches no more rows are worked on together than in one with small ones, and the result is the same."""
    n = 12_000
    spark.range(n).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "16 * (id % 5) AS user_id", "element_at(array('view', 'click', 'error', 'signup'), int(id % 4) + 1) AS event_type",
        "double(id * 7919 % 1000) / 10 AS value", "concat('{\"k\": ', id * 104729 % 100, '}') AS props").write.parquet(f"{tmp_path}/events.parquet")
    answered = sliding._answered

    def few(table, *how):
        assert table.num_rows <= 4096  # of blocks of an hour at most, with halo
        return answered(table, *how)

    monkeypatch.setattr(sliding, "_answered", few)
    batch, parts = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"
    before = {c: spark.conf.get(c) for c in (batch, parts)}
    try:
        spark.conf.set(parts, "1")
        got = []
        for rows in ("10000", "500"):
            spark.conf.set(batch, rows)
            got.append(sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()), key=lambda r: r[1]))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert [r[1] for r in got[0]] == list(range(1, n + 1)) and got[0] == got[1]
