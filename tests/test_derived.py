"""Incremental tables equal full ones, and leave alone what no change reaches."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import windows
from pulsegrid.plans import derived

UNIT = 100


def table(spark, rows):
    return spark.createDataFrame(rows, "p string, t long, v double").withColumn("u", F.expr("t div 100"))


def sums(width):
    def make(df):
        out = windows.trailing(df, ["p"], "t", width, {"s": lambda w: F.sum("v").over(w)}, 50)
        return out.select("p", "t", "s", "u")

    return make


def running(df):
    """Every earlier value counts, however far back."""
    return windows.latest(df.withColumn("s", F.col("v")), ["p"], "t", ["s"], 50).select("p", "t", "s", "u")


def rows_of(df):
    return sorted((r.p, r.t, r.s, int(r.u)) for r in df.select("p", "t", "s", "u").collect())


def files(home):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{home}/x/**/*.parquet", recursive=True)}


START = [(p, t, float(t % 7) if t % 60 else None) for p in ("a", "b") for t in range(0, 1000, 20)]
CASES = {
    "a value of one row": [(p, t, v + 1 if (p, t) == ("a", 340) else v) for p, t, v in START],
    "repeated rows, a unit gone, the last unit gone": [r for r in START if not (r[0] == "a" and (300 <= r[1] < 400 or r[1] >= 900))] + [("b", 520, 1.0)] * 2,
    "a new unit, a new person, a person gone": [r for r in START if r[0] == "a"] + [("a", 1010, 2.0), ("c", 15, 3.0)],
    "all is gone": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("reach", [2, None])
def test_equals_a_full_run(spark, tmp_path, case, reach):
    make = sums(2 * UNIT) if reach else running
    home = str(tmp_path)
    derived.update(table(spark, START), make, home, "x", ["p"], "u", reach)
    before = files(home)
    now = table(spark, CASES[case])
    remade = {(r.p, int(r.u)) for r in derived.update(now, make, home, "x", ["p"], "u", reach).collect()}
    if case != "all is gone":
        assert rows_of(spark.read.parquet(f"{home}/x")) == rows_of(make(now))
    else:
        assert files(home) == {}
    kept = {f: m for f, m in before.items() if not any(f"/p={p}/u={u}/" in f for p, u in remade)}
    assert kept.items() <= files(home).items()  # the very files
    changed = {(p, t // UNIT) for p, t, v in set(START) ^ set(CASES[case])} | ({("b", 5)} if "repeated" in case else set())
    there = {(p, t // UNIT) for p, t, _ in START + CASES[case]}
    after = {(p, u) for p, u in there for q, c in changed if p == q and c <= u and (reach is None or u - c <= reach)}
    assert remade == after
    if case == "a value of one row":
        assert derived.update(now, make, home, "x", ["p"], "u", reach).isEmpty()  # nothing has changed since


def test_another_version_or_a_lost_table_makes_all(spark, tmp_path):
    home, df = str(tmp_path), table(spark, START)
    every = {(r.p, r.u) for r in df.select("p", "u").distinct().collect()}
    for version, make in (("1", sums(100)), ("2", sums(200))):
        assert {(r.p, int(r.u)) for r in derived.update(df, make, home, "x", ["p"], "u", 2, version).collect()} == every
        assert rows_of(spark.read.parquet(f"{home}/x")) == rows_of(make(df))
    derived.remove(spark, spark.read.parquet(f"{home}/x").select(F.col("_metadata.file_path").alias("file")))
    for f in glob.glob(f"{home}/x/_SUCCESS"):
        os.remove(f)
    assert derived.update(df, sums(200), home, "x", ["p"], "u", 2, "2").count() == len(every)
    assert rows_of(spark.read.parquet(f"{home}/x")) == rows_of(sums(200)(df))


def test_broken_off_update_is_made_again(spark, tmp_path, monkeypatch):
    home, now = str(tmp_path), table(spark, CASES["a value of one row"])
    derived.update(table(spark, START), sums(200), home, "x", ["p"], "u", 2)
    monkeypatch.setattr(derived, "commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        derived.update(now, sums(200), home, "x", ["p"], "u", 2)
    monkeypatch.undo()
    assert derived.update(now, sums(200), home, "x", ["p"], "u", 2).count() == 3
    assert rows_of(spark.read.parquet(f"{home}/x")) == rows_of(sums(200)(now))


def test_dates_and_null_keys(spark, tmp_path):
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.col("u").cast("int"))
    start = table(spark, START).withColumn("p", F.when(F.col("p") == "a", F.col("p"))).withColumn("u", day)
    make = lambda d: windows.trailing(d, ["p"], "t", 200, {"s": lambda w: F.sum("v").over(w)}, 50).select("p", "t", "s", "u")
    derived.update(start, make, str(tmp_path), "x", ["p"], "u", 2)
    now = start.withColumn("v", F.when((F.col("t") == 340) & F.col("p").isNull(), 9.0).otherwise(F.col("v")))
    assert {(r.p, str(r.u)) for r in derived.update(now, make, str(tmp_path), "x", ["p"], "u", 2).collect()} == {(None, f"2026-01-0{k}") for k in (4, 5, 6)}
    key = lambda df: sorted((str(r.p), r.t, str(r.s), str(r.u)) for r in df.select("p", "t", "s", "u").collect())
    assert key(spark.read.parquet(f"{tmp_path}/x")) == key(make(now))
