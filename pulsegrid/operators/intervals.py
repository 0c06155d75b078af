"""Joins of instants with half-open intervals [start, end).

Both sides are dealt into time buckets, so the join is an equi-join on (keys, bucket) with the interval as residual:
no nested loop, and a person with very many intervals is split by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timecols import floor_div


def _bucketed(points: DataFrame, intervals: DataFrame, t: str, start: str, end: str, bucket: int) -> tuple[DataFrame, DataFrame]:
    valid = intervals.filter(F.col(end) > F.col(start))
    spread = F.sequence(floor_div(F.col(start), bucket), floor_div(F.col(end) - 1, bucket))
    return points.withColumn("_bucket", floor_div(F.col(t), bucket)), valid.withColumn("_bucket", F.explode(spread))


def during(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, bucket: int, how: str = "left") -> DataFrame:
    """Each point with each interval of the same keys that holds it; ``how`` is any Spark join type."""
    p, i = _bucketed(points, intervals, t, start, end, bucket)
    p, i = p.alias("p"), i.alias("i")
    same = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "_bucket"]]
    inside = (F.col(f"p.{t}") >= F.col(f"i.{start}")) & (F.col(f"p.{t}") < F.col(f"i.{end}"))
    on = inside
    for c in same:
        on = c & on
    out = p.join(i, on, how)
    if how in ("left_semi", "left_anti"):
        return out.drop("_bucket")
    extra = [c for c in intervals.columns if c not in keys]
    return out.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"i.{c}") for c in extra])


def overlap_lists(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, bucket: int, lists: dict[str, str]) -> DataFrame:
    """Each point with sorted lists of the distinct interval columns that hold it (empty where none does)."""
    hits = during(points, intervals, keys, t, start, end, bucket, "inner")
    grouped = hits.groupBy(*keys, t).agg(*[F.array_sort(F.collect_set(c)).alias(name) for name, c in lists.items()])
    out = points.join(grouped, [*keys, t], "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in lists})
