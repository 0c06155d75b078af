"""Person-level splits and checks of what could give a label away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.windows import back, before_range, in_ranges
from pulsegrid.sources.tables import broadcast_if_small


def largest_remainder(n: int, fractions: dict[str, float]) -> dict[str, int]:
    """Whole counts that sum to ``n``; each part has at least one where there are enough."""
    floor = {k: int(n * f + 1e-9) for k, f in fractions.items()}
    rest = sorted(fractions, key=lambda k: (-round(n * fractions[k] - floor[k], 9), k))
    for k in rest[: n - sum(floor.values())]:
        floor[k] += 1
    for k in fractions:
        if n >= len(fractions) and floor[k] == 0:
            most = max(floor, key=lambda x: (floor[x], x))
            floor[most], floor[k] = floor[most] - 1, 1
    return floor


def person_rank(seed: int, person: Column) -> Column:
    return F.sha2(F.concat_ws("/", F.lit(str(seed)), F.lit("split"), person.cast("string")), 256)


def by_person(people: DataFrame, seed: int, fractions: dict[str, float], key: str = "person_id") -> DataFrame:
    """(key, split): persons in hash order, cut by whole counts.

    The order is needed over all persons, so ranks come from sorted ranges and their totals, not from one task.
    """
    n = people.count()
    counts = largest_remainder(n, fractions)
    ranked = people.select(key, person_rank(seed, F.col(key)).alias("_h")).withColumn("_p", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    sizes = ranked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # 256 rows
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("_p", before.alias("_base"))
    rank = ranked.join(F.broadcast(base), "_p").withColumn("_r", F.col("_base") + F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)))
    upto, split = 0, None
    for name, c in counts.items():
        upto += c
        split = F.when(F.col("_r") <= upto, F.lit(name)) if split is None else split.when(F.col("_r") <= upto, F.lit(name))
    return rank.select(key, split.alias("split"))


def day_split(day: Column, train_days: int) -> Column:
    return F.when(day < train_days, "known_person_past").otherwise("known_person_future_day")


def cross_day(day: Column, person: Column, folds: int = 2) -> Column:
    """Fold of a person's day: days take turns, and persons begin with different folds."""
    return F.pmod(day.cast("long") + F.pmod(F.conv(F.substring(F.sha2(person.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(folds)), F.lit(folds)).cast("int")


def assign(rows: DataFrame, split: DataFrame, key: str = "person_id") -> DataFrame:
    """Rows with the split of their person; a person without one gets null."""
    return rows.join(broadcast_if_small(split.select(key, "split"), 1_000_000), key, "left")


def evaluations(labels: DataFrame, split: DataFrame, keys: list[str], day: Column, train_days: int) -> DataFrame:
    """(keys, day_index, split, future_day, cross_day, artifact_share, stress): which part each day of a person plays in each evaluation."""
    per = artifact_stress(labels.withColumn("day_index", day), [*keys, "day_index"])
    out = assign(per, split)
    return out.select(*keys, "day_index", "split", day_split(F.col("day_index"), train_days).alias("future_day"), cross_day(F.col("day_index"), F.col(keys[-1])).alias("cross_day"), "artifact_share", "stress")


def artifact_stress(labels: DataFrame, keys: list[str], share: float = 0.25) -> DataFrame:
    """(keys, artifact_share, stress): the persons or days with the most artifact seconds, from the (1 - share) quantile on."""
    per = labels.groupBy(*keys).agg(F.avg(F.col("artifact_present").cast("double")).alias("artifact_share"))
    limit = per.agg(F.percentile("artifact_share", F.lit(1 - share)).alias("_limit"))  # one row
    return per.crossJoin(F.broadcast(limit)).select(*keys, "artifact_share", (F.col("artifact_share") >= F.col("_limit")).alias("stress"))


def auc(df: DataFrame, score: str, label: str, groups: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Rank-sum AUC with ties at half; null scores and one-sided groups give null.  A row stands for ``weight`` rows.

    Scores are counted before they are ordered, and running totals go over distinct scores by ranges, in each group.
    """
    groups, one = groups or [], F.col(weight) if weight else F.lit(1)
    counted = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*groups, score).agg(F.sum(F.when(F.col(label), one).otherwise(0)).alias("_pos"), F.sum(F.when(F.col(label), 0).otherwise(one)).alias("_neg"))
    part = in_ranges(counted, groups, score)
    below = Window.partitionBy(*groups, "_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("_local", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    counted = back(local, before_range(part, groups, F.col("_neg")), [*groups, "_part"]).withColumn("below", F.col("_local") + F.col("_base"))
    won = F.sum(F.col("_pos") * (F.col("below") + F.col("_neg") / 2))
    return counted.groupBy(*groups).agg(F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"), F.try_divide(won, F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc"))
