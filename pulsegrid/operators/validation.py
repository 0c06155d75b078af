"""Checks of a run.  Each is an aggregate that gives one row: check, violations."""

from __future__ import annotations

import ast
import inspect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.timecols import SECOND, floor_div
from pulsegrid.sources.tables import FORBIDDEN, SAFETY

FINDING = "check string, violations long"


def _one(df: DataFrame, check: str, violations: Column) -> DataFrame:
    return df.agg(F.coalesce(violations, F.lit(0)).cast("long").alias("violations")).select(F.lit(check).alias("check"), "violations")


def count_where(df: DataFrame, check: str, bad: Column) -> DataFrame:
    return _one(df, check, F.sum(F.when(bad, 1).otherwise(0)))


def monotone(df: DataFrame, keys: list[str], t: str, step: int = SECOND, block: int = 3600 * SECOND) -> DataFrame:
    """Rows whose predecessor is not exactly one step before, the first row of each key apart.

    Order is taken within blocks of time; between blocks a row for each of them is enough.
    """
    own = df.select(*keys, t, floor_div(F.col(t), block).alias("_block"))
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*keys, "_block").orderBy(t))
    inside = own.select(*keys, "_block", t, gap.alias("_gap"))
    blocks = inside.groupBy(*keys, "_block").agg(F.sum(F.when(F.col("_gap") != step, 1).otherwise(0)).alias("_bad"), F.min(t).alias("_first"), F.max(t).alias("_last"))
    edge = F.col("_first") - F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))
    return _one(blocks.select((F.col("_bad") + F.when(edge != step, 1).otherwise(0)).alias("n")), "time_strictly_monotone_one_second", F.sum("n"))


def phase_order(events: DataFrame) -> DataFrame:
    """Events whose boundaries, nulls left out, are not in order."""
    marks = F.array_compact(F.array("start_time_ns", "pre_late_start_time_ns", "onset_time_ns", "peak_start_time_ns", "peak_end_time_ns", "recovery_early_end_time_ns", "recovery_late_end_time_ns", "end_time_ns"))
    return count_where(events, "phase_order", marks != F.array_sort(marks))


def event_ids(events: DataFrame) -> DataFrame:
    per = events.groupBy("event_id").count()
    return _one(per, "event_id_unique", F.sum(F.col("count") - 1))


def targets_complete(events: DataFrame) -> DataFrame:
    return count_where(events.filter("is_target"), "target_has_onset_and_peak", F.col("onset_time_ns").isNull() | F.col("peak_start_time_ns").isNull() | F.col("peak_end_time_ns").isNull())


def target_gap(events: DataFrame, gap_sec: int) -> DataFrame:
    w = Window.partitionBy("run_id", "person_id").orderBy("start_time_ns")
    gaps = events.filter("is_target").select((F.lead("start_time_ns").over(w) - F.col("end_time_ns")).alias("gap"))
    return count_where(gaps, "target_gap", F.col("gap") < gap_sec * SECOND)


def row_count(df: DataFrame, expected: int, name: str) -> DataFrame:
    return _one(df, f"row_count_{name}", F.abs(F.count(F.lit(1)) - F.lit(expected)))


def shared_timeline(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    per = df.groupBy(*keys).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    return _one(per, "shared_absolute_timeline", F.max("a") - F.min("a") + F.max("b") - F.min("b"))


def factor_range(timeline: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    bad = F.lit(False)
    for f in factors:
        bad = bad | F.col(f).isNull() | ~F.col(f).between(0, 1)
    return count_where(timeline, "factor_range", bad)


def sample_counts(native: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """Streams whose present samples fall short of their rate by more than the tolerance over a clip."""
    present = F.size(F.filter(F.element_at(F.map_values("channels"), 1), lambda v: v.isNotNull()))
    per = native.groupBy("person_id", "clip_id", "device_id", "stream_name").agg(F.sum(present).alias("n"), F.sum("sample_rate_hz").alias("of"))
    return count_where(per, "sample_count", F.col("n") < (1 - tolerance) * F.col("of"))


def recomputed(stored: DataFrame, again: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows of either side that the other lacks or differs from beyond the tolerance."""
    a, b = stored.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a")), again.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b"))
    joined = a.join(b, keys, "full_outer")
    bad = F.col("_a").isNull() | F.col("_b").isNull()
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        bad = bad | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance * (1 + F.abs(x)), F.lit(False))
    return count_where(joined, "features_recompute", bad)


def split_overlap(splits: DataFrame, key: str = "person_id") -> DataFrame:
    per = splits.groupBy(key).agg(F.count_distinct("split").alias("n"))
    return _one(per, "split_overlap", F.sum(F.col("n") - 1))


def truth_leak(df: DataFrame, name: str) -> DataFrame:
    bad = sum(any(c.startswith(f) or c.endswith("_truth") for f in FORBIDDEN) for c in df.columns)
    return df.sparkSession.range(1).select(F.lit(f"truth_leak_{name}").alias("check"), F.lit(bad).cast("long").alias("violations"))


def future_leak(timeline: DataFrame, compute, instants: int | list[int], keys: list[str], t: str, columns: list[str]) -> DataFrame:
    """Differences at and before each instant between features of the whole timeline and of the timeline cut there.

    All cuts are made in one pass: ``compute`` sees each as a run of its own, under the first of ``keys``.
    """
    cuts = F.array(*[F.lit(x).cast("long") for x in ([instants] if isinstance(instants, int) else instants)])

    def cut(df: DataFrame) -> DataFrame:
        every = df.withColumn("_cut", F.explode(cuts)).filter(F.col(t) <= F.col("_cut"))
        return every.withColumn(keys[0], F.concat_ws("|", F.col(keys[0]), F.col("_cut").cast("string"))).drop("_cut")

    return recomputed(cut(compute(timeline)), compute(cut(timeline)), [*keys, t], columns).withColumn("check", F.lit("future_leak"))


def clips_are_slices(clips: DataFrame, whole: DataFrame, keys: list[str], values: list[Column]) -> DataFrame:
    """(only_in_clips, differing): seconds of clips that the whole recording lacks, and those whose values differ there."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(v, F.lit("-")) for v in values]), 256)
    met = clips.select(*keys, digest.alias("_c")).distinct().join(whole.select(*keys, digest.alias("_w")), keys, "left")
    gone, other = F.col("_w").isNull(), F.col("_w") != F.col("_c")
    return met.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long")).alias(n) for n, c in (("only_in_clips", gone), ("differing", other))])


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one run has and the other lacks, with multiplicity: one signed count of each distinct row."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_n")).unionAll(b.select(*columns, F.lit(-1).alias("_n")))
    return _one(both.groupBy(*columns).agg(F.abs(F.sum("_n")).alias("_n")), "same_content", F.sum("_n"))


def comparable(df: DataFrame, keys: list[str]) -> list[str]:
    """Columns beside the keys whose values can be compared as numbers."""
    return [n for n, kind in df.dtypes if n not in keys and kind in ("double", "float", "int", "bigint", "smallint", "tinyint")]


def no_perfect_feature(aucs: DataFrame, limit: float) -> DataFrame:
    """Features that tell the label apart without error."""
    return count_where(aucs, "no_perfect_feature", F.greatest(F.col("auc"), 1 - F.col("auc")) >= limit)


def hard_negatives_overlap(latent: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    """1 where seconds of hard negatives lie apart from those of targets in every factor: the ranges between the 5th and the 95th percentile."""
    kind = F.when(F.col("active_target_event_id").isNotNull(), "target").when(F.size("active_hard_negative_event_ids") > 0, "hard")
    both = latent.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    of = lambda k, f, p: F.percentile(F.when(F.col("_kind") == k, F.col(f)), F.lit(p))
    apart = [F.coalesce((of("target", f, 0.05) > of("hard", f, 0.95)) | (of("hard", f, 0.05) > of("target", f, 0.95)), F.lit(False)) for f in factors]
    every = apart[0]
    for a in apart[1:]:
        every = every & a
    return _one(both, "hard_negatives_overlap", every.cast("int"))


def key_does_not_decide(aucs: DataFrame, key: str, limit: float = 0.95) -> DataFrame:
    """1 where a key alone (person, hour of day) tells the label apart."""
    return count_where(aucs, f"{key}_does_not_decide", F.col("auc") >= limit)


#: Words that no name of an event, archetype or column may hold: the data are synthetic and say nothing clinical.
CLINICAL = ("autis", "seizure", "diagnos", "disorder", "disease", "patient", "syndrome")


def literal(spark: SparkSession, check: str, violations: int) -> DataFrame:
    return spark.range(1).select(F.lit(check).alias("check"), F.lit(violations).cast("long").alias("violations"))


def safety(spark: SparkSession, manifest: dict, names: list[str]) -> DataFrame:
    """Safety flags that are not set, and names that hold a clinical word."""
    flags = sum(manifest.get(f) is not True for f in SAFETY)
    return literal(spark, "safety_flags_and_neutral_names", flags + sum(any(w in n.lower() for w in CLINICAL) for n in names))


def unregistered(spark: SparkSession, columns: list[str], registered: list[str]) -> DataFrame:
    """Feature columns that no registry entry describes."""
    return literal(spark, "features_registered", len(set(columns) - set(registered)))


def label_module_imports(module) -> list[str]:
    """Feature modules that a label module imports, in whichever form; there may be none."""
    return forbidden_imports(inspect.getsource(module))


def forbidden_imports(source: str) -> list[str]:
    names = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            names += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            names += [f"{node.module or ''}.{a.name}" for a in node.names]
    return [n for n in names if "features" in n.split(".")]


def all_passed(findings: DataFrame) -> list[dict]:
    """Findings on the driver: a row for each check."""
    return [{"check": r["check"], "violations": r["violations"], "passed": r["violations"] == 0} for r in findings.collect()]


def hours_of(df: DataFrame, t: str) -> Column:
    return floor_div(F.col(t), 3600 * SECOND)
