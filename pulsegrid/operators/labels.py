"""Labels, taken from hidden events only and never from features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.timecols import HOUR, SECOND, floor_div
from pulsegrid.sources.tables import broadcast_if_small

#: Integer codes of the phases, and the forecast horizons in seconds.
PHASE_CODES = {"baseline": 0, "pre_early": 1, "pre_late": 2, "onset": 3, "peak": 4, "recovery_early": 5, "recovery_late": 6, "post": 7}
HORIZONS = (30, 60, 120, 180)
#: What labels take from the active target.
TARGET_COLUMNS = ("event_id", "event_type", "event_instance_index", "start_time_ns", "pre_late_start_time_ns", "onset_time_ns", "peak_start_time_ns", "peak_end_time_ns", "recovery_early_end_time_ns",
                  "recovery_late_end_time_ns", "end_time_ns", "intensity_truth")
#: Kinds of artifact.
ARTIFACT_KINDS = (
    "blink", "jaw_emg", "head_motion", "electrode_pop", "impedance_drift", "channel_dropout", "common_mode", "mains", "clipping", "flatline", "baseline_wander", "motion", "contact_loss", "missed_peak",
    "extra_peak", "ectopic_like", "gap", "motion_coupling", "amplitude_modulation", "ambient_leak", "saturation", "block_drop", "drift", "sparse_scr", "motion_spike", "dry_skin", "quantisation", "bias",
    "scale", "rotation", "gravity_leak", "jitter", "loss", "random_missing", "block_dropout",
)
#: Cut points of the intensity classes.
INTENSITY_CUTS = (1 / 3, 2 / 3)


def phase_at(t: Column) -> Column:
    """Phase of an instant in an event; a phase that was skipped has no start and can't be met."""
    ends = [("pre_early", F.coalesce("pre_late_start_time_ns", "onset_time_ns")), ("pre_late", F.col("onset_time_ns")), ("onset", F.col("peak_start_time_ns")),
            ("peak", F.col("peak_end_time_ns")), ("recovery_early", F.col("recovery_early_end_time_ns")), ("recovery_late", F.col("recovery_late_end_time_ns"))]
    out = F.when(F.col("event_id").isNull(), F.lit("baseline"))
    for name, end in ends:
        out = out.when(t < end, F.lit(name))
    return out.otherwise(F.lit("post"))


def phase_code(phase: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PHASE_CODES.items() for x in kv]), phase)


def forecasts(next_onset: Column, t: Column, horizons=HORIZONS, unit: int = SECOND) -> dict[str, Column]:
    """Whether the next onset is within (0, h] of now, for each horizon."""
    ahead = next_onset - t
    return {f"will_target_start_within_{h}s": F.coalesce((ahead > 0) & (ahead <= h * unit), F.lit(False)) for h in horizons}


def intensity_class(intensity: Column) -> Column:
    low, high = INTENSITY_CUTS
    return F.when(intensity < low, "low").when(intensity < high, "medium").when(intensity.isNotNull(), "high")


def since(t: Column, mark: Column) -> Column:
    return F.when(t >= mark, (t - mark) / F.lit(float(SECOND)))


def until(t: Column, mark: Column) -> Column:
    return F.when(t < mark, (mark - t) / F.lit(float(SECOND)))


def label_timeline(grid: DataFrame, events: DataFrame, artifacts: DataFrame, bucket: int = HOUR) -> DataFrame:
    """Labels with the key of ``grid`` (run_id, person_id, canonical_time_ns), one row for each of its rows.

    Targets and artifacts are spread to their seconds and meet the grid in one aggregate by key and second; the next
    onset comes by a small table with a row for each person and hour.
    """
    keys, t = ["run_id", "person_id"], "canonical_time_ns"
    targets = events.filter("is_target").withColumn("event_instance_index", instance_index())
    valid = {f"valid_for_{k}_model": s for k, s in (("eeg", "eeg"), ("cardiac", "ecg"), ("eda", "eda"))}
    kinds = {"on_grid": "int", "event_instance_index": "int", "fault": "long"} | dict.fromkeys(valid, "int")

    def part(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(*keys, t, *[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])

    # one number for severity and kind: the most severe, then the last by name
    names = F.array(*[F.lit(k) for k in sorted(ARTIFACT_KINDS)])
    code = F.round(F.col("severity").cast("double") * 1_000_000).cast("long") * 1000 + F.array_position(names, F.col("artifact_type"))
    severe = lambda stream: F.when((F.col("stream_name") == stream) & (F.col("severity") >= 0.5), 1)
    rows = part(grid, on_grid=F.lit(1))
    rows = rows.unionByName(part(by_second(targets, "start_time_ns", "end_time_ns", t), event_instance_index=F.col("event_instance_index")))
    rows = rows.unionByName(part(by_second(artifacts, "start_time_ns", "end_time_ns", t), fault=code, **{n: severe(s) for n, s in valid.items()}))
    found = rows.groupBy(*keys, t).agg(*[F.max(n).alias(n) for n in kinds]).filter("on_grid = 1")
    met = found.join(broadcast_if_small(targets.select(*keys, *TARGET_COLUMNS), 100_000), [*keys, "event_instance_index"], "left")
    fault = F.when(F.col("fault").isNotNull(), F.element_at(names, F.pmod(F.coalesce("fault", F.lit(1)), F.lit(1000)).cast("int")))
    severity = F.col("fault") / F.lit(1e9)
    met = met.withColumns({n: F.col(n).isNull() for n in valid})
    phase = phase_at(F.col(t))
    every = F.col("valid_for_eeg_model") & F.col("valid_for_cardiac_model") & F.col("valid_for_eda_model")
    labels = met.select(
        *keys, t, "event_id", "event_type", phase.alias("event_phase"), F.col("event_id").isNotNull().alias("event_binary"), "event_instance_index", F.lit("synthetic_rule_v1").alias("label_source"),
        F.lit(1.0).cast("float").alias("label_confidence"), until(F.col(t), F.col("onset_time_ns")).alias("time_to_onset_sec"), since(F.col(t), F.col("onset_time_ns")).alias("time_since_onset_sec"),
        until(F.col(t), F.col("peak_start_time_ns")).alias("time_to_peak_sec"), since(F.col(t), F.col("peak_start_time_ns")).alias("time_since_peak_sec"), until(F.col(t), F.col("end_time_ns")).alias("time_to_event_end_sec"),
        intensity_class(F.col("intensity_truth")).alias("event_intensity_class"), F.col("intensity_truth").alias("event_intensity_truth"),
        fault.alias("artifact_type_primary"), F.coalesce(severity >= 0.7, F.lit(False)).alias("artifact_dominant"), F.col("fault").isNotNull().alias("artifact_present"),
        *valid, every.alias("valid_for_multimodal_model"), sum(((~F.col(c)).cast("int") for c in valid), F.lit(0)).alias("missing_modality_count"),
    )
    ahead = next_onsets(labels.withColumn("event_phase_code", phase_code(F.col("event_phase"))), targets, keys, t, bucket)
    return ahead.withColumns(forecasts(F.col("next_onset"), F.col(t))).withColumn("next_target_onset_sec", (F.col("next_onset") - F.col(t)) / F.lit(float(SECOND))).drop("next_onset")


def by_second(spans: DataFrame, start: str, end: str, t: str) -> DataFrame:
    """A row for each whole second that a half-open span holds."""
    s = F.lit(SECOND).cast("long")
    first, last = (floor_div(F.col(c) + F.lit(SECOND - 1).cast("long"), SECOND) * s for c in (start, end))
    return spans.filter(last > first).withColumn(t, F.explode(F.sequence(first, last - s, s)))


def next_onsets(rows: DataFrame, targets: DataFrame, keys: list[str], t: str, bucket: int) -> DataFrame:
    """Add ``next_onset``: the first onset strictly after each row.

    A row for each person and hour with onsets holds them; hours take the first onset after them from the person's
    list, which is as long as the person has targets.
    """
    listed = targets.groupBy(*keys).agg(F.array_sort(F.collect_list("onset_time_ns")).alias("_onsets"))
    hours = rows.select(*keys, floor_div(F.col(t), bucket).alias("_bucket")).distinct().join(broadcast_if_small(listed, 100_000), keys)
    begin, end = F.col("_bucket") * F.lit(bucket).cast("long"), (F.col("_bucket") + 1) * F.lit(bucket).cast("long")
    near = F.filter("_onsets", lambda x: (x > begin) & (x < end))
    after = F.array_min(F.filter("_onsets", lambda x: x >= end))
    small = broadcast_if_small(hours.select(*keys, "_bucket", near.alias("_near"), after.alias("_after")), 500_000)
    met = rows.withColumn("_bucket", floor_div(F.col(t), bucket)).join(small, [*keys, "_bucket"], "left")
    return met.withColumn("next_onset", F.coalesce(F.array_min(F.filter("_near", lambda x: x > F.col(t))), F.col("_after"))).drop("_bucket", "_near", "_after")


def instance_index() -> Column:
    """Number of an event among its person's, by start and id."""
    return F.row_number().over(Window.partitionBy("run_id", "person_id").orderBy("start_time_ns", "event_id"))


def active_lists(grid: DataFrame, events: DataFrame, t: str = "truth_time_ns") -> DataFrame:
    """Active hard negatives and artifact-only schedules of each instant, as sorted lists.

    Events are spread to seconds and listed before they meet the grid, once.
    """
    keys = ["run_id", "person_id"]
    only = F.col("is_artifact_only_schedule")
    each = by_second(events.filter("NOT is_target").select(*keys, "event_id", "event_type", "is_artifact_only_schedule", "start_time_ns", "end_time_ns"), "start_time_ns", "end_time_ns", t)
    names = {"active_hard_negative_event_ids": F.when(~only, F.col("event_id")), "active_hard_negative_types": F.when(~only, F.col("event_type")), "artifact_only_schedule_ids": F.when(only, F.col("event_id"))}
    listed = each.groupBy(*keys, t).agg(*[F.array_sort(F.collect_set(c)).alias(n) for n, c in names.items()])
    out = grid.join(listed, [*keys, t], "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in names})
