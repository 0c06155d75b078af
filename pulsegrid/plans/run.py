"""A run from configuration to validated tables, as Spark jobs that read and write Parquet."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.timecols import DAY, HOUR, SECOND, date_of_ns, floor_div
from pulsegrid.operators import devices, eeg, features, labels, sanity, splits, truth, validation, windows
from pulsegrid.plans import derived
from pulsegrid.sources import tables
from pulsegrid.sources.config import RunConfig, config_hash, estimate, guard, resolved, run_id, source_files

KEYS, T = ["run_id", "person_id"], "canonical_time_ns"


def grid_of(timeline: DataFrame) -> DataFrame:
    return timeline.select(*KEYS, F.col("truth_time_ns").alias(T))


def generate(spark: SparkSession, config: RunConfig, root: str, truth_only: bool = False, source: str | None = None) -> dict:
    """Write all tables of a run under ``root``/run id, and return its manifest; ``source`` is the YAML file of the configuration."""
    guard(config)
    home = f"{root.rstrip('/')}/{run_id(config)}"
    put = lambda df, name: tables.write_table(df, home, name)
    get = lambda name: tables.read_table(spark, home, name)
    put(truth.participants(spark, config), "participants")
    put(truth.daily_context(spark, config), "daily_context")
    put(truth.events(spark, config), "events")
    put(truth.latent_timeline(spark, config, get("events")), "latent_timeline")
    put(devices.clock_models(spark, config), "clock_models")
    put(devices.artifacts(spark, config, get("latent_timeline"), get("events"), get("daily_context")), "artifacts")
    names = ["participants", "daily_context", "events", "latent_timeline", "clock_models", "artifacts"]
    if not truth_only:
        put(truth.clips(spark, config, get("events")), "clip_manifest")
        latent, people, faults, days = get("latent_timeline"), get("participants"), get("artifacts"), get("daily_context")
        whole = devices.aligned(devices.native(latent, people, faults, None, config, days), latent, get("clock_models"), config)
        if config.native_storage == "all":  # the whole recording is kept, and read again
            put(whole.drop("packet_seed"), "native")
            whole = get("native")
        else:
            clipped = devices.native(latent, people, faults, get("clip_manifest"), config, days)
            put(devices.aligned(clipped, latent, get("clock_models"), config).drop("packet_seed"), "native")
        put(observed_timeline(devices.on_grid(whole), latent, config), "timeline_1hz")
        put(labels.label_timeline(grid_of(latent), get("events"), faults), "labels")
        put(splits.by_person(people.select("person_id"), config.splits.seed, config.splits.fractions), "splits")
        day = floor_div(F.col(T) - F.lit(config.run.start_ns).cast("long"), DAY)
        put(splits.evaluations(get("labels"), get("splits"), KEYS, day, max(config.run.duration_sec // 86_400 - 2, 1)), "evaluations")
        put(oracle_features(get("timeline_1hz"), people), "oracle_features")
        names += ["clip_manifest", "native", "timeline_1hz", "labels", "splits", "evaluations", "oracle_features"]
        names += write_features(spark, config, home)
    entries = {n: {**tables.content_hash(tables.read_table(spark, home, n)), "columns": tables.read_table(spark, home, n).columns} for n in names}
    made = tables.manifest(resolved(config), run_id(config), config.run.seed, entries) | {"config_sha256": config_hash(config), "estimate": estimate(config)}
    tables.write_json(f"{home}/provenance/manifest.json", made)
    write_provenance(config, home, source)
    return made


def write_provenance(config: RunConfig, home: str, source: str | None) -> None:
    """The configuration as resolved and as written, and the installed packages with their licences."""
    rows = tables.dependency_rows()
    tables.write_json(f"{home}/provenance/dependencies.json", {"packages": rows})
    tables.write_text(f"{home}/provenance/licences.csv", tables.licence_csv(rows))
    tables.write_json(f"{home}/provenance/sbom.json", tables.bill_of_materials(rows))
    tables.write_text(f"{home}/provenance/resolved_config.json", resolved(config))
    if source is not None:
        for k, (path, text) in enumerate(source_files(source).items()):
            tables.write_text(f"{home}/provenance/source_config/{k}_{os.path.basename(path)}", text)


def observed_timeline(native: DataFrame, latent: DataFrame, config: RunConfig) -> DataFrame:
    """timeline_1hz: device summaries on the full grid, with the columns that all tables share."""
    keys = [*KEYS, T]
    grid = latent.select(*KEYS, F.col("truth_time_ns").alias(T), "date_utc", "day_index", "seconds_from_start", "context_state", "is_awake")
    out = grid.join(devices.one_second_summaries(native), keys, "left").join(devices.eeg_seconds(native, config.artifacts.line_noise_hz), keys, "left")
    beats = devices.intervals_by_second(devices.peaks(native, "ecg", "ecg", 0.7), "ecg_rr_ms")
    pulses = devices.intervals_by_second(devices.peaks(native, "ppg", "green", 0.8), "ppg_interval_ms")
    return out.join(beats, keys, "left").join(pulses, keys, "left")


def oracle_features(timeline: DataFrame, people: DataFrame) -> DataFrame:
    """Upper bounds that know the true baseline; kept apart from model inputs."""
    p = tables.broadcast_if_small(people.select(*KEYS, "resting_hr_bpm_truth", "eda_tonic_level_us_truth"), 100_000)
    joined = timeline.select(*KEYS, T, "hr_bpm", "eda_us").join(p, KEYS)
    return joined.select(*KEYS, T, (F.col("hr_bpm") - F.col("resting_hr_bpm_truth")).alias("hr_over_truth_bpm"), (F.col("eda_us") - F.col("eda_tonic_level_us_truth")).alias("eda_over_truth_us"))


def slim(timeline: DataFrame) -> DataFrame:
    """The timeline without raw samples."""
    return timeline.drop(*[f"eeg_{c}" for c in features.CHANNELS])


def eligible(config: RunConfig) -> Column:
    """Seconds that may enter a personal baseline."""
    return F.col("is_awake") & ~F.col("context_state").isin(*config.features.baseline_excluded_contexts) & (F.coalesce("quality_min", F.lit(1.0)) >= 0.5)


def baseline_features(timeline: DataFrame, config: RunConfig) -> DataFrame:
    """The six personal z features, what they rest on, and how far they are off together."""
    f = config.features
    z = features.z_inputs(slim(timeline), eligible(config))
    out = features.personal_baseline(z, KEYS, T, features.Z_FEATURES, F.col("ok"), f.baseline_lookback_sec * SECOND, f.baseline_warmup_sec * SECOND, 60 * SECOND)
    names = [f"{n}_personal_robust_z" for n in features.Z_FEATURES]
    return features.with_deviation(out.select(*KEYS, T, *names, "baseline_age_sec", "baseline_sample_count", "baseline_confidence"), list(features.Z_FEATURES))


def timeline_makers(config: RunConfig) -> dict[str, tuple[Callable[[DataFrame], DataFrame], int | None]]:
    """Feature tables made from the timeline beside those of windows: how, and how many days back a row looks (None: without bound)."""
    f, mains, length = config.features, config.artifacts.line_noise_hz, config.run.duration_sec
    days = lambda seconds: -(-seconds // 86_400)
    out = {
        "features_eeg_5s": (lambda t: features.eeg_features(t, 5, stride=1, mains=mains), None),  # filters carry their state
        "features_eeg_pairs": (lambda t: eeg.pair_tables(t, tuple(w for w in f.windows_sec if w > 5), mains=mains), None),
    }
    if length >= features.SHORTEST["hrv_frequency"]:
        out["features_hrv_300s"] = (lambda t: features.hrv_kernels(slim(t), 300, 1), days(300))
    for w in f.windows_sec:
        if features.SHORTEST["hrv_nonlinear"] <= w <= length:
            out[f"features_rr_entropy_{w}s"] = (lambda t, w=w: features.rr_entropy(slim(t), w, 1), days(w))
    return out | {"features_baseline": (lambda t: baseline_features(t, config), None), "features_temperature": (lambda t: features.latest_temperature(t), None)}


def of_window(every: DataFrame, w: int) -> DataFrame:
    """The table of one window out of those of all windows."""
    return every.filter(F.col("feature_window_sec") == w).select(*KEYS, T, "feature_window_sec", "feature_valid", *features.names_of(w))


def feature_tables(spark: SparkSession, config: RunConfig, home: str) -> dict[str, DataFrame]:
    """Every feature table of a run, over its stored timeline and clips."""
    timeline = tables.read_table(spark, home, "timeline_1hz")
    light, f = slim(timeline), config.features
    every = windows.written(features.window_tables(light, tuple(f.windows_sec), f.minimum_coverage), "feature_window_sec") if len(f.windows_sec) > 1 else features.window_features(light, f.windows_sec[0], f.minimum_coverage)
    out = {f"features_{w}s": of_window(every, w) for w in f.windows_sec}
    out |= {name: make(timeline) for name, (make, _) in timeline_makers(config).items()}
    return out | clip_features(devices.on_grid(tables.read_table(spark, home, "native")))


def dated(df: DataFrame, t: str = T) -> DataFrame:
    return df if "date_utc" in df.columns else df.withColumn("date_utc", date_of_ns(F.col(t)))


def source_changes(spark: SparkSession, config: RunConfig, home: str) -> dict[str, tuple[DataFrame, derived.Change, str]]:
    """What the derived layer is made from: each source, its changes since the layer was last made, and where that is remembered."""
    out = {}
    for name, df in (("timeline_1hz", tables.read_table(spark, home, "timeline_1hz")), ("native", dated(devices.on_grid(tables.read_table(spark, home, "native")), "second_ns"))):
        state = f"{home}/provenance/state/{name}"
        out[name] = df, derived.find_changes(df, state, ["person_id"], "date_utc", config_hash(config)), state
    return out


def update_features(spark: SparkSession, config: RunConfig, home: str) -> dict[str, int]:
    """Bring the derived layer up to the stored timeline and clips; returns how many days of a person were made again, by table.

    Only days that a change reaches are made (``derived``).  Window features hold the time since a response, however
    long ago it was, so they are made again from the first changed day of a person on.
    """
    f, sources, out, held = config.features, source_changes(spark, config, home), {}, {}

    def every(t: DataFrame) -> DataFrame:
        """All windows in one pass, made once of the whole timeline and once of what changes reach."""
        whole = t is sources["timeline_1hz"][0]
        if whole not in held:
            held[whole] = windows.written(features.window_tables(slim(t), tuple(f.windows_sec), f.minimum_coverage), "feature_window_sec")
        return held[whole]

    makers = {f"features_{w}s": (lambda t, w=w: of_window(every(t), w), None) for w in f.windows_sec} | timeline_makers(config)
    clips = {name: (lambda n, name=name: clip_features(n)[name], None) for name in clip_features(sources["native"][0])}
    for source, made in (("timeline_1hz", makers), ("native", clips)):
        df, change, state = sources[source]
        for table, (make, reach) in made.items():
            put = lambda rows, table=table: tables.write_table(rows, home, table)
            out[table] = derived.remake(df, change, lambda s, make=make: dated(make(s)), reach, put, tables.table_path(home, table)).count()
    if out["features_baseline"]:
        write_onset_orders(spark, home)
    for _, change, state in sources.values():
        derived.commit(change, state)
    return out


def write_onset_orders(spark: SparkSession, home: str) -> None:
    far = features.deviation(tables.read_table(spark, home, "features_baseline"), list(features.Z_FEATURES))
    tables.write_table(features.event_onset_orders(far, tables.read_table(spark, home, "events"), list(features.Z_FEATURES)), home, "event_onset_orders")


def write_features(spark: SparkSession, config: RunConfig, home: str, overwrite: bool = True) -> list[str]:
    """Recompute the derived layer from the stored timeline; without ``overwrite`` only tables that are missing."""
    made = feature_tables(spark, config, home)
    for name, df in made.items():
        if overwrite or not tables.exists(spark, home, name):
            tables.write_table(df, home, name)
    names = list(made)
    if overwrite:
        for _, change, state in source_changes(spark, config, home).values():
            derived.commit(change, state)
    if overwrite or not tables.exists(spark, home, "event_onset_orders"):
        write_onset_orders(spark, home)
    return [*names, "event_onset_orders"]


def clip_features(rows: DataFrame) -> dict[str, DataFrame]:
    """Features that need native rates, over the seconds of the grid that clips hold; a second of several clips is taken from one."""
    one = rows.groupBy(*KEYS, "second_ns").agg(F.min("clip_id").alias("clip_id"))
    rows = rows.join(one, [*KEYS, "second_ns", "clip_id"])
    return {
        "features_motion_5s": features.motion_spectra(rows, 5, 1), "features_repetition_5s": features.repetition(features.motion_spectra(rows, 5)),
        "features_pulse_transit_60s": features.pulse_transit(devices.peaks(rows, "ecg", "ecg", 0.7), devices.peaks(rows, "ppg", "green", 0.8)),
    }


def feature_registry(spark: SparkSession, home: str, names: list[str]) -> list[dict]:
    """The registry of window features, and of the columns that kernels give."""
    keys = {*KEYS, T, "date_utc", "feature_window_sec"}
    kernels = {"features_eeg_5s": "eeg_features", "features_eeg_pairs": "eeg_features", "features_hrv_300s": "hrv_kernels", "features_baseline": "personal_baseline", "features_temperature": "latest_temperature", "features_motion_5s": "motion_spectra",
               "features_repetition_5s": "repetition", "features_pulse_transit_60s": "pulse_transit"}
    known = lambda n: kernels.get(n) or ("rr_entropy" if n.startswith("features_rr_entropy") else None)
    columns: dict[str, list[str]] = {}
    for n in names:
        if known(n):
            columns.setdefault(known(n), []).extend(c for c in tables.read_table(spark, home, n).columns if c not in keys)
    return features.registry() + features.registered(columns)


def findings(spark: SparkSession, config: RunConfig, home: str, scope: str = "all") -> DataFrame:
    """All checks of a stored run, one row each."""
    get = lambda name: tables.read_table(spark, home, name)
    ev, latent = get("events"), get("latent_timeline")
    rows = config.run.participant_count * config.run.duration_sec
    manifest = json.loads(tables.read_text(f"{home}/provenance/manifest.json"))
    names = sorted({truth.TARGET, *config.events.hard_negatives, *config.population.response_archetypes, *(c for t in manifest["tables"].values() for c in t["columns"])})
    checks = [
        validation.row_count(latent, rows, "latent_timeline"), validation.monotone(latent, KEYS, "truth_time_ns"), validation.shared_timeline(latent, KEYS, "truth_time_ns"),
        validation.factor_range(latent, (*truth.FACTORS, "eda_drive")), validation.event_ids(ev), validation.targets_complete(ev), validation.phase_order(ev), validation.target_gap(ev, config.events.minimum_gap_sec),
        validation.count_where(get("participants"), "participants_in_range", (F.col("rmssd_ms_truth") <= 0) | ~F.col("response_archetype").isin(*config.population.response_archetypes)),
        validation.hard_negatives_overlap(latent, ("autonomic_arousal", "motor_activation", "cognitive_load", "eda_drive")), validation.safety(spark, manifest, names),
    ]
    if scope == "all":
        one, lab = get("timeline_1hz"), get("labels")
        w = config.features.windows_sec[0]
        light, stored = slim(one), get(f"features_{w}s")
        again = features.window_features(light, w, config.features.minimum_coverage)
        compared = validation.comparable(again, [*KEYS, T])
        ws = config.features.windows_sec
        every = validation.comparable(features.window_tables(light, tuple(ws)), [*KEYS, T, "feature_window_sec"])
        instants = [config.run.start_ns + config.run.duration_sec * k // 7 * SECOND for k in (2, 4, 5)]
        derived = [n for n in manifest["tables"] if n.startswith("features_")]
        labelled = stored.join(lab.select(*KEYS, T, "event_binary"), [*KEYS, T])
        local = lab.select("person_id", floor_div(F.col(T) + F.lit(config.run.local_utc_offset_hours * HOUR).cast("long"), HOUR).alias("_h"), "event_binary").withColumn("hour_of_day", F.pmod("_h", F.lit(24)))
        columns = [c for n in derived for c in get(n).columns if c not in {*KEYS, T, "date_utc", "feature_window_sec", "feature_valid"}]
        checks += [
            validation.row_count(lab, rows, "labels"), validation.row_count(one, rows, "timeline_1hz"), validation.sample_counts(get("native")), validation.split_overlap(get("splits")),
            *[validation.truth_leak(get(n), n) for n in derived], validation.truth_leak(one, "timeline_1hz"), validation.recomputed(stored, again, [*KEYS, T], compared),
            validation.future_leak(light, lambda d: features.window_tables(d, tuple(ws)), instants, KEYS if len(ws) == 1 else [*KEYS, "feature_window_sec"], T, every),
            validation.no_perfect_feature(sanity.feature_aucs(labelled, compared, "event_binary"), sanity.TOO_GOOD),
            *[validation.key_does_not_decide(sanity.key_auc(local, k, "event_binary"), k) for k in ("person_id", "hour_of_day")],
            validation.unregistered(spark, columns, [r["name"] for r in feature_registry(spark, home, derived)]),
        ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def auc_warnings(spark: SparkSession, config: RunConfig, home: str) -> list[dict]:
    """Features of the middle window whose AUC on the target label is suspicious, for the report; they fail nothing."""
    w = config.features.windows_sec[len(config.features.windows_sec) // 2]
    stored = tables.read_table(spark, home, f"features_{w}s")
    labelled = stored.join(tables.read_table(spark, home, "labels").select(*KEYS, T, "event_binary"), [*KEYS, T])
    found = sanity.warnings(sanity.feature_aucs(labelled, validation.comparable(stored, [*KEYS, T, "feature_window_sec"]), "event_binary"))
    return [{"feature": r["feature"], "auc": r["auc"], "reason": r["reason"]} for r in found.orderBy("feature").collect()]  # a row for each feature


def validate(spark: SparkSession, config: RunConfig, home: str, scope: str = "all") -> list[dict]:
    """Check a stored run, and write the reports."""
    found = validation.all_passed(findings(spark, config, home, scope))
    if validation.label_module_imports(labels):
        found.append({"check": "labels_independent_of_features", "violations": 1, "passed": False})
    warned = auc_warnings(spark, config, home) if scope == "all" else []
    tables.write_json(f"{home}/reports/validation.json", {"findings": found, "warnings": warned, **tables.SAFETY})
    tables.write_text(f"{home}/reports/validation.html", tables.html_report(found))
    statistics(tables.read_table(spark, home, "latent_timeline"), truth.FACTORS, ["person_id", "context_state"]).write.mode("overwrite").parquet(f"{home}/reports/statistics")
    counts(tables.read_table(spark, home, "events"), tables.read_table(spark, home, "splits") if scope == "all" else None).write.mode("overwrite").parquet(f"{home}/reports/counts")
    return found


def statistics(df: DataFrame, columns: tuple[str, ...], keys: list[str]) -> DataFrame:
    """Rows, and mean and spread of columns, by keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def counts(events: DataFrame, split: DataFrame | None) -> DataFrame:
    """Events by split, person and type, with totals at each level (a null stands for all)."""
    rows = splits.assign(events, split) if split is not None else events.withColumn("split", F.lit(None).cast("string"))
    return rows.rollup("split", "person_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("intensity_truth").cast("double")).alias("intensity_mean"))
