"""Configuration, seeds, truth tables, labels, features, splits and checks of the synthetic timeline."""

import copy

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.functions import seeds, spectral
from pulsegrid.functions.timecols import SECOND
from pulsegrid.operators import devices, eeg, features, intervals, labels, sanity, splits, truth, validation, windows
from pulsegrid.plans import cli, run
from pulsegrid.sources import config as cfg
from pulsegrid.sources import tables

QUICK = cfg.builtin("quick")


# configuration


def broken(change):
    raw = copy.deepcopy(QUICK.model_dump(mode="json"))
    change(raw)
    return raw


BAD = {
    "unknown key": lambda r: r.update(extra=1), "probability": lambda r: r["population"].update(no_response_probability=1.5), "min above max": lambda r: r["events"]["phases_sec"]["peak"].update(min=500),
    "rate": lambda r: r["devices"]["headband"]["eeg"].update(sample_rate_hz=512), "unit": lambda r: r["devices"]["strap"]["ecg"].update(unit="mV"), "channels": lambda r: r["devices"]["headband"]["eeg"].update(channels=["tp9"]),
    "count": lambda r: r["run"].update(participant_count=0), "canonical rate": lambda r: r["run"].update(canonical_rate_hz=2), "weights": lambda r: r["population"]["response_archetypes"].update(eeg_first=0.9),
    "hard negatives": lambda r: r["events"]["hard_negatives"].update(quiet_cognitive_load=0.0), "splits": lambda r: r["splits"]["fractions"].update(test=0.5), "not UTC": lambda r: r["run"].update(start_time_utc="2026-01-01T00:00:00+09:00"),
    "strap range": lambda r: r["devices"]["strap"]["acc"].update(range_abs=16), "strap rate": lambda r: r["devices"]["strap"]["acc"].update(sample_rate_hz=99), "capability": lambda r: r["devices"]["headband"]["ppg"].update(enabled=True),
    "on demand": lambda r: r["devices"]["watch"].update(on_demand_ecg={"sample_rate_hz": 500, "channels": ["ecg"], "unit": "uV"}),
    "direction": lambda r: r["pattern"]["latent_effects"]["cognitive_load"]["direction_probabilities"].update(increase=0.9), "strength": lambda r: r["pattern"]["response_strength"]["eeg"].update(max=1.5),
    "missing modality": lambda r: r["pattern"]["lag_sec"].pop("eda"), "mains": lambda r: r["artifacts"].update(line_noise_hz=55), "meals": lambda r: r["context"]["meals"].update(daily_count=-1),
    "two on demand": lambda r: r["devices"]["watch"].update(on_demand_ecg={"sample_rate_hz": 500, "channels": ["ecg"], "unit": "uV", "on_demand": "calibration_only"}, on_demand_ppg={"sample_rate_hz": 100, "channels": ["green"], "unit": "au", "on_demand": "calibration_only"}),
}


@pytest.mark.parametrize("name", BAD)
def test_bad_configuration_is_rejected(name):
    with pytest.raises(cfg.ConfigError):
        cfg.parse(broken(BAD[name]))


def test_profiles_extend_and_estimate(tmp_path):
    assert cfg.parse(QUICK.model_dump(mode="json")) == QUICK
    assert cfg.estimate(QUICK)["canonical_rows"] == 64_800 and cfg.estimate(cfg.builtin("mvp"))["canonical_rows"] == 5_184_000
    assert cfg.run_id(QUICK) == cfg.run_id(cfg.builtin("quick")) != cfg.run_id(cfg.builtin("mvp"))
    (tmp_path / "a.yaml").write_text("extends: b.yaml\n")
    (tmp_path / "b.yaml").write_text("extends: a.yaml\n")
    with pytest.raises(cfg.ConfigError):
        cfg.load(str(tmp_path / "a.yaml"))
    assert cli.main(["estimate", "--config", "quick"]) == 0 and cli.main(["inspect-config", "--config", str(tmp_path / "a.yaml")]) == 2
    assert "properties" in cfg.json_schema()


# seeds


def test_seed_equals_driver_and_ignores_partitions(spark):
    df = spark.range(500).select("id", seeds.child_seed(1, "p", F.col("id")).alias("s"))
    one, many = ({r.id: r.s for r in df.repartition(n).collect()} for n in (1, 7))
    assert one == many and one[3] == seeds.child_seed_value(1, "p", 3) and len(set(one.values())) == 500


def test_distributions(spark):
    s = F.col("s")
    df = spark.range(4000).select(seeds.child_seed(2, F.col("id")).alias("s")).select(
        seeds.normal(s, "z").alias("z"), seeds.truncated_normal(s, "t", 10, 2.5, 6, 17).alias("t"), seeds.beta(s, "b", 4.0, 8.0).alias("b"), seeds.beta(s, "c", 2.2, 2.0).alias("c"), seeds.discrete_uniform(s, "d", 1, 4).alias("d"),
        seeds.categorical(s, "k", {"x": 0.2, "y": 0.8}).alias("k"), seeds.lognormal(s, "l", 35, 1.6).alias("l"), seeds.fast_normal(s, F.lit(3)).alias("f"),
    ).toPandas()
    assert abs(df.z.mean()) < 0.06 and abs(df.z.std() - 1) < 0.05 and abs(df.f.std() - 1) < 0.05
    assert df.t.between(6, 17).all() and abs(df.b.mean() - 1 / 3) < 0.01 and abs(df.b.var() - 4 * 8 / (144 * 13)) < 0.003 and abs(df.c.mean() - 2.2 / 4.2) < 0.02
    assert set(df.d) == {1, 2, 3, 4} and abs((df.k == "x").mean() - 0.2) < 0.03 and abs(df.l.median() - 35) < 1.5
    z = [seeds.normal(s, i) for i in range(2)]
    pair = spark.range(4000).select(seeds.child_seed(3, F.col("id")).alias("s")).select(*[c.alias(n) for c, n in zip(seeds.correlated(z, [[1, -0.5], [-0.5, 1]]), "ab", strict=True)]).toPandas()
    assert abs(pair.corr().iloc[0, 1] + 0.5) < 0.05


# truth


@pytest.fixture(scope="module")
def quick(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    made = run.generate(spark, QUICK, root, truth_only=True)
    return f"{root}/{cfg.run_id(QUICK)}", made


def test_quick_run_passes_and_repeats(spark, quick, tmp_path):
    home, made = quick
    assert made["tables"]["latent_timeline"]["rows"] == 64_800 and made["synthetic"] and made["non_diagnostic"] and made["not_for_clinical_use"]
    assert [f for f in run.validate(spark, QUICK, home, "truth") if not f["passed"]] == []
    ev = tables.read_table(spark, home, "events")
    assert {r["count"] for r in ev.filter("is_target").groupBy("person_id").count().collect()} == {2}
    spark.conf.set("spark.sql.shuffle.partitions", "5")  # another cut of the work gives the same content
    again = run.generate(spark, QUICK, str(tmp_path), truth_only=True)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {k: v["hash"] for k, v in again["tables"].items()} == {k: v["hash"] for k, v in made["tables"].items()}


def test_checks_find_what_is_wrong(spark, quick):
    ev, latent = (tables.read_table(spark, quick[0], t) for t in ("events", "latent_timeline"))
    n = lambda df: df.first()["violations"]
    assert n(validation.event_ids(ev.union(ev.limit(1)))) == 1
    assert n(validation.phase_order(ev.withColumn("onset_time_ns", F.col("end_time_ns") + 1))) == ev.count()
    assert n(validation.targets_complete(ev.withColumn("peak_end_time_ns", F.lit(None).cast("long")))) == ev.filter("is_target").count()
    cut = latent.filter("seconds_from_start <> 100")
    assert n(validation.monotone(cut, ["run_id", "person_id"], "truth_time_ns")) == 3 and n(validation.row_count(cut, 64_800, "x")) == 3
    assert n(validation.monotone(latent.union(latent.limit(2)), ["run_id", "person_id"], "truth_time_ns")) == 2
    assert n(validation.factor_range(latent.withColumn("cognitive_load", F.lit(1.5)), truth.FACTORS)) == 64_800
    assert n(validation.truth_leak(ev, "events")) == 1 and n(validation.split_overlap(spark.createDataFrame([("a", "x"), ("a", "y")], "person_id string, split string"))) == 1
    with pytest.raises(ValueError):
        tables.require_no_truth(ev)


def test_labels_match_events(spark, quick):
    ev, latent = (tables.read_table(spark, quick[0], t) for t in ("events", "latent_timeline"))
    out = labels.label_timeline(run.grid_of(latent), ev, tables.read_table(spark, quick[0], "artifacts")).toPandas()
    assert len(out) == 64_800
    for e in ev.filter("is_target").collect():
        mine = out[out.person_id == e.person_id]
        inside = mine[(mine.canonical_time_ns >= e.start_time_ns) & (mine.canonical_time_ns < e.end_time_ns)]
        assert (inside.event_id == e.event_id).all() and inside.event_binary.all()
        at = lambda s, mine=mine, e=e: mine[mine.canonical_time_ns == e.onset_time_ns + s * SECOND].iloc[0]
        assert at(0).event_phase == "onset" and at(0).time_since_onset_sec == 0 and at(-1).time_to_onset_sec == 1
        for h in labels.HORIZONS:
            got = [bool(at(s)[f"will_target_start_within_{h}s"]) for s in (1, 0, -1, -(h - 1), -h, -(h + 1))]
            assert got == [False, False, True, True, True, False]
    assert not validation.label_module_imports(labels)
    for text in ("from pulsegrid.operators import features", "import pulsegrid.operators.features", "from pulsegrid.operators.features import eda"):
        assert validation.forbidden_imports(text)


def test_artifacts_and_clocks(spark):
    c = cfg.builtin("mvp")
    clocks = devices.clock_models(spark, c).toPandas()
    assert len(clocks) == 36 and clocks[clocks.device_id == "strap"].initial_offset_ms.abs().max() <= 250
    a = devices.artifacts(spark, QUICK)
    assert a.count() > 50 and a.filter("end_time_ns <= start_time_ns OR severity NOT BETWEEN 0 AND 1").isEmpty() and a.select("artifact_id").distinct().count() == a.count()


def test_native_streams_keep_their_contracts(spark):
    c = cfg.builtin("golden")
    ev = truth.events(spark, c)
    latent = truth.latent_timeline(spark, c, ev).filter("seconds_from_start BETWEEN 100 AND 129")
    rows = devices.native(latent, truth.participants(spark, c), devices.artifacts(spark, c).limit(0), None, c).cache()
    assert {(r.stream_name, r.sample_rate_hz) for r in rows.select("stream_name", "sample_rate_hz").distinct().collect()} == {
        ("eeg", 256), ("headband_acc", 52), ("ecg", 130), ("strap_acc", 100), ("hr_rr", 1), ("acc", 25), ("eda", 1), ("hr_ibi", 1), ("ppg", 25), ("temperature", 1)}
    timed = devices.with_clocks(rows, devices.clock_models(spark, c), c.run.start_ns)
    each = devices.samples(timed)
    assert each.filter("stream_name = 'eeg'").count() == 30 * 256 * 4 and timed.filter("receive_time_ns < device_time_ns").isEmpty()
    fit = devices.aligned(rows, latent.withColumn("truth_time_ns", F.col("truth_time_ns") - F.lit(100 * SECOND).cast("long")), devices.clock_models(spark, c), c)
    assert fit.count() == rows.count() and fit.filter("abs(alignment_residual_sec) > 1").isEmpty()
    one = devices.one_second_summaries(rows).toPandas()
    assert len(one) == 30 and (one.eeg_tp9_coverage_ratio == 1).all() and one.wrist_vm.between(0.3, 3).all() and one.ecg_rpeak_count.between(0, 4).all() and one.ecg_rpeak_count.sum() > 20


def test_alignment_undoes_offset_and_drift(spark):
    c = cfg.builtin("mvp")
    start = c.run.start_ns
    latent = spark.range(0, 432_000, 30).select(F.lit("r").alias("run_id"), F.lit("P001").alias("person_id"), (F.lit(start).cast("long") + F.col("id") * SECOND).alias("truth_time_ns"))
    clocks = spark.createDataFrame([("r", "P001", d, o, p, j, 7) for d, o, p, j in (("headband", -300.0, 30.0, 4.0), ("strap", 2600.0, -20.0, 6.0), ("watch", 500.0, 40.0, 12.0))], "run_id string, person_id string, device_id string, initial_offset_ms double, drift_ppm double, jitter_ms_std double, seed long")
    rows = devices.marks(latent, c)
    timed = windows.written(devices.with_clocks(rows, clocks, start))
    track = windows.written(devices.clock_track(devices.heard(timed)))
    assert timed.filter(F.abs(F.col("device_time_ns") - F.col("second_ns")) > 15 * SECOND).count() > 0
    out = windows.written(devices.align(timed, track))
    late = F.col("second_ns") - F.lit(start).cast("long") > 600 * SECOND
    assert out.count() == rows.count() and out.filter(late & (F.abs(F.col("alignment_residual_sec")) > 0.1)).isEmpty() and out.filter("abs(alignment_residual_sec) > 0.5").isEmpty()
    settled = out.filter(F.col("second_ns") - F.lit(start).cast("long") > 86_400 * SECOND).agg(F.max(F.abs("alignment_residual_sec"))).first()[0]
    assert 0 < settled < 0.06
    moved = devices.on_grid(out.withColumn("true_ns", F.col("second_ns")))
    assert moved.filter("second_ns <> true_ns").isEmpty()
    raw = devices.on_grid(timed.withColumns({"aligned_time_ns": F.col("device_time_ns"), "true_ns": F.col("second_ns")}))  # clocks as they are
    assert raw.filter("second_ns <> true_ns").count() > raw.count() / 2


def test_alignment_does_not_look_ahead(spark):
    """Cutting the recording anywhere leaves every earlier aligned time as it is, and gaps keep the last estimate."""
    c = cfg.builtin("mvp")
    start = c.run.start_ns
    clocks = spark.createDataFrame([("r", "P001", d, o, p, j, 7) for d, o, p, j in (("headband", -300.0, 30.0, 4.0), ("watch", 500.0, 40.0, 12.0))], "run_id string, person_id string, device_id string, initial_offset_ms double, drift_ppm double, jitter_ms_std double, seed long")
    seconds = spark.range(0, 7200, 7).filter("id < 2000 OR id > 4000").select(F.lit("r").alias("run_id"), F.lit("P001").alias("person_id"), (F.lit(start).cast("long") + F.col("id") * SECOND).alias("second_ns"))
    rows = devices.with_clocks(seconds.crossJoin(spark.createDataFrame([("headband", "eeg", 256), ("watch", "eda", 1)], "device_id string, stream_name string, sample_rate_hz int")), clocks, start)
    marks = devices.with_clocks(devices.marks(spark.range(0, 7200).filter("id < 2000 OR id > 4000").select(F.lit("r").alias("run_id"), F.lit("P001").alias("person_id"), (F.lit(start).cast("long") + F.col("id") * SECOND).alias("truth_time_ns")), c), clocks, start)
    whole = windows.written(devices.align(rows, devices.clock_track(devices.heard(marks))))
    assert whole.count() == rows.count() and whole.filter("abs(alignment_residual_sec) > 0.5").isEmpty()
    for cut in (30, 1803, 3600, 5000):
        before = F.col("second_ns") < F.lit(start + cut * SECOND).cast("long")
        part = devices.align(rows.filter(before), devices.clock_track(devices.heard(marks.filter(before))))
        assert part.exceptAll(whole.filter(before)).isEmpty() and part.count() > 0


def test_timeline_is_in_aligned_seconds(spark):
    c = cfg.builtin("golden")
    latent = truth.latent_timeline(spark, c, truth.events(spark, c)).filter("seconds_from_start BETWEEN 60 AND 179")
    clocks = devices.clock_models(spark, c).withColumns({"initial_offset_ms": F.lit(5400.0), "drift_ppm": F.lit(40.0)})
    rows = devices.native(latent, truth.participants(spark, c), devices.artifacts(spark, c).limit(0), None, c).filter("device_id = 'watch'")
    plain = devices.one_second_summaries(rows).select("canonical_time_ns", "eda_us", "skin_temp_c", "wrist_vm")
    timed = devices.aligned(rows, latent, clocks, c)
    assert timed.filter("device_time_ns - second_ns < 5000000000").isEmpty()
    assert devices.one_second_summaries(devices.on_grid(timed)).select(plain.columns).exceptAll(plain).isEmpty()


# what events, tendencies and artifacts cause


@pytest.fixture(scope="module")
def effects(spark):
    c = cfg.builtin("mvp")
    big = c.model_copy(update={"run": c.run.model_copy(update={"participant_count": 60})})
    ev = windows.written(truth.events(spark, big))
    return truth.event_effects(ev, truth.participants(spark, big), big).join(ev.select("event_id", F.col("event_type").alias("t")), "event_id").toPandas()


def test_hard_negatives_move_what_their_kind_moves(effects):
    for kind, of in truth.HARD_EFFECTS.items():
        rows = effects[effects.event_type == kind]
        if kind == "sensor_artifact_episode":
            assert rows.empty  # no latent effect at all
            continue
        for m, gain in of.items():
            if kind == "recovery_without_peak":
                assert set(np.sign(rows[f"gain_{m}"])) == ({0.0, 1.0} if gain else {0.0})
            else:
                assert (np.sign(rows[f"gain_{m}"]) == np.sign(gain)).all() and rows[f"gain_{m}"].abs().max() <= abs(gain) + 1e-9
    quiet = effects[effects.event_type == "recovery_without_peak"]
    assert ((quiet.gain_eeg > 0) ^ (quiet.gain_eda > 0)).all() and quiet.onset_time_ns.isna().all() and quiet.peak_end_time_ns.isna().all()


def test_archetypes_order_and_scale_modalities(effects):
    t = effects[effects.is_target]
    lag = t.groupby("archetype")[[f"lag_{m}_ns" for m in truth.MODALITIES]].mean() / 1e9
    assert lag.lag_eeg_ns["eeg_first"] < lag.lag_cardiac_ns["eeg_first"] < lag.lag_motor_ns["eeg_first"] and lag.lag_cardiac_ns["autonomic_first"] < lag.lag_eeg_ns["autonomic_first"] < lag.lag_motor_ns["autonomic_first"]
    assert lag.lag_motor_ns["motor_first"] < lag.lag_cardiac_ns["motor_first"] < lag.lag_eeg_ns["motor_first"]
    size = t.groupby("archetype")[[f"gain_{m}" for m in truth.MODALITIES]].agg(lambda x: x.abs().mean())
    assert size.gain_motor["quiet_internal"] < 0.3 * size.gain_motor["eeg_first"] and size.gain_cardiac["motor_dominant"] < 0.6 * size.gain_cardiac["eeg_first"]
    partial = t[t.archetype == "partial_response"]
    assert ((partial[[f"gain_{m}" for m in truth.MODALITIES]] != 0).sum(axis=1) <= 2).all()
    assert all(t[f"lag_{m}_ns"].between(r.min * 1e9, r.max * 1e9).all() for m, r in QUICK.pattern.lag_sec.items())


def test_directions_and_exceptions_follow_their_probabilities(effects):
    t = effects[effects.is_target & ~effects.archetype.isin(["partial_response"])]
    moved = t[t.gain_cardiac != 0]
    assert 0.75 < (moved.gain_cardiac > 0).mean() < 0.97  # 0.80 of 0.85, a tenth turned round
    assert 0.1 < (t.gain_cardiac == 0).mean() < 0.45  # unchanged, silent or missing
    cardiac_only = ((t.gain_cardiac == 0) & (t.gain_eda != 0)).mean()  # one factor, so only a missing modality parts them
    assert 0.01 < cardiac_only < 0.1
    assert 0.04 < t.pre_late_start_time_ns.isna().mean() < 0.18


def test_timeline_shows_what_events_do(spark):
    ev = windows.written(truth.events(spark, QUICK))
    loud = windows.written(truth.states(spark, QUICK, ev))
    assert loud.count() == 64_800 and loud.filter("drive_motor > 0.2 AND target_id IS NULL").count() > 0  # an ordinary activity
    still = truth.states(spark, QUICK, ev.limit(0)).filter("drive_eeg <> 0 OR drive_cardiac <> 0 OR drive_eda <> 0 OR drive_motor <> 0 OR target_id IS NOT NULL")
    assert still.isEmpty()


def test_no_factor_tells_targets_apart_and_drifts_move_levels(spark, quick):
    latent = tables.read_table(spark, quick[0], "latent_timeline")
    aucs = sanity.feature_aucs(latent.withColumn("y", F.col("active_target_event_id").isNotNull()), [*truth.FACTORS, "eda_drive"], "y").toPandas()
    assert np.maximum(aucs.auc, 1 - aucs.auc).max() < 0.9
    c = cfg.builtin("mvp")
    c = c.model_copy(update={"run": c.run.model_copy(update={"participant_count": 12, "duration_sec": 86_400})})
    days = truth.daily_context(spark, c).select("person_id", "activity_drift_truth").toPandas().set_index("person_id").activity_drift_truth
    level = truth.latent_timeline(spark, c, truth.events(spark, c).limit(0)).filter("context_state = 'wake_rest'").groupBy("person_id").agg(F.avg("motor_activation").alias("m")).toPandas().set_index("person_id").m
    assert np.corrcoef(days[level.index], level)[0, 1] > 0.8


def test_timeline_compiles_without_falling_back(spark):
    """Generated code that outgrows a method fails here instead of being interpreted."""
    ev = windows.written(truth.events(spark, QUICK))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        truth.latent_timeline(spark, QUICK, ev).write.format("noop").mode("overwrite").save()
        grid = truth.canonical_grid(spark, QUICK).select("run_id", "person_id", F.col("truth_time_ns").alias("canonical_time_ns"))
        labels.label_timeline(grid, ev, devices.artifacts(spark, QUICK)).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def seconds(n=4, **changes):
    columns = {"truth_time_ns": (1_767_225_600 + np.arange(n)) * SECOND, "seed": np.full(n, 77), "beat_micro": np.cumsum([0] + [1_200_000] * (n - 1)), "rate_micro": np.full(n, 1_200_000)}
    level = {"autonomic_arousal": 0.3, "motor_activation": 0.3, "cognitive_load": 0.3, "eda_drive": 0.3, "eeg_aperiodic_exponent_truth": 1.5, "eeg_relative_alpha_truth": 0.3, "eeg_relative_gamma_truth": 0.1,
             "eda_tonic_level_us_truth": 3.0, "sensor_tolerance_truth": 0.0, "rr_ms": 833.0}
    return devices.Seconds(columns | {k: np.full(n, float(v)) for k, v in (level | changes).items()})


STREAM_OF = {"eeg": ("headband", "eeg", 256), "ecg": ("strap", "ecg", 130), "ppg": ("watch", "ppg", 25), "eda": ("watch", "eda", 1), "acc": ("watch", "acc", 25)}


def made(stream, kind=None, severity=0.9, channel=None, n=4):
    fault = [] if kind is None else [{"stream_name": stream, "artifact_type": kind, "channel": channel, "severity": severity}]
    channels, x, gone, quality, missing = devices.make_stream(seconds(n), *STREAM_OF[stream], [[], fault, fault, []], 60)
    return channels, np.where(gone, np.nan, x), quality, missing


@pytest.mark.parametrize("stream,kind", [(s, k) for s, rows in devices.ARTIFACTS.items() for k, *_ in rows] + [("eeg", "random_missing"), ("ecg", "block_dropout")])
def test_each_artifact_acts_in_its_own_way(stream, kind):
    channel = "af7" if kind in ("channel_dropout", "electrode_pop", "impedance_drift") else None
    channels, plain, *_ = made(stream)
    severity = 0.5 if kind == "loss" else 0.9
    _, x, quality, missing = made(stream, kind, severity, channel)
    assert np.array_equal(plain[[0, 3]], x[[0, 3]]) and (quality[[0, 3]] == 1).all() and quality[1] == pytest.approx(1 - severity)  # other seconds are as they were
    a, b = plain[1:3], x[1:3]
    d = np.nan_to_num(b - a)
    ch = {c: i for i, c in enumerate(channels)}
    if kind in devices.DROPS:
        share = np.isnan(b).mean(axis=(0, 2))
        assert missing[1] == devices.DROPS[kind]
        if kind == "channel_dropout":
            assert share[ch["af7"]] == 1 and share.sum() == 1
        else:
            assert (share == 1).all() if devices.DROPS[kind] == "block" else ((0 < share) & (share < 1)).all()
        return
    assert missing[1] is None and np.isfinite(b).all()
    spread = np.abs(d).max(axis=(0, 2))
    expected = {
        "blink": lambda: spread[ch["af7"]] > 3 * spread[ch["tp9"]], "jaw_emg": lambda: spread[ch["tp9"]] > 1.5 * spread[ch["af7"]] and np.abs(np.diff(d[0, 0])).mean() > 20,
        "head_motion": lambda: np.allclose(d[:, 0], d[:, 1], atol=1.1), "electrode_pop": lambda: spread[ch["af7"]] > 100 and spread.sum() == spread[ch["af7"]], "impedance_drift": lambda: spread[ch["af7"]] > 10 and spread.sum() == spread[ch["af7"]],
        "common_mode": lambda: np.allclose(d[:, 0], d[:, 3], atol=1.1) and spread[0] > 50, "mains": lambda: abs(np.fft.rfftfreq(256, 1 / 256)[np.abs(np.fft.rfft(d[0, 0])).argmax()] - 60) < 1,
        "clipping": lambda: (np.abs(b) >= (999 if stream == "eeg" else 7.9)).any(), "flatline": lambda: np.ptp(b, axis=2).max() == 0, "baseline_wander": lambda: spread[0] > 30, "motion": lambda: np.abs(d).mean() > 40,
        "missed_peak": lambda: b.max() < 500 < a.max(), "extra_peak": lambda: (np.abs(d) > 500).any(axis=2).all() and d.max() > 500, "ectopic_like": lambda: d.min() < -500 and d.max() > 500,
        "motion_coupling": lambda: np.allclose(d[:, 0], d[:, 1], atol=1.1) and spread[0] > 10, "amplitude_modulation": lambda: np.ptp(b, axis=2).max() < 0.6 * np.ptp(a, axis=2).max(), "ambient_leak": lambda: d.mean() > 300,
        "saturation": lambda: (b == 4096).all(), "drift": lambda: spread[0] >= 0, "sparse_scr": lambda: (d >= 0).all(), "motion_spike": lambda: spread[0] > 0.1, "dry_skin": lambda: (b < 0.5 * a).all(),
        "quantisation": lambda: np.allclose(b * 10, np.round(b * 10), atol=0.15), "bias": lambda: np.allclose(d, d[:, :, :1], atol=0.001) and spread[0] > 0.02, "scale": lambda: np.allclose(b, a * 1.135, atol=0.001),
        "rotation": lambda: np.allclose((b**2).sum(axis=1), (a**2).sum(axis=1), atol=0.01) and spread[0] > 0.01, "gravity_leak": lambda: spread[2] > 0.2 and spread[0] == 0, "jitter": lambda: 0 < spread[0] < np.ptp(a[:, 0]),
    }[kind]
    assert expected()


def test_beat_artifacts_reach_the_interval_streams():
    at = lambda kind: devices.make_stream(seconds(2), "strap", "hr_rr", 1, [[], [{"stream_name": "ecg", "artifact_type": kind, "channel": None, "severity": 0.5}]], 60)[1][:, 1, 0]
    assert at("missed_peak")[1] == pytest.approx(2 * 833, abs=5) and at("extra_peak")[1] == pytest.approx(833 / 2, abs=5) and at("missed_peak")[0] == pytest.approx(833, abs=5)


def test_packets_have_delays_of_their_own(spark):
    c = cfg.builtin("golden")
    latent = truth.latent_timeline(spark, c, truth.events(spark, c)).filter("seconds_from_start < 40")
    rows = devices.native(latent, truth.participants(spark, c), devices.artifacts(spark, c).limit(0), None, c)
    each = devices.samples(devices.with_clocks(rows, devices.clock_models(spark, c), c.run.start_ns)).filter("stream_name = 'eeg' AND channel = 'tp9'").toPandas().sort_values("sample_index")
    assert len(each) == 40 * 256 and (each.receive_time_ns > each.device_time_ns).all()
    per = each.groupby("packet_id").agg(n=("sample_index", "size"), at=("receive_time_ns", "median"), spread=("receive_time_ns", lambda x: x.max() - x.min()), last=("device_time_ns", "max"))
    late = (per["at"] - per["last"]) / 1e6
    assert per.n.max() == devices.PACKET and late.nunique() > 500 and 20 < late.median() < 60 and (np.diff(per["at"]) < 0).any()  # some are overtaken
    assert per.spread.median() < 60e6


def test_clip_is_a_slice_and_beats_are_where_the_ecg_has_them(spark):
    from pulsegrid.plans import catalogue

    c, ev, latent, people, days, faults = catalogue.golden_truth(spark)
    got = catalogue.clip_is_slice(spark, "").first()
    assert (got["only_in_clips"], got["differing"]) == (0, 0)
    rows = devices.native(latent, people, faults.limit(0), None, c, days)
    beats = devices.heart(latent, people).filter("rr_ms IS NOT NULL").select("truth_time_ns", "rr_ms").toPandas()
    assert len(beats) > 590 and beats.rr_ms.between(300, 1500).all() and beats.rr_ms.std() > 5
    found = devices.intervals_by_second(devices.peaks(rows, "ecg", "ecg", 0.7), "ecg_rr_ms").toPandas().set_index("canonical_time_ns").ecg_rr_ms
    both = beats.set_index("truth_time_ns").rr_ms.reindex(found.index).dropna()
    assert len(both) > 500 and (found[both.index] - both).abs().median() < 12  # a sample of the ECG is 7.7 ms


# windows, intervals, features


def test_trailing_is_causal_and_equals_plain_windows(spark):
    rng = np.random.default_rng(0)
    rows = [(int(p), int(t), float(v)) for p in range(3) for t, v in zip(np.unique(rng.integers(0, 5000, 300)), rng.normal(size=300), strict=False)]
    df = spark.createDataFrame(rows, "p int, t long, v double")
    agg = {"m": lambda w: F.round(F.avg("v").over(w), 9), "n": lambda w: F.count("v").over(w)}
    from pyspark.sql import Window

    w = Window.partitionBy("p").orderBy("t").rangeBetween(-99, 0)
    plain = df.select("*", *[f(w).alias(n) for n, f in agg.items()])
    for block in (7, 100, 640, 10_000):
        assert windows.trailing(df, ["p"], "t", 100, agg, block).exceptAll(plain).isEmpty()
    with pytest.raises(ValueError):
        windows.trailing(df, ["p"], "t", 10, agg, until=1)
    marked = df.withColumn("x", F.when(F.col("t") % 7 == 0, F.col("t")))
    back = marked.select("p", "t", F.last("x", ignorenulls=True).over(Window.partitionBy("p").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)).alias("x"))
    ahead = marked.select("p", "t", F.first("x", ignorenulls=True).over(Window.partitionBy("p").orderBy("t").rangeBetween(0, Window.unboundedFollowing)).alias("x"))
    for block in (50, 900, 10_000):
        assert windows.latest(marked, ["p"], "t", ["x"], block).select("p", "t", "x").exceptAll(back).isEmpty()
        assert windows.upcoming(marked, ["p"], "t", ["x"], block).select("p", "t", "x").exceptAll(ahead).isEmpty()
        both = windows.nearest(marked.withColumn("y", F.col("x")), ["p"], "t", ["x"], ["y"], block)
        strict = marked.select("p", "t", F.first("x", ignorenulls=True).over(Window.partitionBy("p").orderBy("t").rangeBetween(1, Window.unboundedFollowing)).alias("y"))
        assert both.select("p", "t", "x").exceptAll(back).isEmpty() and both.select("p", "t", "y").exceptAll(strict).isEmpty()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 150), st.integers(-5, 60)), max_size=8), st.integers(1, 70))
def test_interval_join_equals_definition(spark, spans, bucket):
    points = [(p, t) for p in range(3) for t in range(-10, 120, 7)]
    a = spark.createDataFrame(points, "p int, t long")
    b = spark.createDataFrame([(p, s, s + n, i) for i, (p, s, n) in enumerate(spans)], "p int, s long, e long, i int")
    found = sorted(tuple(r) for r in intervals.during(a, b, ["p"], "t", "s", "e", bucket, "inner").select("p", "t", "i").collect())
    assert found == sorted((p, t, i) for p, t in points for i, (q, s, n) in enumerate(spans) if p == q and s <= t < s + n)


def grid(spark, n, values):
    base = {c: None for c in ("hr_bpm", "rr_ms", "eda_us", "ecg_rpeak_count", "ecg_coverage_ratio", "watch_hr_bpm", "watch_ibi_ms", "ppg_green_dc", "ppg_green_ac", "skin_temp_c", "quality_min", "eeg_tp9_rms_uv", "eeg_af7_rms_uv", "eeg_af8_rms_uv", "eeg_tp10_rms_uv")}
    base |= {f"{x}_{k}": None for x in ("wrist", "head", "chest") for k in ("vm", "enmo", "jerk", "sma", "coverage_ratio", "x", "y", "z")}
    base |= dict.fromkeys(("ecg_rr_ms", "ppg_interval_ms", "ambient_temp_c", *[f"eeg_{c}_coverage_ratio" for c in features.CHANNELS]))
    base |= dict.fromkeys(f"eeg_{c}_1s_{n}" for c in features.CHANNELS for n in (*[f"{b}_abs_power" for b in spectral.BANDS], "spectral_entropy", "line_noise_ratio", "high_freq_artifact_ratio"))
    base |= dict.fromkeys(("ecg_rpeak_confidence", "ecg_mean_uv", "ecg_rms_uv", "ecg_line_length", "ppg_ir_ac", "ppg_red_ac", "eeg_gfp"))
    columns = sorted(base)
    rows = [("r", "P001", i * SECOND, *[float(values[c](i)) if c in values else None for c in columns]) for i in range(n)]
    return spark.createDataFrame(rows, "run_id string, person_id string, canonical_time_ns long, " + ", ".join(f"{c} double" for c in columns))


def test_closed_form_features(spark):
    t = grid(spark, 240, {"rr_ms": lambda i: 800 + 100 * (i % 2), "hr_bpm": lambda i: 60 + i / 60, "eda_us": lambda i: 3.0, "wrist_vm": lambda i: 1.0, "wrist_enmo": lambda i: 0.0})
    last = features.window_features(t, 180).filter(F.col("canonical_time_ns") == 239 * SECOND).first()
    assert last.rmssd_ms == pytest.approx(100) and last.pnn50 == 1 and last.rr_mean_ms == pytest.approx(850) and last.hr_slope_bpm_per_min == pytest.approx(1.0)
    assert last.eda_flatline_ratio == pytest.approx(1) and last.eda_std_us == 0 and last.wrist_enmo_mean_g == 0 and last.wrist_stillness_ratio == 1 and last.feature_valid
    assert last.watch_hr_vs_polar_hr_abs_diff_bpm is None
    early = features.window_features(t, 60).filter(F.col("canonical_time_ns") == 10 * SECOND).first()
    assert not early.feature_valid and early.hr_mean_bpm is None
    short = features.window_features(t, 5, families=("cardiac",))
    assert "rmssd_ms" not in short.columns
    leak = validation.future_leak(t, lambda d: features.window_features(d, 30), 120 * SECOND, features.KEYS, features.T, ["hr_mean_bpm", "rmssd_ms"])
    assert leak.first()["violations"] == 0
    sunk = features.nan_at_sink(short.select("hr_mean_bpm"), ["hr_mean_bpm"]).toPandas()
    assert (sunk.hr_mean_bpm.isna() == ~sunk.hr_mean_bpm_valid).all()
    assert all(r["causal"] for r in features.registry()) and len(features.registry()) > 70


def test_personal_baseline_ignores_what_is_excluded(spark):
    t = spark.range(7200).select(F.lit("P").alias("p"), (F.col("id") * SECOND).alias("t"), F.when(F.col("id") < 6000, F.col("id") % 10).otherwise(100).cast("double").alias("x"), (F.col("id") % 2 == 0).alias("ok"))
    out = features.personal_baseline(t, ["p"], "t", "x", F.col("ok"), 3600 * SECOND, 1800 * SECOND, 60 * SECOND).toPandas().sort_values("t")
    assert out[out.t < 1800 * SECOND].x_personal_robust_z.isna().all() and out[out.t == 6001 * SECOND].x_personal_robust_z.iloc[0] > 1e6
    assert out[out.t == 5000 * SECOND].baseline_sample_count.iloc[0] == 1800


def test_exponential_median_against_definition(spark):
    rng = np.random.default_rng(4)
    rows = [("p", int(t), float(v)) for t, v in zip(np.unique(rng.integers(0, 500, 60)), rng.normal(size=60), strict=False)]
    got = windows.exponential_robust(spark.createDataFrame(rows, "p string, t long, v double"), ["p"], "t", "v", 30, 100, 70).toPandas().set_index("t")

    def middle(pairs):
        total, upto = sum(w for _, w in pairs), 0.0
        for v, w in sorted(pairs):
            upto += w
            if upto >= total / 2:
                return v

    for _, t, _ in rows:
        past = [(v, 0.5 ** ((t - u) / 30)) for _, u, v in rows if t - 100 <= u <= t - 1]
        if not past:
            assert np.isnan(got.ew_median[t])
        else:
            m = middle(past)
            assert got.ew_median[t] == pytest.approx(m) and got.ew_mad[t] == pytest.approx(middle([(abs(v - m), w) for v, w in past]))


def test_spectral_kernels():
    s = np.arange(1024) / 256
    x = 20 * np.sin(2 * np.pi * 10 * s)
    got = spectral.spectral_summary(x, 256)
    assert got["alpha_relative_power"] > 0.95 and abs(got["dominant_frequency_hz"] - 10) < 1 and got["spectral_entropy"] < 0.5 and got["alpha_abs_power"] == pytest.approx(200, rel=0.05)
    noise = np.random.default_rng(1).normal(size=1024)
    assert spectral.spectral_summary(noise, 256)["spectral_entropy"] > 0.9 and spectral.permutation_entropy(noise) > 0.95 and spectral.permutation_entropy(s) == 0
    assert spectral.sample_entropy(np.sin(s * 20)[:300]) < spectral.sample_entropy(noise[:300]) and spectral.sample_entropy(np.ones(50)) is None
    assert spectral.coherence(x, x, 256, 8, 13) == pytest.approx(1) and spectral.phase_locking(x, np.roll(x, 5), 256, 8, 13) > 0.95
    peak, hz = spectral.autocorrelation_peak(np.sin(2 * np.pi * 2 * np.arange(200) / 25), 25)
    assert peak > 0.8 and abs(hz - 2) < 0.2
    times = np.cumsum(np.full(400, 0.85))
    vlf, lf, hf = spectral.lomb_powers(times, 850 + 40 * np.sin(2 * np.pi * 0.1 * times))
    assert lf > 5 * hf and lf > 5 * vlf and spectral.lomb_powers(times[:20], np.ones(20)) is None
    assert all(v is None for v in spectral.spectral_summary(np.zeros(3), 256).values())


@pytest.mark.parametrize("whole", [True, False])
def test_lomb_scargle_equals_the_definition(whole):
    rng = np.random.default_rng(4)
    t = np.sort(rng.choice(400, 150, replace=False)).astype(float) + 1e5
    t = t if whole else t + rng.random(150) / 2
    y = 800 + 30 * np.sin(2 * np.pi * 0.1 * t + 1) + rng.normal(size=150)
    f = 0.003 + np.arange(90) / 300
    expected = []
    for w in 2 * np.pi * f:
        tau = np.arctan2(np.sin(2 * w * t).sum(), np.cos(2 * w * t).sum()) / (2 * w)
        c, s = np.cos(w * (t - tau)), np.sin(w * (t - tau))
        x = y - y.mean()
        expected.append(((x @ c) ** 2 / (c @ c) + (x @ s) ** 2 / (s @ s)) / len(t))
    got = spectral.lomb_scargle(t, y, 0.003, 1 / 300, 90)
    assert got == pytest.approx(np.array(expected), rel=1e-7, abs=1e-9)
    tone = 30 * np.sin(2 * np.pi * 0.1 * t + 1)
    assert spectral.lomb_scargle(t, tone, 0.1, 1.0, 1)[0] == pytest.approx(tone.var(), rel=0.02)  # all of what varies is at its frequency


def test_kernels_on_native_streams(spark):
    c = cfg.builtin("golden")
    ev = truth.events(spark, c)
    latent = truth.latent_timeline(spark, c, ev).filter("seconds_from_start BETWEEN 60 AND 179")
    rows = devices.native(latent, truth.participants(spark, c), devices.artifacts(spark, c).limit(0), None, c).cache()
    spectra = features.motion_spectra(rows, 5).cache()
    found = spectra.toPandas()
    assert len(found) == 24 and found.wrist_dominant_frequency_hz.between(1, 3).all() and found.chest_spectral_entropy.between(0, 1).all()
    again = features.repetition(spectra).toPandas()
    assert (again.repetition_duration_sec >= 0).all() and again.wrist_repetition_score.notna().all()
    transit = features.pulse_transit(devices.peaks(rows, "ecg", "ecg", 0.7), devices.peaks(rows, "ppg", "green", 0.8)).toPandas()
    assert transit.pairs.sum() > 100 and transit.ppg_ecg_pulse_transit_proxy_ms.between(50, 600).all()
    one = run.observed_timeline(rows, latent, c)
    eeg = features.eeg_features(one, 5).toPandas()
    assert len(eeg) == 24 and (eeg.eeg_valid_channel_count == 4).all() and eeg.eeg_tp9_alpha_relative_power.between(0, 1).all() and eeg.eeg_quality_score.between(0, 1).all()
    assert eeg.eeg_channel_correlation_mean.between(-1, 1).all() and (one.toPandas().eeg_gfp > 0).all()


def test_a_run_calls_every_feature_operator():
    import inspect

    called = "".join(map(inspect.getsource, (run.feature_tables, run.timeline_makers, run.write_features, run.write_onset_orders, run.clip_features, run.baseline_features)))
    assert all(f"features.{n}(" in called for n in ("hrv_kernels", "rr_entropy", "motion_spectra", "repetition", "pulse_transit", "latest_temperature", "deviation", "event_onset_orders"))


def test_hrv_kernels_and_onset_order(spark):
    t = grid(spark, 600, {"rr_ms": lambda i: 850 + 40 * np.sin(2 * np.pi * 0.1 * i)})
    k = features.hrv_kernels(t, 300).toPandas()
    assert len(k) == 2 and (k.hrv_lf_power > 5 * k.hrv_hf_power).all() and k.rr_sample_entropy.notna().all()
    with pytest.raises(ValueError):
        features.hrv_kernels(t, 60)
    z = spark.createDataFrame([("r", "p", i * SECOND, 5.0 if i >= 3 else 0.0, 9.0 if i >= 2 else None) for i in range(6)], "run_id string, person_id string, canonical_time_ns long, a_personal_robust_z double, b_personal_robust_z double")
    d = features.deviation(z, ["a", "b"])
    ev = spark.createDataFrame([("r", "p", "e", True, 0, 6 * SECOND)], "run_id string, person_id string, event_id string, is_target boolean, start_time_ns long, end_time_ns long")
    assert features.event_onset_orders(d, ev, ["a", "b"]).first()["modality_onset_order_code"] == "b>a"


def test_kernels_at_every_second(spark):
    t = grid(spark, 420, {"rr_ms": lambda i: 850 + 40 * np.sin(2 * np.pi * 0.1 * i) + i % 7})
    each, apart = (features.hrv_kernels(t, 300, stride).toPandas().set_index("canonical_time_ns").sort_index() for stride in (1, None))
    assert len(each) == 420 and each.hrv_lf_power[410 * SECOND] > 0
    assert each.loc[299 * SECOND].drop(["run_id", "person_id"]).astype(float).to_numpy() == pytest.approx(apart.loc[299 * SECOND].drop(["run_id", "person_id"]).astype(float).to_numpy())
    short = features.rr_entropy(t, 180, 1).toPandas().set_index("canonical_time_ns").rr_sample_entropy
    assert len(short) == 420 and np.isnan(short[100 * SECOND])
    assert short[250 * SECOND] == pytest.approx(spectral.sample_entropy(np.array([850 + 40 * np.sin(2 * np.pi * 0.1 * i) + i % 7 for i in range(71, 251)])))
    with pytest.raises(ValueError):
        features.rr_entropy(t, 60)


def test_eeg_entropy_sees_the_whole_window(spark):
    x = np.concatenate((np.sin(np.arange(768) / 20), np.random.default_rng(2).normal(size=5 * 256)))  # what is at the end counts
    rows = [("r", "p", i * SECOND, *[x[256 * i : 256 * (i + 1)].tolist()] * 4) for i in range(8)]
    t = spark.createDataFrame(rows, "run_id string, person_id string, canonical_time_ns long, " + ", ".join(f"eeg_{c} array<double>" for c in features.CHANNELS))
    got = features.eeg_features(t, 5, stride=1).select("canonical_time_ns", "eeg_tp9_sample_entropy", "eeg_tp9_permutation_entropy", "eeg_tp9_coverage_ratio").toPandas().set_index("canonical_time_ns").sort_index()
    assert len(got) == 8 and got.eeg_tp9_coverage_ratio[1 * SECOND] == pytest.approx(0.4)
    for end in (4, 5, 7):
        part = eeg.filtered(x.astype(np.float32).astype(float).reshape(1, 8, 256), 256, 60.0)[0, end - 4 : end + 1].ravel()
        assert got.eeg_tp9_sample_entropy[end * SECOND] == pytest.approx(spectral.sample_entropy(part)) and got.eeg_tp9_permutation_entropy[end * SECOND] == pytest.approx(spectral.permutation_entropy(part))


# splits, streaming, round trips


def test_splits():
    assert splits.largest_remainder(12, {"train": 0.67, "validation": 0.17, "test": 0.16}) == {"train": 8, "validation": 2, "test": 2}
    assert splits.largest_remainder(3, {"train": 0.67, "validation": 0.17, "test": 0.16}) == {"train": 1, "validation": 1, "test": 1}


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 500))
def test_split_counts_add_up(n):
    c = splits.largest_remainder(n, {"train": 0.67, "validation": 0.17, "test": 0.16})
    assert sum(c.values()) == n and (n < 3 or min(c.values()) >= 1)


def test_isolation_forest_finds_what_stands_apart(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(size=(2000, 3)), rng.normal(size=(20, 3)) + 7))
    df = spark.createDataFrame([(*map(float, r), i >= 2000) for i, r in enumerate(x)] + [(None, 0.0, 0.0, False)], "a double, b double, c double, far boolean")
    got = sanity.isolation_scores(df, ["a", "b", "c"]).toPandas()
    assert len(got) == 2021 and got.isolation_score.between(0, 1).all() and got[got.far].isolation_score.min() > got[~got.far].isolation_score.quantile(0.99)
    assert sanity.model_auc(df, df, ["a", "b", "c"], "far", "isolation").first()["auc"] > 0.999
    again = sanity.isolation_scores(df.repartition(5), ["a", "b", "c"]).toPandas()
    assert again.isolation_score.sum() == pytest.approx(got.isolation_score.sum())
    assert sanity.isolation_scores(df.limit(0), ["a"]).count() == 0


def test_whole_recording_can_be_stored(spark, tmp_path, monkeypatch):
    c = cfg.builtin("golden").model_copy(update={"native_storage": "all"})
    assert cfg.builtin("full_raw").native_storage == "all" and cfg.estimate(c)["clip_seconds"] == 600
    monkeypatch.setattr(run, "write_features", lambda *a, **k: [])
    made = run.generate(spark, c, str(tmp_path))
    assert made["tables"]["native"]["rows"] == 6000 and made["tables"]["timeline_1hz"]["rows"] == 600


def test_split_is_by_person_and_stable(spark):
    people = spark.range(100).select(F.concat(F.lit("P"), F.col("id")).alias("person_id"))
    a = splits.by_person(people, 1, QUICK.splits.fractions)
    b = splits.by_person(people.repartition(9), 1, QUICK.splits.fractions)
    assert a.exceptAll(b).isEmpty() and {r.split: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 67, "validation": 17, "test": 16}


def test_auc_by_ranges_equals_one_range(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") % 37).cast("double").alias("s"), (F.col("id") % 3 == 0).alias("y"))
    one = splits.auc(df, "s", "y").first()["auc"]
    p = df.toPandas()
    a, b = p[p.y].s.values, p[~p.y].s.values
    assert one == pytest.approx(((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / len(a) / len(b))


def test_no_group_is_ordered_in_one_partition(spark):
    from pulsegrid.plans import catalogue

    rng = np.random.default_rng(3)
    rows = [("hot" if p % 5 else None if p % 2 else "p", int(t), float(v)) for p, t, v in zip(rng.integers(0, 20, 900), rng.integers(0, 2000, 900), rng.integers(0, 90, 900), strict=True)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    p = df.toPandas()
    got = {r.k: (r.m, r.d) for r in windows.group_mad(df, ["k"], "v", "m", "d").collect()}
    for key, g in p.groupby("k", dropna=False):
        key = None if key != key else key
        assert got[key] == pytest.approx((g.v.median(), (g.v - g.v.median()).abs().median()))
    hot = df.filter("k = 'hot'").select("k", "t").distinct()
    for block in (7, 300, 5000):
        seen = windows.lagged(hot, ["k"], "t", "t", "before", block).toPandas().sort_values("t")
        assert seen.before.isna().sum() == 1 and (seen.before.to_numpy()[1:] == seen.t.to_numpy()[:-1]).all()
    plan = catalogue.rmssd_sdnn_pnn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    for a in splits.auc(df.withColumn("y", F.col("t") % 3 == 0), "v", "y", ["k"]).collect():
        g = p[p.k.isna() if a.k is None else p.k == a.k]
        pos, neg = g[g.t % 3 == 0].v.values, g[g.t % 3 != 0].v.values
        assert a.auc == pytest.approx(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg))


def test_stream_equals_batch(spark, tmp_path):
    from pulsegrid.streaming import incremental

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartitionByRange(4, "ts")
    last = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 40 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("x").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    events.unionByName(last).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))  # the last row moves the watermark past all others
    for name, make in (("hourly", incremental.hourly), ("sessions", lambda e: incremental.activity_sessions(e, "12 hours"))):
        stream = make(incremental.read_events(spark, str(tmp_path / "in"), events.schema, 100))
        incremental.run_to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}_cp"))
        got, batch = spark.read.parquet(str(tmp_path / name)).filter("user_id >= 0"), make(events)
        assert got.count() == batch.count() and got.exceptAll(batch).isEmpty()


def test_parquet_round_trip_and_manifest(spark, quick, capsys):
    home, made = quick
    for name, entry in made["tables"].items():
        assert tables.content_hash(tables.read_table(spark, home, name)) == {"rows": entry["rows"], "hash": entry["hash"]}
    tables.read_table(spark, home, "latent_timeline").filter("person_id = 'P001' AND seconds_from_start > 5").explain("formatted")
    pushed = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(person_id" in pushed and "PushedFilters: [IsNotNull(seconds_from_start)" in pushed


def test_golden_run_end_to_end(spark, tmp_path, capsys):
    """Generate, validate and read back a whole run: every table, report and provenance file."""
    import json
    import os

    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    assert cli.main(["generate", "--config", "golden", "--output", str(tmp_path)], spark) == 0
    c = cfg.builtin("golden")
    home = f"{tmp_path}/{cfg.run_id(c)}"
    report = json.load(open(f"{home}/reports/validation.json"))
    assert all(f["passed"] for f in report["findings"]) and {"no_perfect_feature", "hard_negatives_overlap", "safety_flags_and_neutral_names", "features_registered", "person_id_does_not_decide"} <= {f["check"] for f in report["findings"]}
    files = set(os.listdir(f"{home}/provenance")) | set(os.listdir(f"{home}/provenance/source_config"))
    assert {"manifest.json", "licences.csv", "sbom.json", "resolved_config.json", "0_golden.yaml", "1_mvp.yaml"} <= files
    assert json.load(open(f"{home}/provenance/sbom.json"))["bomFormat"] == "CycloneDX"
    z = tables.read_table(spark, home, "features_baseline")
    assert {f"{n}_personal_robust_z" for n in features.Z_FEATURES} < set(z.columns) and z.count() == 600
    for w in c.features.windows_sec:
        f = tables.read_table(spark, home, f"features_{w}s")
        assert f.count() == 600 and {"eeg_af7_alpha_relative_power", "watch_ppg_pulse_rate_bpm", "polar_rr_ecg_median_ms"} < set(f.columns)
    before = os.path.getmtime(f"{home}/model_ready/features_5s")
    assert cli.main(["features", "--config", "golden", "--output", str(tmp_path)], spark) == 0  # nothing is missing, so nothing is written
    assert os.path.getmtime(f"{home}/model_ready/features_5s") == before
    assert tables.read_table(spark, home, "evaluations").count() == 1
    # nothing has changed since the layer was made, so an update makes nothing
    assert set(run.update_features(spark, c, home).values()) == {0} and os.path.getmtime(f"{home}/model_ready/features_5s") == before


def test_exponential_median_sorts_bounded_arrays(spark, monkeypatch):
    """Ties, nulls, NaN, one hot person and cuts at any size; no window is collected row by row in the plan."""
    rng = np.random.default_rng(9)
    rows = [("hot" if k % 3 else None if k % 2 else f"p{k % 7}", int(rng.integers(0, 300)), None if k % 11 == 0 else float("nan") if k % 53 == 0 else float(rng.integers(0, 6)), k) for k in range(700)]
    df = spark.createDataFrame(rows, "p string, t long, v double, id long").repartition(3)

    def middle(pairs):
        half, upto = sum((w for _, w in pairs), 0.0) / 2, 0.0
        for v, w in sorted(pairs, key=lambda x: (np.isnan(x[0]), x)):
            upto += w
            if upto >= half:
                return v

    for block, cells in ((60, 1 << 16), (200, 7)):
        monkeypatch.setattr(windows, "CELLS_AT_ONCE", cells)
        out = windows.exponential_robust(df, ["p"], "t", "v", 30, 100, block)
        assert "collect_list" not in out._jdf.queryExecution().toString()
        got = {r.id: (r.ew_median, r.ew_mad) for r in out.collect()}
        assert len(got) == len(rows)
        for p, t, _, k in rows:
            past = [(v, 0.5 ** ((t - u) / 30)) for q, u, v, _ in rows if q == p and t - 100 <= u < t and v is not None]
            m = middle(past) if past else None
            expected = (m, middle([(abs(v - m), w) for v, w in past])) if past else (None, None)
            assert all(a == b or a is not None and b is not None and np.isnan(a) and np.isnan(b) for a, b in zip(got[k], expected, strict=True)), (p, t, got[k], expected)


def test_models_score_what_repeats_once(spark, monkeypatch):
    """Rows that share features and label are one scored row, and count as often as they occur."""
    rng = np.random.default_rng(7)
    rows = [(float(a), float(b) if b else None, bool(y)) for a, b, y in zip(rng.integers(0, 4, 3000), rng.integers(0, 3, 3000), rng.random(3000) < 0.3, strict=True)]
    df, scored, make = spark.createDataFrame(rows, "a double, b double, y boolean"), [], sanity.isolation_forest
    one_by_one = splits.auc(sanity.isolation_scores(df, ["a", "b"]).select(F.round("isolation_score", 6).alias("p"), "y"), "p", "y").first()

    def spy(*args, **more):
        add = make(*args, **more)
        return lambda x: (scored.append(x.count()), add(x))[1]

    monkeypatch.setattr(sanity, "isolation_forest", spy)
    got = sanity.model_auc(df, df, ["a", "b"], "y", "isolation").first()
    assert (got.positives, got.negatives, got.auc) == (one_by_one.positives, one_by_one.negatives, pytest.approx(one_by_one.auc)) and scored == [24]
    for kind in ("logistic", "forest"):
        found = sanity.model_auc(df, df, ["a", "b"], "y", kind).first()
        assert (found.positives, found.negatives) == (got.positives, got.negatives) and 0.45 < found.auc < 0.6
