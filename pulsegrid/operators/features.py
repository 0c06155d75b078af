"""Causal window features over the 1 Hz timeline.

All windows are trailing and bounded, share one partitioning (person, block of time), and give null where fewer than
the required share of the window's seconds is there; the sink turns null into NaN beside a validity flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import arrays, spectral
from pulsegrid.functions.timecols import SECOND, floor_div
from pulsegrid.operators import eeg as eeg_kernels
from pulsegrid.operators.intervals import during
from pulsegrid.operators.sliding import Frame, Frames
from pulsegrid.operators.windows import latest, sessions, tasks_of, trailing, upcoming
from pulsegrid.sources.tables import require_no_truth

KEYS, T = ["run_id", "person_id"], "canonical_time_ns"
#: Least windows in seconds of heart-rate variability, by family.
SHORTEST = {"hrv_time": 30, "hrv_nonlinear": 180, "hrv_frequency": 300}
CHANNELS = ("tp9", "af7", "af8", "tp10")
LOCATIONS = ("wrist", "head", "chest")
#: Seconds by which one signal may follow another.
LAGS = (0, 5, 10, 20)


def slope_per_minute(w: Frame, x: str) -> Column:
    """Least-squares slope; null with fewer than two values."""
    return w.slope(x) * F.lit(60.0 * SECOND)


def whole(c: Column) -> Column:
    """A count, as a whole number."""
    return F.round(c).cast("long")


def basic(w: Frame, x: str, name: str, unit: str) -> dict[str, Column]:
    return {
        f"{name}_mean_{unit}": w.avg(x), f"{name}_median_{unit}": w.median(x), f"{name}_min_{unit}": w.min(x), f"{name}_max_{unit}": w.max(x), f"{name}_std_{unit}": w.stddev_samp(x),
        f"{name}_slope_{unit}_per_min": slope_per_minute(w, x),
    }


def cardiac(w: Frame, window: int) -> dict[str, Column]:
    rr, d = F.col("rr_ms"), F.col("_drr")
    plausible = w.avg(rr.between(300, 2000).cast("double"))
    device, ecg = w.median(rr), w.median("ecg_rr_ms")
    out = basic(w, "hr_bpm", "hr", "bpm") | {
        "hr_acceleration_bpm_per_sec": w.avg("_dhr"), "polar_rr_device_median_ms": device, "polar_rr_ecg_median_ms": ecg, "polar_rr_source_disagreement_ms": F.abs(device - ecg),
        "ecg_rpeak_count": whole(w.sum("ecg_rpeak_count")), "ecg_rr_valid_ratio": plausible,
        "ecg_rr_missed_peak_suspect_count": whole(w.sum((rr > F.lit(1.6) * F.col("_rr_med")).cast("double"))),
        "ecg_rr_extra_peak_suspect_count": whole(w.sum((rr < F.lit(0.6) * F.col("_rr_med")).cast("double"))),
        "ecg_coverage_ratio": w.avg("ecg_coverage_ratio"), "ecg_rpeak_confidence_mean": w.avg("ecg_rpeak_confidence"),
        "ecg_baseline_wander_score": F.try_divide(w.stddev_samp("ecg_mean_uv"), F.nullif(w.avg("ecg_rms_uv"), F.lit(0.0))),
        "ecg_motion_artifact_score": F.abs(w.corr("ecg_line_length", "chest_enmo")),
        "ecg_quality_score": w.avg("ecg_coverage_ratio") * plausible * w.avg("ecg_rpeak_confidence"),
    }
    if window >= SHORTEST["hrv_time"]:
        enough = lambda v: F.when(w.count(rr) >= 30, v)
        out |= {
            "rr_mean_ms": enough(w.avg(rr)), "rr_median_ms": enough(device), "rr_mad_ms": enough(w.mad(rr)), "sdnn_ms": enough(w.stddev_samp(rr)), "rmssd_ms": enough(F.sqrt(w.avg(d * d))),
            "sdsd_ms": enough(w.stddev_samp(d)), "pnn20": enough(w.avg((F.abs(d) > 20).cast("double"))), "pnn50": enough(w.avg((F.abs(d) > 50).cast("double"))),
            "cvnn": enough(F.try_divide(w.stddev_samp(rr), w.avg(rr))),
        }
        if window >= SHORTEST["hrv_nonlinear"]:
            sd1 = F.sqrt(w.var_samp(d) / 2)
            sd2 = F.sqrt(F.greatest(2 * w.var_samp(rr) - w.var_samp(d) / 2, F.lit(0.0)))
            out |= {"poincare_sd1_ms": enough(sd1), "poincare_sd2_ms": enough(sd2), "poincare_sd1_sd2_ratio": enough(F.try_divide(sd1, sd2))}
    return out


def eda(w: Frame, window: int) -> dict[str, Column]:
    x, scr = F.col("eda_us"), F.col("_scr")
    tonic = w.median(x)
    flat, spikes, there = w.avg((F.abs("_deda") < 1e-6).cast("double")), w.avg((F.abs("_deda") > 1.0).cast("double")), w.count(x) / F.lit(float(window))
    height = F.when(scr, F.col("_scr_amp"))
    return basic(w, "eda_us", "eda", "us") | {
        "eda_tonic_level_us": tonic, "eda_phasic_level_us": w.row(x) - tonic, "eda_scr_count": whole(w.sum(scr.cast("double"))), "eda_scr_amplitude_mean_us": w.avg(height),
        "eda_scr_amplitude_max_us": w.max(height), "eda_scr_area_us_sec": w.sum(F.greatest(F.col("_phasic"), F.lit(0.0))), "eda_flatline_ratio": flat, "eda_spike_ratio": spikes,
        "eda_coverage_ratio": there, "eda_variability": w.stddev_samp(x), "eda_time_since_last_scr_sec": (F.col(T) - w.row("_last_scr")) / F.lit(float(SECOND)),
        "eda_quality_score": there * (1 - spikes) * (1 - flat),
    }


def motion(w: Frame, window: int) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for loc in LOCATIONS:
        vm, there = F.col(f"{loc}_vm"), w.sum(f"{loc}_coverage_ratio") / F.lit(float(window))
        out |= {
            f"{loc}_acc_vm_mean_g": w.avg(vm), f"{loc}_acc_vm_std_g": w.stddev_samp(vm), f"{loc}_enmo_mean_g": w.avg(f"{loc}_enmo"), f"{loc}_sma_g": w.avg(f"{loc}_sma"),
            f"{loc}_jerk_mean_g_per_sec": w.avg(f"{loc}_jerk"), f"{loc}_jerk_p95_g_per_sec": w.percentile(f"{loc}_jerk", 0.95), f"{loc}_stillness_ratio": w.avg((F.abs(vm - 1) < 0.05).cast("double")),
            f"{loc}_activity_burst_count": whole(w.sum(f"_{loc}_burst")), f"{loc}_coverage_ratio": there, f"{loc}_orientation_change_rate": w.avg(f"_{loc}_turn"),
            f"{loc}_quality_score": F.least(there, F.lit(1.0)),
        }
    return out


def optical(w: Frame, window: int) -> dict[str, Column]:
    ac, full = w.avg("ppg_green_ac"), w.avg((F.col("ppg_green_dc") >= 4090).cast("double"))
    return {
        "watch_ppg_pulse_rate_bpm": F.lit(60_000.0) / w.median("ppg_interval_ms"), "watch_skin_temp_mean_c": w.avg("skin_temp_c"), "watch_ppg_green_dc": w.avg("ppg_green_dc"), "watch_ppg_green_ac_amplitude": ac,
        "watch_ppg_pulse_amplitude_variability": F.try_divide(w.stddev_samp("ppg_green_ac"), ac), "watch_ppg_motion_correlation": w.corr("ppg_green_ac", "wrist_enmo"), "watch_ppg_saturation_ratio": full,
        "watch_skin_temp_slope_c_per_min": slope_per_minute(w, "skin_temp_c"), "watch_temp_coverage_ratio": w.count("skin_temp_c") / F.lit(float(window)), "watch_ppg_ir_ac_amplitude": w.avg("ppg_ir_ac"),
        "watch_ppg_red_ac_amplitude": w.avg("ppg_red_ac"), "watch_ppg_quality_score": w.count("ppg_green_ac") / F.lit(float(window)) * (1 - full),
    }


def cross_modal(w: Frame, window: int, lags: tuple[int, ...] = LAGS) -> dict[str, Column]:
    residual = lambda x, m: w.row(x) - (w.regr_intercept(x, m) + w.regr_slope(x, m) * w.row(m))
    best = lambda x, y: F.greatest(*[w.corr(x, f"_{y}_lag{k}") for k in lags])
    hr_gap, rr_gap = F.abs(F.col("watch_hr_bpm") - F.col("hr_bpm")), F.abs(F.col("watch_ibi_ms") - F.col("rr_ms"))
    return {
        "watch_hr_vs_polar_hr_abs_diff_bpm": w.row(hr_gap), "watch_ibi_vs_polar_rr_abs_diff_ms": w.row(rr_gap), "hr_motion_conditioned_residual": residual("hr_bpm", "wrist_enmo"),
        "eda_motion_conditioned_residual": residual("eda_us", "wrist_enmo"), "eda_hr_lag_corr_max": best("eda_us", "hr_bpm"), "eda_motion_lag_corr_max": best("eda_us", "wrist_enmo"),
        "eeg_motion_lag_corr_max": best("_eeg_rms", "wrist_enmo"), "cross_modal_synchrony_score": (w.corr("hr_bpm", "eda_us") + w.corr("hr_bpm", "wrist_enmo") + w.corr("eda_us", "wrist_enmo")) / 3,
        "multisensor_valid_axis_count": sum(((w.count(c) >= 0.8 * window).cast("int") for c in ("hr_bpm", "eda_us", "wrist_vm", "_eeg_rms")), F.lit(0)),
        "cross_device_disagreement_score": (w.avg(hr_gap / 10) + w.avg(rr_gap / 100)) / 2, "eeg_global_field_power": w.avg("eeg_gfp"), "eeg_motion_correlation": w.corr("_eeg_rms", "head_vm"),
        "multisensor_quality_min": w.min("quality_min"), "multisensor_quality_mean": w.avg("quality_min"),
    }


def eeg(w: Frame, window: int) -> dict[str, Column]:
    """Band powers over whole seconds (Welch's mean of one-second segments), their shares and ratios, entropy, asymmetry, and what is noise."""
    out: dict[str, Column] = {}
    for c in CHANNELS:
        powers = {b: w.avg(f"eeg_{c}_1s_{b}_abs_power") for b in spectral.BANDS}
        total = sum(powers.values(), F.lit(0.0))
        out |= {f"eeg_{c}_{b}_abs_power": p for b, p in powers.items()} | {f"eeg_{c}_{b}_relative_power": F.try_divide(p, total) for b, p in powers.items()}
        out |= {f"eeg_{c}_theta_beta_ratio": F.try_divide(powers["theta"], powers["beta"]), f"eeg_{c}_beta_alpha_ratio": F.try_divide(powers["beta"], powers["alpha"])}
        out |= {f"eeg_{c}_{n}": w.avg(f"eeg_{c}_1s_{n}") for n in ("spectral_entropy", "line_noise_ratio", "high_freq_artifact_ratio")}
        out |= {f"eeg_{c}_rms_uv": F.sqrt(w.avg(F.col(f"eeg_{c}_rms_uv") * F.col(f"eeg_{c}_rms_uv"))), f"eeg_{c}_coverage_ratio": w.sum(f"eeg_{c}_coverage_ratio") / F.lit(float(window))}
    log = lambda c: F.log(F.nullif(w.avg(f"eeg_{c}_1s_alpha_abs_power"), F.lit(0.0)))
    out["eeg_frontal_alpha_asymmetry_af7_af8"] = log("af8") - log("af7")
    out["eeg_temporal_alpha_asymmetry_tp9_tp10"] = log("tp10") - log("tp9")
    out["eeg_valid_channel_count"] = sum(((w.sum(f"eeg_{c}_coverage_ratio") >= 0.8 * window).cast("int") for c in CHANNELS), F.lit(0))
    return out


FAMILIES = {"cardiac": cardiac, "eda": eda, "motion": motion, "optical": optical, "cross_modal": cross_modal, "eeg": eeg}
#: Timeline columns that each family reads.
NEEDS = {
    "cardiac": ("hr_bpm", "rr_ms", "ecg_rr_ms", "ecg_rpeak_count", "ecg_coverage_ratio", "ecg_rpeak_confidence", "ecg_mean_uv", "ecg_rms_uv", "ecg_line_length", "chest_enmo"),
    "eda": ("eda_us",), "motion": tuple(f"{loc}_{n}" for loc in LOCATIONS for n in ("vm", "enmo", "jerk", "sma", "coverage_ratio")),
    "optical": ("ppg_interval_ms", "skin_temp_c", "ppg_green_dc", "ppg_green_ac", "ppg_ir_ac", "ppg_red_ac", "wrist_enmo"),
    "cross_modal": ("hr_bpm", "rr_ms", "watch_hr_bpm", "watch_ibi_ms", "eda_us", "wrist_enmo", "wrist_vm", "head_vm", "eeg_gfp", "quality_min"),
    "eeg": tuple(f"eeg_{c}_{n}" for c in CHANNELS for n in ("rms_uv", "coverage_ratio", *(f"1s_{b}_abs_power" for b in spectral.BANDS), "1s_spectral_entropy", "1s_line_noise_ratio", "1s_high_freq_artifact_ratio")),
}


def _norm(location: str, of) -> Column:
    return F.sqrt(sum((of(f"{location}_{a}") * of(f"{location}_{a}") for a in "xyz"), F.lit(0.0)))


def prepared(timeline: DataFrame, families: tuple[str, ...] = tuple(FAMILIES), lags: tuple[int, ...] = LAGS) -> DataFrame:
    """The columns that families read, with differences, lags and short medians: one pass of short trailing windows."""
    frames = Frames(KEYS, T)
    here, short, rising = frames.frame(1), frames.frame(29 * SECOND + 1), frames.frame(7 * SECOND + 1, -SECOND)
    before, row = (lambda c, k=1: here.at(c, k * SECOND)), frames.row
    made: dict[str, Column] = {c: row(c) for f in families for c in NEEDS[f]}
    change = lambda c: row(c) - before(c)
    if "cardiac" in families:
        made |= {"_drr": change("rr_ms"), "_dhr": change("hr_bpm"), "_rr_med": short.median("rr_ms")}
    if "eda" in families:
        last, rise = before("eda_us"), before("eda_us") - rising.min("eda_us")
        made |= {"_deda": change("eda_us"), "_phasic": row("eda_us") - short.median("eda_us"), "_scr_amp": rise, "_scr": (last > before("eda_us", 2)) & (last >= row("eda_us")) & (rise > 0.03)}
    if "motion" in families:
        for x in LOCATIONS:
            product = sum((row(f"{x}_{a}") * before(f"{x}_{a}") for a in "xyz"), F.lit(0.0))
            cosine = F.try_divide(product, F.nullif(_norm(x, row) * _norm(x, before), F.lit(0.0)))
            made[f"_{x}_turn"] = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
            made[f"_{x}_burst"] = ((row(f"{x}_enmo") > 0.1) & (F.coalesce(before(f"{x}_enmo"), F.lit(0.0)) <= 0.1)).cast("double")
    if "cross_modal" in families:
        made["_eeg_rms"] = row(sum((F.col(f"eeg_{c}_rms_uv") for c in CHANNELS), F.lit(0.0)) / 4)
        made |= {f"_{c}_lag{k}": before(c, k) if k else row(c) for c in ("hr_bpm", "wrist_enmo") for k in lags}
    out = frames.answer(timeline, 3600 * SECOND).select(*KEYS, T, *[c.alias(n) for n, c in made.items()])
    if "eda" in families:
        out = latest(out.withColumn("_last_scr", F.when(F.col("_scr"), F.col(T))), KEYS, T, ["_last_scr"], 3600 * SECOND)
    return out


def window_tables(timeline: DataFrame, windows: tuple[int, ...], minimum_coverage: float = 0.8, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """Features of all windows from one pass: key, ``feature_window_sec``, ``feature_valid`` and features.

    A row for each second and window.  Features are null where coverage is short, or the window too short for them.
    """
    frames, by_window = Frames(KEYS, T), {}
    for window in windows:
        w = frames.frame(window * SECOND)
        features: dict[str, Column] = {}
        for f in families:
            features |= FAMILIES[f](w, window)
        ok = w.rows() >= minimum_coverage * window
        by_window[window] = {"feature_window_sec": F.lit(window).cast("short"), "feature_valid": ok} | {n: F.when(ok, c) for n, c in features.items()}
    answered = frames.answer(prepared(timeline, families), max(8 * max(windows), 1800) * SECOND)
    if len(windows) == 1:
        return require_no_truth(answered.select(*KEYS, T, *[c.alias(n) for n, c in by_window[windows[0]].items()]))
    names = list(dict.fromkeys(n for made in by_window.values() for n in made))
    kinds = {f.name: f.dataType for made in by_window.values() for f in answered.select(*[c.alias(n) for n, c in made.items()]).schema.fields}
    rows = [F.struct(*[made.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names]) for made in by_window.values()]
    return require_no_truth(answered.select(*KEYS, T, F.inline(F.array(*rows))))


def window_features(timeline: DataFrame, window: int, minimum_coverage: float = 0.8, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """features_{window}s: key, features and ``feature_valid``; null where coverage is short."""
    return window_tables(timeline, (window,), minimum_coverage, families)


def names_of(window: int, families: tuple[str, ...] = tuple(FAMILIES)) -> list[str]:
    """Features of one window, in order."""
    w = Frames(KEYS, T).frame(window * SECOND)
    return [n for f in families for n in FAMILIES[f](w, window)]


def eeg_features(timeline: DataFrame, window: int, rate: int = 256, stride: int | None = None, mains: float = 60.0) -> DataFrame:
    """Spectral and time-domain EEG features of each whole window, and of pairs of channels.

    Windows end every ``stride`` seconds (at multiples of their length by default), and are labelled with the second on
    which they end: no sample after it is used.  Noise shares, coverage, clipping and spectra see the samples as they
    came; what follows the waveform, and entropies and pairs, see them as the causal filters leave them.
    """
    clean = eeg_kernels.kernels(timeline, window, rate, mains)
    both = timeline.select(*KEYS, T, *[F.col(f"eeg_{c}") for c in CHANNELS]).join(clean.select(*KEYS, T, *[f"clean_{c}" for c in CHANNELS]), [*KEYS, T])
    samples = {c: F.col(f"eeg_{c}") for c in CHANNELS} | {f"_c_{c}": F.col(f"clean_{c}") for c in CHANNELS}
    out = windowed(both, samples, window, stride).withColumns({c: F.filter(F.flatten(c), lambda v: v.isNotNull()) for c in samples})
    summary = spectral.summary_udf(rate, mains)
    for c in CHANNELS:
        out = out.withColumn(f"_s_{c}", summary(F.col(c)))
    columns = [*KEYS, T]
    for c in CHANNELS:
        columns += [F.col(f"_s_{c}.{n}").alias(f"eeg_{c}_{n}") for n in spectral.SUMMARY_TYPE.names]
        columns += [f(F.col(f"_c_{c}")).alias(f"eeg_{c}_{n}") for n, f in (("rms_uv", arrays.rms), ("peak_to_peak_uv", arrays.peak_to_peak), ("line_length", arrays.line_length), ("zero_crossing_rate", arrays.zero_crossing_rate),
                    ("hjorth_activity", arrays.variance), ("hjorth_mobility", arrays.hjorth_mobility), ("hjorth_complexity", arrays.hjorth_complexity))]
        columns += [(F.size(c) / F.lit(float(rate * window))).alias(f"eeg_{c}_coverage_ratio"), arrays.share(F.col(c), lambda v: F.abs(v) >= 999).alias(f"eeg_{c}_clipping_ratio"),
                    arrays.share(F.col(c), lambda v: F.abs(v) > 200).alias(f"eeg_{c}_extreme_amplitude_ratio"), arrays.share(arrays.differences(F.col(c)), lambda d: F.abs(d) < 1e-9).alias(f"eeg_{c}_flatline_ratio")]
    log = lambda c: F.log(F.col(f"_s_{c}.alpha_abs_power"))
    columns += [(log("af8") - log("af7")).alias("eeg_frontal_alpha_asymmetry_af7_af8"), (log("tp10") - log("tp9")).alias("eeg_temporal_alpha_asymmetry_tp9_tp10")]
    noise = sum((F.coalesce(F.col(f"_s_{c}.line_noise_ratio"), F.lit(1.0)) + F.coalesce(F.col(f"_s_{c}.high_freq_artifact_ratio"), F.lit(1.0)) for c in CHANNELS), F.lit(0.0)) / len(CHANNELS)
    quality = F.greatest(1 - noise, F.lit(0.0)) * F.least(sum((F.size(c) for c in CHANNELS), F.lit(0)) / F.lit(float(rate * window * len(CHANNELS))), F.lit(1.0))
    columns += [quality.alias("eeg_quality_score"), (quality < 0.3).alias("eeg_artifact_dominant")]
    columns += [sum(((F.size(c) >= 0.8 * rate * window).cast("int") for c in CHANNELS), F.lit(0)).alias("eeg_valid_channel_count")]
    entropies = clean.select(*KEYS, T, *[F.col(f"{c}_{n}").alias(f"eeg_{c}_{n}") for c in CHANNELS for n in ("sample_entropy", "permutation_entropy")])
    pairs = eeg_kernels.pair_tables(timeline, (window,), rate, mains).drop("feature_window_sec")
    return require_no_truth(out.select(*columns).join(entropies, [*KEYS, T]).join(pairs, [*KEYS, T]))


def personal_baseline(df: DataFrame, keys: list[str], t: str, value: str | dict[str, str], eligible: Column, lookback: int, warmup: int, bucket: int, epsilon: float = 1e-9) -> DataFrame:
    """Robust z of ``value`` against its eligible past: (x - median) / (1.4826 MAD + epsilon), as ``<value>_personal_robust_z``.

    Several values, each by the name of its z, share one pass; age, count and confidence are those of the first.  The
    past is held as one median for each ``bucket`` of time and strictly before the present bucket, so a row costs
    lookback / bucket values instead of one for each sample.
    """
    values = {value: value} if isinstance(value, str) else value
    first = next(iter(values.values()))
    marked = df.withColumn("_bucket", floor_div(F.col(t), bucket))
    ok = {n: F.when(eligible, F.col(c)) for n, c in values.items()}
    buckets = marked.groupBy(*keys, "_bucket").agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{n}") for n, c in ok.items()], F.count(F.when(eligible, F.col(first))).alias("_n"))
    frames = Frames(keys, "_bucket")
    past = frames.frame(lookback // bucket, -1)
    began = past.min(F.when(F.col("_n") > 0, F.col("_bucket")))
    stats = {f"_med_{n}": past.median(f"_m_{n}") for n in values} | {f"_mad_{n}": past.mad(f"_m_{n}") for n in values}
    stats |= {"baseline_sample_count": F.coalesce(whole(past.sum("_n")), F.lit(0).cast("long")), "baseline_age_sec": (F.col("_bucket") - began) * F.lit(bucket / SECOND)}
    stats = frames.answer(buckets).select(*keys, "_bucket", *[c.alias(n) for n, c in stats.items()])
    out = marked.join(stats, [*keys, "_bucket"])
    ready = F.col("baseline_age_sec") * SECOND >= warmup
    z = [F.when(ready, (F.col(c) - F.col(f"_med_{n}")) / (F.lit(1.4826) * F.col(f"_mad_{n}") + F.lit(epsilon))).alias(f"{n}_personal_robust_z") for n, c in values.items()]
    confidence = F.least(F.col("baseline_sample_count") * F.lit(1.0) * SECOND / F.lit(float(max(warmup, 1))), F.lit(1.0))
    return out.select(*df.columns, *z, "baseline_age_sec", "baseline_sample_count", confidence.alias("baseline_confidence"))


#: Personal z features: what each of them looks at.
Z_FEATURES = {"hr": "hr_bpm", "rmssd": "rmssd_ms", "eda": "eda_us", "eeg_alpha": "eeg_alpha", "eeg_beta_alpha": "eeg_beta_alpha", "wrist_motion": "wrist_enmo"}


def z_inputs(timeline: DataFrame, eligible: Column) -> DataFrame:
    """The columns of ``Z_FEATURES`` for each second, and whether it may enter the baseline (``ok``)."""
    over = lambda n: sum((F.col(f"eeg_{c}_1s_{n}") for c in CHANNELS), F.lit(0.0)) / len(CHANNELS)
    given = {"hr_bpm": F.col("hr_bpm"), "rr_ms": F.col("rr_ms"), "eda_us": F.col("eda_us"), "wrist_enmo": F.col("wrist_enmo"), "eeg_alpha": over("alpha_abs_power"),
             "eeg_beta_alpha": F.try_divide(over("beta_abs_power"), over("alpha_abs_power")), "ok": eligible}
    before = Frames(KEYS, T)
    made = {n: before.row(c) for n, c in given.items()} | {"_drr": before.row("rr_ms") - before.frame(1).at("rr_ms", SECOND)}
    changes = before.answer(timeline, 3600 * SECOND).select(*KEYS, T, *[c.alias(n) for n, c in made.items()])
    frames = Frames(KEYS, T)
    w, d = frames.frame(60 * SECOND), F.col("_drr")
    kept = {n: frames.row(n) for n in given if n != "rr_ms"} | {"rmssd_ms": F.when(w.count("rr_ms") >= 30, F.sqrt(w.avg(d * d)))}
    return frames.answer(changes, 1800 * SECOND).select(*KEYS, T, *[c.alias(n) for n, c in kept.items()])


def latest_temperature(timeline: DataFrame) -> DataFrame:
    """Skin and ambient temperature as last known at each second, and their gap."""
    filled = latest(timeline.select(*KEYS, T, "skin_temp_c", "ambient_temp_c"), KEYS, T, ["skin_temp_c", "ambient_temp_c"], 3600 * SECOND)
    return filled.select(*KEYS, T, F.col("skin_temp_c").alias("watch_skin_temp_c"), F.col("ambient_temp_c").alias("watch_ambient_temp_c"), (F.col("skin_temp_c") - F.col("ambient_temp_c")).alias("watch_skin_ambient_gap_c"))


def tumbling(t: str, window: int) -> Column:
    """The last second of the window that a row falls in: no sample after it is used."""
    return F.col(t) - F.pmod(F.col(t), F.lit(window * SECOND).cast("long")) + F.lit((window - 1) * SECOND).cast("long")


def windowed(df: DataFrame, values: dict[str, Column], window: int, stride: int | None = None) -> DataFrame:
    """Arrays of ``values`` (nulls left out) in order of time, over windows that end every ``stride`` seconds.

    Windows that don't overlap are groups; others trail each row in blocks of time, so a row is read 1.1 times on average.
    """
    there = {n: F.when(c.isNotNull(), F.struct(F.col(T).alias("t"), c.alias("x"))) for n, c in values.items()}
    rows = df.select(*KEYS, T, *[c.alias(n) for n, c in there.items()])
    tasks = tasks_of(df.sparkSession)
    if stride is None or stride == window:
        out = rows.repartition(tasks, *KEYS, tumbling(T, window)).groupBy(*KEYS, tumbling(T, window).alias(T)).agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in values])
    else:
        past = trailing(rows, KEYS, T, window * SECOND, {f"_{n}": lambda w, n=n: F.collect_list(n).over(w) for n in values}, tasks=tasks)
        out = past.filter(F.pmod(F.col(T) + F.lit(SECOND).cast("long"), F.lit(stride * SECOND).cast("long")) == 0).select(*KEYS, T, *[F.col(f"_{n}").alias(n) for n in values])
    return out.withColumns({n: F.transform(n, lambda s: s["x"]) for n in values})


def hrv_kernels(timeline: DataFrame, window: int = 300, stride: int | None = None) -> DataFrame:
    """Frequency-domain powers and sample entropy of RR intervals, in windows of at least five minutes."""
    if window < SHORTEST["hrv_frequency"]:
        raise ValueError("frequency-domain features need at least 300 s")
    grouped = windowed(timeline.filter(F.col("rr_ms").isNotNull()), {"rr": F.col("rr_ms"), "at": F.col(T) / F.lit(float(SECOND))}, window, stride)
    k = spectral.hrv_udf()("at", "rr")
    out = grouped.select(*KEYS, T, k.alias("k")).select(*KEYS, T, *[F.col(f"k.{n}").alias(n) for n in ("hrv_vlf_power", "hrv_lf_power", "hrv_hf_power", "rr_sample_entropy")])
    return out.withColumns({"hrv_lf_hf_ratio": F.try_divide("hrv_lf_power", "hrv_hf_power"), "hrv_total_power": F.col("hrv_vlf_power") + F.col("hrv_lf_power") + F.col("hrv_hf_power")})


def rr_entropy(timeline: DataFrame, window: int = 180, stride: int | None = None) -> DataFrame:
    """Sample entropy of RR intervals, in windows of at least three minutes with 80 % of their values."""
    if window < SHORTEST["hrv_nonlinear"]:
        raise ValueError("nonlinear features need at least 180 s")
    grouped = windowed(timeline.filter(F.col("rr_ms").isNotNull()), {"rr": F.col("rr_ms")}, window, stride)
    value = spectral.entropy_udf()(F.when(F.size("rr") >= 0.8 * window, F.col("rr")))
    return grouped.select(*KEYS, T, value["sample_entropy"].alias("rr_sample_entropy"))


def motion_spectra(native: DataFrame, window: int = 5, stride: int | None = None) -> DataFrame:
    """Dominant frequency, spectral entropy and periodicity of each accelerometer, at its native rate."""
    out = None
    for loc, stream, rate in (("wrist", "acc", 25), ("head", "headband_acc", 52), ("chest", "strap_acc", 100)):
        ch = lambda c: F.element_at("channels", F.lit(c))
        vm = F.zip_with(F.zip_with(ch("x"), ch("y"), lambda a, b: a * a + b * b), ch("z"), lambda s, c: F.sqrt(s + c * c).cast("double"))
        rows = native.filter(F.col("stream_name") == stream).select(*KEYS, F.col("second_ns").alias(T), F.filter(vm, lambda v: v.isNotNull()).alias("vm"))
        x = windowed(rows, {"x": F.col("vm")}, window, stride).withColumn("x", F.flatten("x"))
        s = x.withColumn("s", spectral.summary_udf(float(rate))("x")).withColumn("p", spectral.periodicity_udf(float(rate))("x"))
        one = s.select(*KEYS, T, F.col("s.dominant_frequency_hz").alias(f"{loc}_dominant_frequency_hz"), F.col("s.spectral_entropy").alias(f"{loc}_spectral_entropy"), F.col("p.autocorr_peak").alias(f"{loc}_autocorr_peak"),
                       (F.greatest(F.col("p.autocorr_peak"), F.lit(0.0)) * (1 - F.col("s.spectral_entropy"))).alias(f"{loc}_periodicity_score"))
        out = one if out is None else out.join(one, [*KEYS, T], "full_outer")
    return out


def repetition(spectra: DataFrame, window: int = 5, least: float = 0.5) -> DataFrame:
    """Repetition scores of wrist and head, how long the wrist has kept repeating, and how steady its frequency is."""
    r = spectra.select(*KEYS, T, F.col("wrist_periodicity_score").alias("wrist_repetition_score"), F.col("head_periodicity_score").alias("head_repetition_score"), "wrist_autocorr_peak", "wrist_dominant_frequency_hz", "head_dominant_frequency_hz")
    on = r.filter(F.col("wrist_autocorr_peak") >= least)
    w = Window.partitionBy(*KEYS, "session_start").orderBy(T).rowsBetween(Window.unboundedPreceding, 0)
    runs = sessions(on, KEYS, T, window * SECOND)
    f = F.col("wrist_dominant_frequency_hz")
    held = runs.select(*KEYS, T, ((F.col(T) - F.col("session_start")) / F.lit(float(SECOND)) + window).alias("repetition_duration_sec"), (1 / (1 + F.coalesce(F.try_divide(F.stddev_samp(f).over(w), F.nullif(F.avg(f).over(w), F.lit(0.0))), F.lit(0.0)))).alias("repetition_frequency_stability"))
    out = r.join(held, [*KEYS, T], "left").withColumn("repetition_duration_sec", F.coalesce("repetition_duration_sec", F.lit(0.0)))
    same = 1 / (1 + F.abs(f - F.col("head_dominant_frequency_hz")))
    return out.withColumn("cross_location_repetition_coherence", F.sqrt(F.greatest("wrist_repetition_score", F.lit(0.0)) * F.greatest("head_repetition_score", F.lit(0.0))) * same)


def pulse_transit(ecg_peaks: DataFrame, ppg_peaks: DataFrame, window: int = 60, longest_ms: float = 600.0) -> DataFrame:
    """Median delay from each heart beat to the first pulse at or after it, by window."""
    beats = ecg_peaks.select(*KEYS, "t", F.lit(True).alias("beat"), F.lit(None).cast("long").alias("pulse"))
    both = beats.unionByName(ppg_peaks.select(*KEYS, "t", F.lit(False).alias("beat"), F.col("t").alias("pulse")))
    paired = upcoming(both, KEYS, "t", ["pulse"], 600 * SECOND).filter("beat")
    delay = (F.col("pulse") - F.col("t")) / F.lit(1e6)
    return paired.filter(delay <= longest_ms).groupBy(*KEYS, tumbling("t", window).alias(T)).agg(F.percentile(delay, F.lit(0.5)).alias("ppg_ecg_pulse_transit_proxy_ms"), F.count(F.lit(1)).alias("pairs"))


def with_deviation(baselines: DataFrame, names: list[str]) -> DataFrame:
    """Add ``multisensor_deviation_score``: the mean absolute z over the modalities that have one (a feature, never a label)."""
    z = [F.col(f"{n}_personal_robust_z") for n in names]
    total = sum((F.coalesce(F.abs(c), F.lit(0.0)) for c in z), F.lit(0.0))
    there = sum((c.isNotNull().cast("int") for c in z), F.lit(0))
    return baselines.withColumn("multisensor_deviation_score", F.try_divide(total, there))


def deviation(baselines: DataFrame, names: list[str], threshold: float = 3.0) -> DataFrame:
    """The deviation score, and for each modality the time where it is far off."""
    far = [F.when(F.abs(F.col(f"{n}_personal_robust_z")) > threshold, F.col(T)).alias(f"{n}_exceeds") for n in names]
    return with_deviation(baselines, names).select(*KEYS, T, "multisensor_deviation_score", *far)


def event_onset_orders(deviations: DataFrame, events: DataFrame, names: list[str]) -> DataFrame:
    """For each target: the order in which modalities first went far off during it."""
    hits = during(deviations, events.filter("is_target").select(*KEYS, "event_id", "start_time_ns", "end_time_ns"), KEYS, T, "start_time_ns", "end_time_ns", 3600 * SECOND, "inner")
    first = hits.groupBy(*KEYS, "event_id").agg(*[F.min(f"{n}_exceeds").alias(n) for n in names])
    return first.select(*KEYS, "event_id", onset_order({n: F.col(n) for n in names}).alias("modality_onset_order_code"))


def onset_order(first_exceed: dict[str, Column]) -> Column:
    """Order in which modalities first exceeded their threshold, as names joined by ``>``; those that never did are left out."""
    rows = F.array(*[F.when(c.isNotNull(), F.struct(c.alias("t"), F.lit(n).alias("name"))) for n, c in first_exceed.items()])
    return F.array_join(F.transform(F.array_sort(F.array_compact(rows)), lambda s: s["name"]), ">")


def nan_at_sink(df: DataFrame, columns: list[str]) -> DataFrame:
    """Float features as NaN where invalid, each with its own validity flag."""
    return df.withColumns({f"{c}_valid": F.col(c).isNotNull() for c in columns} | {c: F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")) for c in columns})


#: Kernels beside the window families: modality and least window.
KERNELS = {"eeg_features": ("eeg", 5), "hrv_kernels": ("cardiac", 300), "rr_entropy": ("cardiac", 180), "motion_spectra": ("motion", 5), "repetition": ("motion", 5), "pulse_transit": ("optical", 60),
           "latest_temperature": ("optical", 1), "personal_baseline": ("personal", 1), "deviation": ("cross_modal", 1)}


def registered(columns: dict[str, list[str]]) -> list[dict]:
    """Registry entries of the columns of kernel outputs, by the name of the kernel."""
    return [{"name": c, "modality": KERNELS[k][0], "min_window_sec": KERNELS[k][1], "min_coverage": 0.8, "causal": True, "leakage_risk": "low"} for k, cs in columns.items() for c in cs]


def registry() -> list[dict]:
    """Every registered window feature with its family, least window and causality."""
    out = []
    for family in FAMILIES:
        seen: dict[str, int] = {}
        for window in (5, 30, 180, 300):
            for name in names_of(window, (family,)):
                seen.setdefault(name, window)
        out += [{"name": n, "modality": family, "min_window_sec": w, "min_coverage": 0.8, "causal": True, "leakage_risk": "low"} for n, w in seen.items()]
    return out
