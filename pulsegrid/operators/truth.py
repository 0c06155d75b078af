"""Hidden causes: participants, days, events and the 1 Hz latent timeline.

Every value is a function of named seeds, so tables don't depend on how Spark cuts the work.  Person, day and event
tables are small beside the timeline (a row for 86,400 seconds or more) and are broadcast only after a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import curves, seeds
from pulsegrid.functions.timecols import DAY, HOUR, SECOND, date_of_ns, floor_div, timestamp_of_ns
from pulsegrid.operators.labels import TARGET_COLUMNS, active_lists, by_second, instance_index, phase_at
from pulsegrid.operators.matching import deferred_acceptance
from pulsegrid.operators.windows import written
from pulsegrid.sources.config import RunConfig, run_id
from pulsegrid.sources.tables import broadcast_if_small

#: Contexts, and latent factors.
CONTEXTS = ("sleep", "wake_rest", "sedentary_activity", "light_activity", "moderate_activity", "focused_task", "meal_context", "transition")
FACTORS = ("autonomic_arousal", "motor_activation", "cognitive_load", "sleep_pressure", "sensory_context", "recovery_capacity", "social_context")
TARGET = "multimodal_arousal_episode"
#: How far resting heart rate, heart-rate variability and recovery go together.
BASELINE_COVARIANCE = [[1.0, -0.5, -0.2], [-0.5, 1.0, 0.3], [-0.2, 0.3, 1.0]]
#: Modalities, the factor whose direction and magnitude each follows, and the most that an event moves it.
MODALITIES = {"eeg": ("cognitive_load", 0.6), "cardiac": ("autonomic_arousal", 0.8), "eda": ("autonomic_arousal", 0.8), "motor": ("motor_activation", 0.6)}
#: Archetypes: for each modality which third of its lags it answers in, and how strongly.
ARCHETYPES = {
    "eeg_first": {"eeg": (0, 1.0), "cardiac": (1, 1.0), "eda": (1, 1.0), "motor": (2, 1.0)},
    "autonomic_first": {"eeg": (1, 1.0), "cardiac": (0, 1.0), "eda": (0, 1.0), "motor": (2, 1.0)},
    "motor_first": {"eeg": (2, 1.0), "cardiac": (1, 1.0), "eda": (1, 1.0), "motor": (0, 1.0)},
    "quiet_internal": {"eeg": (0, 1.0), "cardiac": (1, 0.8), "eda": (1, 0.8), "motor": (2, 0.15)},
    "motor_dominant": {"eeg": (2, 0.4), "cardiac": (1, 0.3), "eda": (1, 0.3), "motor": (0, 1.2)},
    "partial_response": {"eeg": (1, 1.0), "cardiac": (1, 1.0), "eda": (1, 1.0), "motor": (1, 1.0)},  # two of the four
    "non_responder": {"eeg": (1, 0.1), "cardiac": (1, 0.1), "eda": (1, 0.1), "motor": (1, 0.1)},
}
#: The pairs of modalities of which a partial response shows one.
PAIRS = ("eeg cardiac", "eeg eda", "eeg motor", "cardiac eda", "cardiac motor", "eda motor")
#: Hard negatives: how far each moves the modalities at full intensity.  A recovery without a peak moves the skin or the EEG alone.
HARD_EFFECTS = {
    "ordinary_physical_activity": {"eeg": 0.0, "cardiac": 0.5, "eda": 0.25, "motor": 0.8},
    "quiet_cognitive_load": {"eeg": 0.6, "cardiac": 0.15, "eda": 0.1, "motor": -0.05},
    "sensor_artifact_episode": {"eeg": 0.0, "cardiac": 0.0, "eda": 0.0, "motor": 0.0},
    "recovery_without_peak": {"eeg": 0.8, "cardiac": 0.0, "eda": 0.8, "motor": 0.0},
    "false_alarm_like_episode": {"eeg": 0.15, "cardiac": 0.4, "eda": 0.4, "motor": 0.15},
}
NO_PEAK = ("recovery_without_peak", "quiet_cognitive_load")
#: How far the drifts of a day move the levels of factors.
DRIFTS = {"sleep_pressure": ("fatigue_drift_truth", 1.0), "cognitive_load": ("fatigue_drift_truth", -0.3), "motor_activation": ("activity_drift_truth", 0.5), "autonomic_arousal": ("baseline_drift_truth", 0.7)}


def person_name(n: Column) -> Column:
    """P001 and so on; wider numbers keep all their digits."""
    digits = n.cast("string")
    return F.concat(F.lit("P"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def persons(spark: SparkSession, config: RunConfig) -> DataFrame:
    named = spark.range(1, config.run.participant_count + 1).select(F.lit(run_id(config)).alias("run_id"), person_name(F.col("id")).alias("person_id"))
    return named.withColumn("seed", seeds.child_seed(config.run.seed, "person", F.col("person_id")))


def canonical_grid(spark: SparkSession, config: RunConfig) -> DataFrame:
    """One row for each person and second; the person's number is the high part of a range, so rows split evenly."""
    n, start = config.run.duration_sec, config.run.start_ns
    row = F.col("id")
    second = F.pmod(row, F.lit(n).cast("long"))
    out = spark.range(0, config.run.participant_count * n).select(
        F.lit(run_id(config)).alias("run_id"), person_name(floor_div(row, n) + 1).alias("person_id"),
        (F.lit(start).cast("long") + second * F.lit(SECOND).cast("long")).alias("truth_time_ns"), second.alias("seconds_from_start"),
    )
    return out.withColumn("day_index", floor_div(F.col("truth_time_ns") - F.lit(start).cast("long"), DAY).cast("byte"))


def participants(spark: SparkSession, config: RunConfig) -> DataFrame:
    p, seed = config.population, F.col("seed")
    z = seeds.correlated([seeds.normal(seed, f"base{i}") for i in range(3)], BASELINE_COVARIANCE)
    shift = F.lit(p.research_prior_strength)
    clamp = lambda x, r: F.least(F.greatest(x, F.lit(float(r.min))), F.lit(float(r.max)))
    hr = clamp(F.lit(p.resting_hr_bpm.mean) + F.lit(p.resting_hr_bpm.std) * (z[0] + shift * 0.5), p.resting_hr_bpm)
    import math

    rmssd = F.lit(p.rmssd_ms.median) * F.exp(F.lit(math.log(p.rmssd_ms.geometric_std)) * (z[1] - shift * 0.5))
    real = lambda c: c.cast("float")
    return persons(spark, config).select(
        "run_id", "person_id", real(seeds.truncated_normal(seed, "age", p.age_years.mean, p.age_years.std, p.age_years.min, p.age_years.max)).alias("age_years"),
        F.when(seeds.uniform(seed, "sex") < p.female_probability, "female").otherwise("male").alias("biological_sex"),
        seeds.categorical(seed, "archetype", p.response_archetypes).alias("response_archetype"), real(hr).alias("resting_hr_bpm_truth"), real(rmssd).alias("rmssd_ms_truth"),
        real(seeds.truncated_normal(seed, "aperiodic", p.eeg_aperiodic_exponent.mean, p.eeg_aperiodic_exponent.std, p.eeg_aperiodic_exponent.min, p.eeg_aperiodic_exponent.max)).alias("eeg_aperiodic_exponent_truth"),
        real(seeds.beta(seed, "alpha", p.eeg_relative_alpha.alpha, p.eeg_relative_alpha.beta)).alias("eeg_relative_alpha_truth"),
        real(seeds.beta(seed, "gamma", p.eeg_relative_gamma.alpha, p.eeg_relative_gamma.beta)).alias("eeg_relative_gamma_truth"),
        real(seeds.lognormal(seed, "tonic", p.eda_tonic_level_us.median, p.eda_tonic_level_us.geometric_std)).alias("eda_tonic_level_us_truth"),
        real(seeds.beta(seed, "recovery", p.recovery_capacity.alpha, p.recovery_capacity.beta)).alias("recovery_capacity_truth"),
        real(seeds.uniform(seed, "opposite") * 2 * p.opposite_direction_probability).alias("opposite_response_tendency_truth"),
        real(seeds.uniform(seed, "none") * 2 * p.no_response_probability).alias("no_response_tendency_truth"),
        real(1 + (seeds.uniform(seed, "circadian") * 2 - 1) * config.context.circadian.amplitude_variation).alias("circadian_amplitude_truth"), "seed",
    )


def day_count(config: RunConfig) -> int:
    return -(-config.run.duration_sec // 86_400)


def daily_context(spark: SparkSession, config: RunConfig) -> DataFrame:
    """Person and day: sleep interval (local bedtime), and slow drifts.  A run of six hours has a day 0."""
    days = persons(spark, config).select("run_id", "person_id", F.explode(F.sequence(F.lit(0), F.lit(day_count(config) - 1))).alias("day_index"))
    seeded = days.withColumn("seed", seeds.child_seed(config.run.seed, "person", F.col("person_id"), "day", F.col("day_index")))
    seed = F.col("seed")
    midnight = F.lit(config.run.start_ns).cast("long") + F.col("day_index").cast("long") * F.lit(DAY).cast("long")
    b, d = config.context.sleep.bedtime_local_hour, config.context.sleep.duration_hours
    bed = seeds.truncated_normal(seed, "bed", b.mean, b.std, b.min, b.max) - F.lit(config.run.local_utc_offset_hours)
    sleep = F.floor(midnight + F.floor(bed * 3600) * F.lit(SECOND).cast("long")).cast("long")
    asleep = F.floor(seeds.truncated_normal(seed, "sleep", d.mean, d.std, d.min, d.max) * 3600).cast("int")
    drift = lambda name: (seeds.normal(seed, name) * 0.1).cast("float")
    return seeded.select(
        "run_id", "person_id", F.col("day_index").cast("byte").alias("day_index"), date_of_ns(midnight).alias("date_utc"), sleep.alias("sleep_start_time_ns"),
        (sleep + asleep.cast("long") * F.lit(SECOND).cast("long")).alias("sleep_end_time_ns"), asleep.alias("sleep_duration_sec"), drift("fatigue").alias("fatigue_drift_truth"),
        drift("activity").alias("activity_drift_truth"), drift("baseline").alias("baseline_drift_truth"), drift("tolerance").alias("sensor_tolerance_truth"), "seed",
    )


def context_intervals(spark: SparkSession, config: RunConfig) -> DataFrame:
    """Intervals of context with a priority: sleep over meals over bouts of activity or focus."""
    c, days = config.context, daily_context(spark, config)
    seed, s = F.col("seed"), F.lit(SECOND).cast("long")
    midnight = F.lit(config.run.start_ns).cast("long") + F.col("day_index").cast("long") * F.lit(DAY).cast("long")
    local = midnight - F.lit(config.run.local_utc_offset_hours * HOUR).cast("long")
    named = lambda context, priority, start, end: ("run_id", "person_id", context.alias("context"), F.lit(priority).alias("priority"), start.alias("start_ns"), end.alias("end_ns"))
    nights = days.select(*named(F.lit("sleep"), 0, F.col("sleep_start_time_ns"), F.col("sleep_end_time_ns")), "day_index")
    # the night before the first day, so that a run may begin asleep
    back = lambda c: F.col(c) - F.lit(DAY).cast("long")
    before = nights.filter("day_index = 0").withColumns({"start_ns": back("start_ns"), "end_ns": back("end_ns")})
    sleep = nights.unionByName(before).drop("day_index").filter(F.lit(c.sleep.enabled))
    hours = [F.lit(8 + 11 * k // max(c.meals.daily_count - 1, 1)) for k in range(c.meals.daily_count if c.meals.enabled else 0)]
    meals = days.select("run_id", "person_id", "seed", local.alias("local"), F.explode(F.array(*hours).cast("array<int>")).alias("hour"))
    at = F.col("local") + (F.col("hour") * 3600 + seeds.discrete_uniform(seed, F.concat(F.lit("meal"), F.col("hour").cast("string")), -1800, 1800)) * s
    meals = meals.select(*named(F.lit("meal_context"), 1, at, at + F.lit(1500).cast("long") * s))
    n = seeds.discrete_uniform(seed, "bouts", int(c.ordinary_activity.daily_bouts.min), int(c.ordinary_activity.daily_bouts.max))
    bouts = days.select("run_id", "person_id", "seed", local.alias("local"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("k"))
    draw = lambda name: F.concat(F.lit(name), F.col("k").cast("string"))
    kind = seeds.categorical(seed, draw("kind"), {"light_activity": 0.35, "moderate_activity": 0.2, "focused_task": 0.25, "sedentary_activity": 0.15, "transition": 0.05})
    begin = F.col("local") + seeds.discrete_uniform(seed, draw("begin"), 7 * 3600, 21 * 3600) * s
    bouts = bouts.select(*named(kind, 2, begin, begin + seeds.discrete_uniform(seed, draw("for"), 300, 3600) * s))
    return sleep.unionByName(meals).unionByName(bouts)


def events(spark: SparkSession, config: RunConfig) -> DataFrame:
    """Targets, hard negatives and artifact-only schedules of every person and day.

    The usable part of a day is cut into as many strata as there are targets; an event is moved about inside its
    stratum, so the least gap holds without iteration.
    """
    e, s = config.events, F.lit(SECOND).cast("long")
    longest = int(sum(r.max for r in e.phases_sec.values()))
    days = daily_context(spark, config).select("run_id", "person_id", "day_index", "seed")
    begin = F.lit(config.run.start_ns).cast("long") + F.col("day_index").cast("long") * F.lit(DAY).cast("long")
    seconds = F.least(F.lit(86_400), F.lit(config.run.duration_sec) - F.col("day_index").cast("int") * 86_400)
    wanted = seeds.discrete_uniform(F.col("seed"), "targets", int(e.target_events_per_day.min), int(e.target_events_per_day.max))
    fits = F.floor(seconds / F.lit(longest + e.minimum_gap_sec)).cast("long")
    slots = days.select("*", begin.alias("begin"), seconds.alias("seconds"), F.least(wanted, fits).alias("n")).filter("n > 0")
    slots = slots.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_target"))
    name = F.concat_ws("/", F.when(F.col("is_target"), F.lit("target")).otherwise(F.lit("hard")), F.col("k").cast("string"))
    slots = slots.withColumn("seed", seeds.child_seed(F.col("seed"), name))
    seed = F.col("seed")
    slots = slots.filter(F.col("is_target") | (seeds.uniform(seed, "ratio") < e.hard_negative_ratio))
    stratum = F.floor(F.col("seconds") / F.col("n")).cast("long")
    room = F.greatest(stratum - F.lit(longest + e.minimum_gap_sec), F.lit(0).cast("long"))
    start = F.col("begin") + ((F.col("k") - 1) * stratum + F.floor(seeds.uniform(seed, "place") * (room + 1)).cast("long")) * s
    kind = F.when(F.col("is_target"), F.lit(TARGET)).otherwise(seeds.categorical(seed, "type", e.hard_negatives))
    drawn = {p: seeds.discrete_uniform(seed, p, int(r.min), int(r.max)).alias(f"d_{p}") for p, r in e.phases_sec.items()}
    flat = slots.select("run_id", "person_id", "is_target", "seed", kind.alias("event_type"), start.alias("start_time_ns"), *drawn.values())
    # phases that an event lacks take no time and have no boundary
    only_artifact, no_onset = F.col("event_type") == "sensor_artifact_episode", F.col("event_type") == "recovery_without_peak"
    no_peak = ~F.col("is_target") & F.col("event_type").isin(*NO_PEAK)
    no_pre = F.col("is_target") & (seeds.uniform(seed, "precursor") < config.pattern.exceptions.no_precursor_probability)
    skipped = {"pre_early": no_pre, "pre_late": no_pre, "onset": no_onset, "peak": no_peak}
    at, upto = {}, F.col("start_time_ns")
    for phase in e.phases_sec:
        at[phase] = upto
        upto = upto + F.when(skipped.get(phase, F.lit(False)), F.lit(0).cast("long")).otherwise(F.col(f"d_{phase}")) * s
    short = F.col("start_time_ns") + (F.col("d_pre_early") + F.col("d_onset")) * s
    mark = lambda c, absent, name: F.when(~(only_artifact | absent), c).alias(name)
    no = F.lit(False)
    person = broadcast_if_small(participants(spark, config).select("person_id", F.col("response_archetype").alias("archetype")), 100_000)
    out = flat.select(
        "run_id", "person_id", F.concat(F.lit("ev_"), F.lpad(F.lower(F.hex("seed")), 15, "0")).alias("event_id"), "event_type", "is_target",
        F.when(~F.col("is_target"), F.col("event_type")).alias("hard_negative_kind"), "start_time_ns",
        mark(at["pre_late"], no_pre, "pre_late_start_time_ns"), mark(at["onset"], no_onset, "onset_time_ns"), mark(at["peak"], no_peak, "peak_start_time_ns"),
        mark(at["recovery_early"], no_peak, "peak_end_time_ns"), mark(at["recovery_late"], no, "recovery_early_end_time_ns"), mark(at["post"], no, "recovery_late_end_time_ns"),
        F.when(only_artifact, short).otherwise(upto).alias("end_time_ns"), seeds.beta(seed, "intensity", e.intensity.alpha, e.intensity.beta).cast("float").alias("intensity_truth"),
        only_artifact.alias("is_artifact_only_schedule"), "seed",
    )
    # a person's archetype holds for most of their events; one in five is drawn anew
    own = out.join(person, "person_id")
    return own.withColumn("archetype", F.when(seeds.uniform(F.col("seed"), "vary") < 0.2, seeds.categorical(F.col("seed"), "archetype", config.population.response_archetypes)).otherwise(F.col("archetype")))


def _by_archetype(modality: str, nth: int) -> Column:
    out = F.lit(None)
    for name, of in ARCHETYPES.items():
        out = F.when(F.col("archetype") == name, F.lit(of[modality][nth])).otherwise(out)
    return out


def event_effects(schedule: DataFrame, people: DataFrame, config: RunConfig) -> DataFrame:
    """What each event does: for each modality a gain (signed, 0 where it doesn't answer) and a lag in ns; and when it recovers.

    Targets follow their pattern: direction and magnitude by factor, strength and lag by modality, order and scale by
    archetype; a person's tendencies decide how often an event answers the other way round or not at all, and one
    modality may be missing.  Hard negatives move what their kind moves.
    """
    p, seed = config.pattern, F.col("seed")
    tendency = people.select("person_id", F.col("opposite_response_tendency_truth").cast("double").alias("opposite"), F.col("no_response_tendency_truth").cast("double").alias("none"))
    ev = schedule.filter("NOT is_artifact_only_schedule").join(broadcast_if_small(tendency, 100_000), "person_id")
    # the tendency is twice the population's probability at most, and that on average: it scales the event's chance
    usual = config.population.opposite_direction_probability
    turned = seeds.uniform(seed, "opposite") < p.exceptions.opposite_response_probability * (F.col("opposite") / F.lit(usual) if usual else F.lit(1.0))
    silent = seeds.uniform(seed, "none") < F.col("none")
    missing = F.when(seeds.uniform(seed, "missing") < p.exceptions.missing_modality_probability, seeds.discrete_uniform(seed, "which", 0, 3))
    pair = F.element_at(F.array(*[F.lit(x) for x in PAIRS]), (seeds.discrete_uniform(seed, "pair", 0, 5) + 1).cast("int"))
    intensity = F.col("intensity_truth").cast("double")
    alone = F.when(seeds.uniform(seed, "alone") < 0.5, F.lit("eeg")).otherwise(F.lit("eda"))  # which one a recovery without a peak moves
    columns = {}
    for k, (m, (factor, most)) in enumerate(MODALITIES.items()):
        effect, lag, strength = p.latent_effects[factor], p.lag_sec[m], p.response_strength[m]
        way = seeds.categorical(seed, f"direction/{factor}", dict(effect.direction_probabilities))
        sign = F.when(way == "increase", 1.0).when(way == "decrease", -1.0).otherwise(0.0) * F.when(turned, -1.0).otherwise(1.0)
        size = F.lit(0.4) + F.lit(1.2) * seeds.beta(seed, f"magnitude/{factor}", effect.magnitude.alpha, effect.magnitude.beta)
        answer = F.lit(0.3) + F.lit(0.7) * seeds.uniform_range(seed, f"strength/{m}", strength.min, strength.max)
        quiet = silent | F.coalesce(missing == k, F.lit(False)) | ((F.col("archetype") == "partial_response") & ~F.array_contains(F.split(pair, " "), m))
        target = F.when(quiet, 0.0).otherwise(F.lit(most) * intensity * sign * size * answer * _by_archetype(m, 1))
        hard = F.lit(0.0)
        for kind, of in HARD_EFFECTS.items():
            hard = F.when(F.col("event_type") == kind, F.lit(of[m])).otherwise(hard)
        hard = F.when((F.col("event_type") == "recovery_without_peak") & (alone != m), 0.0).otherwise(hard) * (F.lit(0.5) + F.lit(0.5) * intensity)
        columns[f"gain_{m}"] = F.round(F.when(F.col("is_target"), target).otherwise(hard), 6)
        third = (_by_archetype(m, 0) + seeds.uniform(seed, f"lag/{m}")) / 3
        columns[f"lag_{m}_ns"] = F.when(F.col("is_target"), F.round((F.lit(lag.min) + third * F.lit(lag.max - lag.min)) * 1000).cast("long") * 1_000_000).otherwise(F.lit(0).cast("long"))
    drawn = lambda *names: sum((seeds.discrete_uniform(seed, n, int(config.events.phases_sec[n].min), int(config.events.phases_sec[n].max)) for n in names), F.lit(0).cast("long")) * F.lit(SECOND).cast("long")
    columns["recovery_ns"] = F.coalesce("peak_end_time_ns", F.col("onset_time_ns") + drawn("onset"), F.col("start_time_ns") + drawn("pre_early", "pre_late"))
    return ev.withColumns(columns).drop("opposite", "none")


def response(t: Column) -> Column:
    """Share of the full response of an event at an instant, by the shapes of its phases; a phase that it lacks takes no time.

    Recovery falls from what was reached: 1 after an onset, 0.4 after precursors alone.
    """
    early_end = F.coalesce("pre_late_start_time_ns", F.when(F.col("is_target"), F.col("start_time_ns")).otherwise(F.col("onset_time_ns")))
    late_end = F.coalesce("onset_time_ns", "recovery_ns")
    onset_end = F.coalesce("peak_start_time_ns", "recovery_ns")
    share = lambda a, b: F.try_divide((t - a).cast("double"), (b - a).cast("double"))
    start, recovery, early, late = F.col("start_time_ns"), F.col("recovery_ns"), F.col("recovery_early_end_time_ns"), F.col("recovery_late_end_time_ns")
    before = F.when(F.col("pre_late_start_time_ns").isNull(), 0.0).otherwise(0.4)
    top = F.when(F.col("onset_time_ns").isNull(), 0.4).otherwise(1.0)
    return (
        F.when(t < start, F.lit(0.0))
        .when(t < early_end, F.lit(0.2) * curves.smoothstep(share(start, early_end)))
        .when(t < late_end, F.lit(0.2) + F.lit(0.2) * curves.exponential_rise(share(early_end, late_end)))
        .when(t < onset_end, before + (F.lit(1.0) - before) * curves.sigmoid(share(late_end, onset_end)))
        .when(t < recovery, curves.plateau(share(onset_end, recovery)))
        .when(t < early, top * curves.biexponential_decay(share(recovery, early)))
        .when(t < late, top * F.lit(0.12) * curves.slow_decay(share(early, late)))
        .otherwise(F.lit(0.0))
    )


def event_drives(effects: DataFrame) -> DataFrame:
    """(run_id, person_id, truth_time_ns, drive_eeg, drive_cardiac, drive_eda, drive_motor): what events add, second by second.

    Drives are whole millionths, so that their sum doesn't depend on the order of events.
    """
    s = F.lit(SECOND).cast("long")
    lags = [F.col(f"lag_{m}_ns") for m in MODALITIES]
    ceil = lambda t: floor_div(t + F.lit(SECOND - 1).cast("long"), SECOND)
    spread = F.sequence(ceil(F.col("start_time_ns") + F.least(*lags)) * s, ceil(F.col("recovery_late_end_time_ns") + F.greatest(*lags)) * s, s)
    each = effects.withColumn("truth_time_ns", F.explode(spread))
    for m in MODALITIES:
        each = each.withColumn(f"drive_{m}", F.round(F.col(f"gain_{m}") * response(F.col("truth_time_ns") - F.col(f"lag_{m}_ns")) * 1_000_000).cast("long"))
    return each.groupBy("run_id", "person_id", "truth_time_ns").agg(*[F.sum(f"drive_{m}").alias(f"drive_{m}") for m in MODALITIES])


def _state(grid: DataFrame, contexts: DataFrame, targets: DataFrame, drives: DataFrame) -> DataFrame:
    """Grid rows with context, active target, its phase, and drives.

    Contexts, targets and drives are spread to seconds and meet the grid in one aggregate of whole numbers, so the
    grid's rows move once and are hashed, not sorted; the target's columns come back by its number.
    """
    keys = ["run_id", "person_id"]
    t = "truth_time_ns"
    kinds = {"on_grid": "int", "context": "int", "target": "int"} | {f"drive_{m}": "long" for m in MODALITIES}

    def part(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(*keys, t, *[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])

    targets = targets.withColumn("target", instance_index())
    # of contexts that share a second the first by priority, then by name
    number = F.array_position(F.array(*[F.lit(c) for c in sorted(CONTEXTS)]), F.col("context"))
    rows = part(grid, on_grid=F.lit(1))
    rows = rows.unionByName(part(by_second(contexts, "start_ns", "end_ns", t), context=F.col("priority") * 100 + number))
    rows = rows.unionByName(part(by_second(targets, "start_time_ns", "end_time_ns", t), target=F.col("target")))
    rows = rows.unionByName(part(drives, **{f"drive_{m}": F.col(f"drive_{m}") for m in MODALITIES}))
    met = rows.groupBy(*keys, t).agg(F.max("on_grid").alias("on_grid"), F.min("context").alias("context"), F.max("target").alias("target"), *[F.sum(f"drive_{m}").alias(f"drive_{m}") for m in MODALITIES])
    name = F.when(F.col("context").isNotNull(), F.element_at(F.array(*[F.lit(c) for c in sorted(CONTEXTS)]), F.pmod(F.coalesce("context", F.lit(1)), F.lit(100))))
    columns = [c for c in TARGET_COLUMNS if c in targets.columns]
    held = met.filter("on_grid = 1").join(broadcast_if_small(targets.select(*keys, "target", *columns), 100_000), [*keys, "target"], "left")
    return held.select(
        *keys, t, F.coalesce(name, F.lit("wake_rest")).alias("context_state"), F.col("event_id").alias("target_id"), F.when(F.col("event_id").isNotNull(), phase_at(F.col(t))).alias("target_phase"),
        *[(F.coalesce(f"drive_{m}", F.lit(0)) / F.lit(1e6)).alias(f"drive_{m}") for m in MODALITIES],
    )


def states(spark: SparkSession, config: RunConfig, schedule: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(run_id, person_id, truth_time_ns, context_state, target_id, target_phase, drive_eeg, ...): the timeline less levels and noise."""
    effects = written(event_effects(schedule, participants(spark, config) if people is None else people, config))
    grid = canonical_grid(spark, config).select("run_id", "person_id", "truth_time_ns")
    return _state(grid, context_intervals(spark, config), schedule.filter("is_target"), event_drives(effects))


def circadian(t: Column, amplitude: Column, config: RunConfig) -> Column:
    """0 to 1, highest at three in the afternoon; a person's amplitude widens or narrows it."""
    if not config.context.circadian.enabled:
        return F.lit(0.5)
    second = F.pmod(floor_div(t, SECOND), F.lit(86_400).cast("long")) + F.lit(config.run.local_utc_offset_hours * 3600 - 15 * 3600)
    return F.least(F.greatest(F.lit(0.5) + F.lit(0.5) * amplitude * F.cos(F.lit(2 * 3.141592653589793 / 86_400) * second), F.lit(0.0)), F.lit(1.0))


def spontaneous(noise: Column) -> Column:
    """What the upper tenth of a slow noise adds: rare, smooth extremes without any event."""
    return F.lit(5.0) * F.greatest(noise - F.lit(0.9), F.lit(0.0))


def latent_timeline(spark: SparkSession, config: RunConfig, schedule: DataFrame) -> DataFrame:
    """Person and second: context, seven factors and the drive of the skin in [0, 1], and the active events.

    Factors are levels by context, moved by the day's drifts, shared and own noise, rare extremes, and events.
    """
    people, days = participants(spark, config), daily_context(spark, config)
    schedule, people, days = written(schedule), written(people), written(days)  # each is read several times
    state = states(spark, config, schedule, people)
    start = F.lit(config.run.start_ns).cast("long")
    t = F.col("truth_time_ns")
    state = state.withColumns({"day_index": floor_div(t - start, DAY).cast("byte"), "seconds_from_start": floor_div(t - start, SECOND)})
    drift = days.select("run_id", "person_id", "day_index", *sorted({c for c, _ in DRIFTS.values()}))
    person = people.select("run_id", "person_id", F.col("seed").alias("person_seed"), "circadian_amplitude_truth", "recovery_capacity_truth")
    base = state.join(broadcast_if_small(person, 100_000), ["run_id", "person_id"]).join(broadcast_if_small(drift, 100_000), ["run_id", "person_id", "day_index"])
    seed, sec, context = F.col("person_seed"), F.col("seconds_from_start"), F.col("context_state")
    noise = lambda name, period: seeds.value_noise(seed, name, sec, period)
    asleep, moving = context == "sleep", context.isin("light_activity", "moderate_activity")
    base = base.withColumns({"_shared": noise("shared", 900), "_circadian": circadian(t, F.col("circadian_amplitude_truth").cast("double"), config)})
    level = {
        "autonomic_arousal": F.when(asleep, 0.1).when(moving, 0.45).otherwise(0.25), "motor_activation": F.when(asleep, 0.02).when(context == "moderate_activity", 0.6).when(moving, 0.4).otherwise(0.15),
        "cognitive_load": F.when(asleep, 0.05).when(context == "focused_task", 0.6).otherwise(0.3), "sleep_pressure": F.lit(0.8) - F.lit(0.6) * F.col("_circadian"), "sensory_context": F.lit(0.3),
        "recovery_capacity": F.lit(0.2) + F.lit(0.5) * F.col("recovery_capacity_truth").cast("double"), "social_context": F.when(asleep, 0.0).otherwise(0.35), "eda_drive": F.when(asleep, 0.15).when(moving, 0.4).otherwise(0.25),
    }
    driven = {"autonomic_arousal": "drive_cardiac", "motor_activation": "drive_motor", "cognitive_load": "drive_eeg", "eda_drive": "drive_eda"}
    kept = ["run_id", "person_id", "truth_time_ns", "day_index", "seconds_from_start", "context_state", "target_id", "target_phase"]
    names, done = [*FACTORS, "eda_drive"], []
    clamped = lambda n: F.when(F.col(n) < 0, 0.0).when(F.col(n) > 1, 1.0).otherwise(F.col(n)).alias(n)
    # two factors a step: each step is a projection of its own, whose generated code stays small
    carry = [c for c in base.columns if c not in kept]
    for k in range(0, len(names), 2):
        step = []
        for name in names[k : k + 2]:
            x = level[name] + F.lit(0.15) * (F.col("_shared") - 0.5) + F.lit(0.2) * (noise(name, 300) - 0.5) + F.lit(0.08) * (noise(f"{name}/fast", 20) - 0.5)
            if name in DRIFTS:
                column, by = DRIFTS[name]
                x = x + F.lit(by) * F.col(column).cast("double")
            if name in driven:
                x = x + F.col(driven[name]) + spontaneous(noise(f"{name}/rare", 240))
            step.append(x.alias(name))
        base = base.select(*kept, *carry, *[clamped(n) if n in names[k - 2 : k] else F.col(n) for n in done], *step)
        done += names[k : k + 2]
    last = names[-2:]
    out = base.select(
        "run_id", "person_id", "truth_time_ns", timestamp_of_ns(t).alias("timestamp_utc"), date_of_ns(t).alias("date_utc"), "day_index", "seconds_from_start", "context_state", (~asleep).alias("is_awake"),
        *[(clamped(n) if n in last else F.col(n)).cast("float").alias(n) for n in names], F.col("target_id").alias("active_target_event_id"), F.col("target_phase").alias("active_target_event_phase"),
    )
    return active_lists(out, schedule)


def clips(spark: SparkSession, config: RunConfig, schedule: DataFrame) -> DataFrame:
    """Native-rate clips: around onsets, and baseline clips free of events at the time of day of targets.

    A person gets as many baseline clips as the configuration asks for, as long as free stretches are left.  Targets are
    matched in the order of their hash, and again from the first where there are fewer than clips; each is given a free
    stretch near in time of day, of another day before the same one, so that no two would rather have each other's.
    """
    e, s = config.events, F.lit(SECOND).cast("long")
    low, high = F.lit(config.run.start_ns).cast("long"), F.lit(config.run.start_ns + config.run.duration_sec * SECOND).cast("long")
    keys = ["run_id", "person_id"]
    middle = F.coalesce("onset_time_ns", "start_time_ns")
    around = schedule.select(*keys, F.concat(F.lit("clip_"), "event_id").alias("clip_id"), F.lit("event").alias("clip_kind"), F.col("event_id").alias("matched_event_id"),
                             (middle - F.lit(e.clip_pre_sec).cast("long") * s).alias("start_ns"), (middle + F.lit(e.clip_post_sec).cast("long") * s).alias("end_ns"))
    length = e.clip_pre_sec + e.clip_post_sec
    slots, span = max(config.run.duration_sec // length, 1), F.lit(length).cast("long") * s
    tries = persons(spark, config).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))
    ev = schedule.filter("end_time_ns > start_time_ns")
    touched = F.sequence(F.floor((F.col("start_time_ns") - low) / span), F.floor((F.col("end_time_ns") - low - 1) / span))
    free = tries.join(ev.select(*keys, F.explode(touched).alias("slot")).distinct(), [*keys, "slot"], "left_anti").withColumn("start", low + F.col("slot") * span)
    by_hash = Window.partitionBy(*keys).orderBy("seed", "event_id")  # a person's targets
    targets = schedule.filter("is_target").select(*keys, "event_id", F.row_number().over(by_hash).alias("n"), (middle - F.lit(e.clip_pre_sec).cast("long") * s).alias("like"))
    asked = e.matched_baseline_clips_per_day * day_count(config)
    counted = targets.groupBy(*keys).agg(F.max("n").alias("of"))
    turns = counted.select(*keys, "of", F.explode(F.sequence(F.lit(1), F.lit(max(asked, 1)))).alias("turn")).filter(F.col("turn") <= asked)
    wanted = turns.withColumn("n", F.pmod(F.col("turn") - 1, F.col("of")) + 1).join(targets, [*keys, "n"]).select(*keys, "turn", "like", "event_id")
    chosen = deferred_acceptance(wanted, free, keys, DAY, config.run.start_ns).join(wanted.select(*keys, "turn", F.col("event_id").alias("matched_event_id")), [*keys, "turn"])
    name = F.concat_ws("_", F.lit("clip_baseline"), "person_id", "slot")
    baseline = chosen.select(*keys, name.alias("clip_id"), F.lit("baseline").alias("clip_kind"), "matched_event_id", F.col("start").alias("start_ns"), (F.col("start") + span).alias("end_ns"))
    both = around.unionByName(baseline)
    return both.select(*keys, "clip_id", "clip_kind", "matched_event_id", F.greatest("start_ns", low).alias("start_ns"), F.least("end_ns", high).alias("end_ns"), ((F.col("start_ns") < low) | (F.col("end_ns") > high)).alias("truncated"))
