"""Registered queries over the driver's tables, each beside DuckDB SQL for the same rows.

``events`` stands in for a recorded series: user is the person, value the signal, an ``error`` a target onset.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import arrays, curves, seeds, spectral
from pulsegrid.functions.timecols import DAY, HOUR, SECOND, floor_div, ns_of_ntz
from pulsegrid.operators import decayed, devices, features, intervals, labels, matching, sanity, splits, truth, validation, windows
from pulsegrid.operators.sliding import Frames
from pulsegrid.plans import derived, run
from pulsegrid.sources import config as cfg
from pulsegrid.sources import tables

SEED = 20260725
START = 1_767_225_600 * SECOND
BLOCK = 14 * DAY
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, person_id, t, event_type, value, props) with t in UTC nanoseconds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("user_id").alias("person_id"), ns_of_ntz("ts").alias("t"), "event_type", "value", "props")


EV = "ev AS (SELECT event_id, user_id AS person_id, epoch_us(ts) * 1000 AS t, event_type, value, props FROM events)"
H, D = HOUR, DAY
HEX15 = "CAST(('0x' || substr(sha256({0}), 1, 15)) AS BIGINT)"
U = "(CAST(('0x' || substr(sha256({0}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def r(c, digits: int = 6):
    return F.round(c, digits)


# generators ---------------------------------------------------------------------------------------------------------


@query(f"""SELECT 'P' || lpad(CAST(p AS VARCHAR), 3, '0') AS person_id, CAST({START} + s * 1000000000 AS BIGINT) AS canonical_time_ns, s AS seconds_from_start
    FROM (SELECT unnest(range(1, 4)) AS p), (SELECT unnest(range(0, 21600)) AS s)""")
def canonical_grid(spark, sf_dir):
    grid = truth.canonical_grid(spark, cfg.builtin("quick"))
    return grid.select("person_id", F.col("truth_time_ns").alias("canonical_time_ns"), "seconds_from_start")


@query(f"""SELECT p AS person_no, d AS day_index, {HEX15.format(f"'{SEED}/person/' || p || '/day/' || d")} AS seed
    FROM (SELECT unnest(range(1, 201)) AS p), (SELECT unnest(range(0, 5)) AS d)""")
def seed_tree(spark, sf_dir):
    rows = spark.range(1, 201).select(F.col("id").alias("person_no"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("day_index"))
    return rows.withColumn("seed", seeds.child_seed(SEED, "person", F.col("person_no"), "day", F.col("day_index")))


def _n(name: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {U.format(f"s || '/{name}a'")})) * cos(6.283185307179586 * {U.format(f"s || '/{name}b'")}))"


@query(f"""WITH x AS (SELECT i AS k, CAST({HEX15.format(f"'{SEED}/draw/' || i")} AS VARCHAR) AS s FROM (SELECT unnest(range(0, 2000)) AS i))
    SELECT k, round({U.format("s || '/u'")}, 9) AS u, round({_n('z')}, 6) AS z, round(35.0 * exp({math.log(1.6)!r} * {_n('ln')}), 4) AS lognormal_ms,
      CAST(1 + floor({U.format("s || '/n'")} * 4) AS BIGINT) AS per_day, round(-300.0 + {U.format("s || '/r'")} * 600.0, 6) AS offset_ms,
      CASE WHEN {U.format("s || '/c'")} < 0.35 THEN 'female' ELSE 'male' END AS kind FROM x""")
def random_draws(spark, sf_dir):
    s = F.col("s")
    x = spark.range(0, 2000).select(F.col("id").alias("k"), seeds.child_seed(SEED, "draw", F.col("id")).alias("s"))
    return x.select("k", r(seeds.uniform(s, "u"), 9).alias("u"), r(seeds.normal(s, "z")).alias("z"), r(seeds.lognormal(s, "ln", 35.0, 1.6), 4).alias("lognormal_ms"), seeds.discrete_uniform(s, "n", 1, 4).alias("per_day"),
                    r(seeds.uniform_range(s, "r", -300.0, 300.0)).alias("offset_ms"), seeds.categorical(s, "c", {"female": 0.35, "male": 0.65}).alias("kind"))


@query(f"""WITH m AS (SELECT * FROM (VALUES ('headband', 120.0, 25.0), ('strap', -80.0, -15.0), ('watch', 410.0, 38.0)) AS v(device_id, offset_ms, ppm)),
    g AS (SELECT unnest(range(0, 432000, 60)) AS s)
    SELECT device_id, s AS seconds, CAST({START} + s * 1000000000 AS BIGINT) + CAST(round(offset_ms * 1e6 + (s * 1000000000)::DOUBLE * ppm / 1e6) AS BIGINT) AS device_time_ns FROM m, g""")
def clock_model(spark, sf_dir):
    m = spark.createDataFrame([("headband", 120.0, 25.0), ("strap", -80.0, -15.0), ("watch", 410.0, 38.0)], "device_id string, offset_ms double, ppm double")
    g = m.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(431_940).cast("long"), F.lit(60).cast("long"))).alias("seconds"))
    t = F.lit(START).cast("long") + F.col("seconds") * F.lit(SECOND).cast("long")
    return g.select("device_id", "seconds", devices.device_time(t, F.lit(START).cast("long"), F.col("offset_ms"), F.col("ppm"), F.lit(0.0)).alias("device_time_ns"))


@query("""WITH g AS (SELECT i, i / 100.0 AS x FROM (SELECT unnest(range(0, 101)) AS i))
    SELECT i, round(x * x * (3.0 - 2.0 * x), 9) AS smooth, round((exp(3.0 * x) - 1) / (exp(3.0) - 1), 9) AS rise, round(1.0 / (1.0 + exp(-10.0 * (x - 0.5))), 9) AS sigmoid,
      round(0.95 + 0.05 * cos(6.283185307179586 * x), 9) AS plateau, round(0.7 * exp(-4.0 * x) + 0.3 * exp(-1.0 * x), 9) AS decay, round(exp(-2.0 * x), 9) AS slow FROM g""")
def phase_curves(spark, sf_dir):
    x = F.col("i") / F.lit(100.0)
    return spark.range(0, 101).withColumnRenamed("id", "i").select("i", r(curves.smoothstep(x), 9).alias("smooth"), r(curves.exponential_rise(x), 9).alias("rise"), r(curves.sigmoid(x), 9).alias("sigmoid"), r(curves.plateau(x), 9).alias("plateau"),
        r(curves.biexponential_decay(x), 9).alias("decay"), r(curves.slow_decay(x), 9).alias("slow"))


def _seed(*parts: str) -> str:
    """60-bit seed of a path of SQL expressions."""
    return HEX15.format(" || '/' || ".join(parts))


def _u(seed: str, name: str) -> str:
    return U.format(f"{seed} || '/' || {name}")


def _z(seed: str, name: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {_u(seed, f'{name} || chr(97)')})) * cos(6.283185307179586 * {_u(seed, f'{name} || chr(98)')}))"


def _truncated(seed: str, name: str, d) -> str:
    draws = f"list_transform(range(0, {seeds.TRIES}), lambda k: {float(d.mean)} + {float(d.std)} * {_z(seed, f"'{name}/' || k")})"
    return f"coalesce(list_filter({draws}, lambda x: x BETWEEN {float(d.min)} AND {float(d.max)})[1], {min(max(float(d.mean), d.min), d.max)})"


def _lognormal(seed: str, name: str, d) -> str:
    return f"({float(d.median)} * exp({math.log(d.geometric_std)!r} * {_z(seed, f"'{name}'")}))"


def _gamma(seed: str, name: str, shape: float) -> str:
    """The first accepted of a series of draws."""
    d = shape - 1 / 3
    c = 1 / math.sqrt(9 * d)
    draws = f"list_transform(range(0, {seeds.TRIES}), lambda k: {{'z': {_z(seed, f"'{name}/' || k")}, 'u': {_u(seed, f"'{name}/' || k || 'u'")}}})"
    v = f"pow(1.0 + {c!r} * x.z, 3.0)"
    ok = f"{v} > 0 AND ln(1.0 - x.u) < 0.5 * x.z * x.z + {d!r} - {d!r} * {v} + {d!r} * ln(greatest({v}, 1e-300))"
    return f"coalesce(list_filter(list_transform({draws}, lambda x: CASE WHEN {ok} THEN {d!r} * {v} END), lambda y: y IS NOT NULL)[1], {d!r})"


def _beta(seed: str, name: str, d) -> str:
    x, y = _gamma(seed, f"{name}/x", d.alpha), _gamma(seed, f"{name}/y", d.beta)
    return f"({x} / ({x} + {y}))"


def _categorical(seed: str, name: str, weights: dict[str, float]) -> str:
    total, upto, out = sum(weights.values()), 0.0, "CASE"
    for key, w in weights.items():
        upto += w / total
        out += f" WHEN {_u(seed, name)} < {upto!r} THEN '{key}'"
    return f"{out} ELSE '{list(weights)[-1]}' END"


def _discrete(seed: str, name: str, low, high) -> str:
    return f"CAST({int(low)} + floor({_u(seed, name)} * {int(high) - int(low) + 1}) AS BIGINT)"


def _float(x: str, digits: int = 5) -> str:
    return f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), {digits})"


def _people(c: cfg.RunConfig) -> str:
    """CTEs of persons and days with their seeds."""
    n_days = truth.day_count(c)
    return f"""pp AS (SELECT 'P' || lpad(CAST(p AS VARCHAR), 3, '0') AS person_id FROM (SELECT unnest(range(1, {c.run.participant_count + 1})) AS p)),
    pe AS (SELECT person_id, {_seed(f"'{c.run.seed}/person'", "person_id")} AS seed FROM pp),
    da AS (SELECT person_id, CAST(d AS BIGINT) AS day_index, {_seed(f"'{c.run.seed}/person'", "person_id", "'day'", "d")} AS seed, {c.run.start_ns} + d * {DAY} AS midnight FROM pp, (SELECT unnest(range(0, {n_days})) AS d))"""


MVP, QUICK = cfg.builtin("mvp"), cfg.builtin("quick")


def _participants_sql(c: cfg.RunConfig) -> str:
    p = c.population
    low = [[1.0, 0.0], [-0.5, math.sqrt(1 - 0.25)]]  # the Cholesky factor's first rows
    z0, z1 = _z("seed", "'base0'"), _z("seed", "'base1'")
    hr = f"least(greatest({p.resting_hr_bpm.mean} + {p.resting_hr_bpm.std} * ({low[0][0]} * {z0} + {p.research_prior_strength} * 0.5), {p.resting_hr_bpm.min}), {p.resting_hr_bpm.max})"
    rmssd = f"{p.rmssd_ms.median} * exp({math.log(p.rmssd_ms.geometric_std)!r} * ({low[1][0]} * {z0} + {low[1][1]!r} * {z1} - {p.research_prior_strength} * 0.5))"
    columns = {
        "age_years": _truncated("seed", "age", p.age_years), "resting_hr_bpm_truth": hr, "rmssd_ms_truth": rmssd, "eeg_aperiodic_exponent_truth": _truncated("seed", "aperiodic", p.eeg_aperiodic_exponent),
        "eeg_relative_alpha_truth": _beta("seed", "alpha", p.eeg_relative_alpha), "eeg_relative_gamma_truth": _beta("seed", "gamma", p.eeg_relative_gamma), "eda_tonic_level_us_truth": _lognormal("seed", "tonic", p.eda_tonic_level_us),
        "recovery_capacity_truth": _beta("seed", "recovery", p.recovery_capacity), "opposite_response_tendency_truth": f"{_u('seed', chr(39) + 'opposite' + chr(39))} * 2 * {p.opposite_direction_probability}",
        "no_response_tendency_truth": f"{_u('seed', chr(39) + 'none' + chr(39))} * 2 * {p.no_response_probability}",
        "circadian_amplitude_truth": f"1 + ({_u('seed', chr(39) + 'circadian' + chr(39))} * 2 - 1) * {c.context.circadian.amplitude_variation}",
    }
    sex = f"CASE WHEN {_u('seed', chr(39) + 'sex' + chr(39))} < {p.female_probability} THEN 'female' ELSE 'male' END"
    return f"""SELECT '{cfg.run_id(c)}' AS run_id, person_id, {sex} AS biological_sex, {_categorical('seed', "'archetype'", p.response_archetypes)} AS response_archetype,
      {", ".join(f"{_float(x, 3)} AS {n}" for n, x in columns.items())}, seed FROM pe"""


def rounded_floats(df: DataFrame, digits: int = 5) -> DataFrame:
    """Float columns as doubles, rounded for comparison."""
    return df.withColumns({n: r(F.col(n).cast("double"), digits) for n, kind in df.dtypes if kind in ("float", "double")})


@query(f"WITH {_people(MVP)} {_participants_sql(MVP)}")
def participants(spark, sf_dir):
    return rounded_floats(truth.participants(spark, MVP), 3)


def _daily_sql(c: cfg.RunConfig) -> str:
    sleep = c.context.sleep
    start = f"midnight + CAST(floor(({_truncated('seed', 'bed', sleep.bedtime_local_hour)} - {c.run.local_utc_offset_hours}) * 3600) AS BIGINT) * {SECOND}"
    drifts = ", ".join(f"{_float(_z('seed', chr(39) + n + chr(39)) + ' * 0.1')} AS {c_}" for n, c_ in (("fatigue", "fatigue_drift_truth"), ("activity", "activity_drift_truth"), ("baseline", "baseline_drift_truth"), ("tolerance", "sensor_tolerance_truth")))
    return f"""dc AS (SELECT '{cfg.run_id(c)}' AS run_id, person_id, day_index, CAST(DATE '1970-01-01' + CAST(midnight // {DAY} AS INTEGER) AS DATE) AS date_utc, {start} AS sleep_start_time_ns,
      CAST(floor({_truncated('seed', 'sleep', sleep.duration_hours)} * 3600) AS BIGINT) AS sleep_duration_sec, {drifts}, seed, midnight FROM da)"""


@query(f"""WITH {_people(MVP)}, {_daily_sql(MVP)} SELECT run_id, person_id, day_index, CAST(date_utc AS VARCHAR) AS date_utc, sleep_start_time_ns, sleep_start_time_ns + sleep_duration_sec * {SECOND} AS sleep_end_time_ns, sleep_duration_sec,
    fatigue_drift_truth, activity_drift_truth, baseline_drift_truth, sensor_tolerance_truth, seed FROM dc""")
def daily_context(spark, sf_dir):
    return rounded_floats(truth.daily_context(spark, MVP)).withColumn("date_utc", F.col("date_utc").cast("string"))


def _contexts_sql(c: cfg.RunConfig) -> str:
    local, x = f"(midnight - {c.run.local_utc_offset_hours * HOUR})", c.context
    kinds = {"light_activity": 0.35, "moderate_activity": 0.2, "focused_task": 0.25, "sedentary_activity": 0.15, "transition": 0.05}
    begin = f"{local} + {_discrete('seed', chr(39) + 'begin' + chr(39) + ' || k', 7 * 3600, 21 * 3600)} * {SECOND}"
    at = f"{local} + (h * 3600 + {_discrete('seed', chr(39) + 'meal' + chr(39) + ' || h', -1800, 1800)}) * {SECOND}"
    return f"""bo AS (SELECT *, unnest(range(1, 1 + {_discrete('seed', chr(39) + 'bouts' + chr(39), x.ordinary_activity.daily_bouts.min, x.ordinary_activity.daily_bouts.max)})) AS k FROM dc),
    ci AS (SELECT person_id, 'sleep' AS context, 0 AS priority, sleep_start_time_ns AS start_ns, sleep_start_time_ns + sleep_duration_sec * {SECOND} AS end_ns FROM dc
      UNION ALL SELECT person_id, 'sleep', 0, sleep_start_time_ns - {DAY}, sleep_start_time_ns + sleep_duration_sec * {SECOND} - {DAY} FROM dc WHERE day_index = 0
      UNION ALL SELECT person_id, 'meal_context', 1, {at}, {at} + {1500 * SECOND} FROM (SELECT *, unnest([8, 13, 19]) AS h FROM dc)
      UNION ALL SELECT person_id, {_categorical('seed', chr(39) + 'kind' + chr(39) + ' || k', kinds)}, 2, {begin}, {begin} + {_discrete('seed', chr(39) + 'for' + chr(39) + ' || k', 300, 3600)} * {SECOND} FROM bo)"""


@query(f"WITH {_people(MVP)}, {_daily_sql(MVP)}, {_contexts_sql(MVP)} SELECT person_id, context, priority, start_ns, end_ns FROM ci")
def context_intervals(spark, sf_dir):
    """Sleep, meals and bouts of activity of every person and day."""
    return truth.context_intervals(spark, MVP).drop("run_id")


def _events_sql(c: cfg.RunConfig) -> str:
    e, longest = c.events, int(sum(p.max for p in c.events.phases_sec.values()))
    q = lambda n: f"'{n}'"
    durations = ", ".join(f"{_discrete('seed', q(p), x.min, x.max)} AS d_{p}" for p, x in e.phases_sec.items())
    per_day = _discrete("seed", q("targets"), e.target_events_per_day.min, e.target_events_per_day.max)
    archetype = _categorical("seed", q("archetype"), c.population.response_archetypes)
    return f"""sl AS (SELECT person_id, day_index, seed, midnight AS beg, least(86400, {c.run.duration_sec} - day_index * 86400) AS seconds FROM da),
    sn AS (SELECT *, least({per_day}, CAST(floor(seconds / {longest + e.minimum_gap_sec}) AS BIGINT)) AS n FROM sl),
    sk AS (SELECT *, unnest(range(1, n + 1)) AS k FROM sn WHERE n > 0),
    st AS (SELECT person_id, beg, seconds, n, k, seed AS day_seed, unnest([true, false]) AS is_target FROM sk),
    sd AS (SELECT *, {_seed('day_seed', "CASE WHEN is_target THEN 'target' ELSE 'hard' END", 'k')} AS seed FROM st),
    sp AS (SELECT *, CAST(floor(seconds / n) AS BIGINT) AS stratum, CASE WHEN is_target THEN '{truth.TARGET}' ELSE {_categorical('seed', q('type'), e.hard_negatives)} END AS event_type FROM sd
           WHERE is_target OR {_u('seed', q('ratio'))} < {e.hard_negative_ratio}),
    sf AS (SELECT *, beg + ((k - 1) * stratum + CAST(floor({_u('seed', q('place'))} * (greatest(stratum - {longest + e.minimum_gap_sec}, 0) + 1)) AS BIGINT)) * {SECOND} AS s0, {durations},
           event_type = 'sensor_artifact_episode' AS only_artifact, event_type = 'recovery_without_peak' AS no_onset, NOT is_target AND event_type IN ('recovery_without_peak', 'quiet_cognitive_load') AS no_peak,
           is_target AND {_u('seed', q('precursor'))} < {c.pattern.exceptions.no_precursor_probability} AS no_pre FROM sp),
    sb AS (SELECT *, s0 + CASE WHEN no_pre THEN 0 ELSE d_pre_early END * {SECOND} AS b1, s0 + CASE WHEN no_pre THEN 0 ELSE d_pre_early + d_pre_late END * {SECOND} AS b2 FROM sf),
    sc AS (SELECT *, b2 + CASE WHEN no_onset THEN 0 ELSE d_onset END * {SECOND} AS b3, b2 + (CASE WHEN no_onset THEN 0 ELSE d_onset END + CASE WHEN no_peak THEN 0 ELSE d_peak END) * {SECOND} AS b4 FROM sb),
    ar AS (SELECT person_id, {archetype} AS own FROM pe),
    te AS (SELECT '{cfg.run_id(c)}' AS run_id, sc.person_id, 'ev_' || lpad(printf('%x', seed), 15, '0') AS event_id, event_type, is_target, CASE WHEN NOT is_target THEN event_type END AS hard_negative_kind, s0 AS start_time_ns,
           CASE WHEN NOT (only_artifact OR no_pre) THEN b1 END AS pre_late_start_time_ns, CASE WHEN NOT (only_artifact OR no_onset) THEN b2 END AS onset_time_ns,
           CASE WHEN NOT (only_artifact OR no_peak) THEN b3 END AS peak_start_time_ns, CASE WHEN NOT (only_artifact OR no_peak) THEN b4 END AS peak_end_time_ns,
           CASE WHEN NOT only_artifact THEN b4 + d_recovery_early * {SECOND} END AS recovery_early_end_time_ns, CASE WHEN NOT only_artifact THEN b4 + (d_recovery_early + d_recovery_late) * {SECOND} END AS recovery_late_end_time_ns,
           CASE WHEN only_artifact THEN s0 + (d_pre_early + d_onset) * {SECOND} ELSE b4 + (d_recovery_early + d_recovery_late + d_post) * {SECOND} END AS end_time_ns,
           CAST({_beta('seed', 'intensity', e.intensity)} AS FLOAT) AS intensity_truth, only_artifact AS is_artifact_only_schedule, seed,
           CASE WHEN {_u('seed', q('vary'))} < 0.2 THEN {archetype} ELSE own END AS archetype,
           coalesce(CASE WHEN NOT (only_artifact OR no_peak) THEN b4 END, CASE WHEN no_onset THEN s0 + (d_pre_early + d_pre_late) * {SECOND} ELSE b2 + d_onset * {SECOND} END) AS recovery_ns
           FROM sc JOIN ar ON ar.person_id = sc.person_id)"""


@query(f"WITH {_people(MVP)}, {_events_sql(MVP)} SELECT * REPLACE (round(CAST(intensity_truth AS DOUBLE), 5) AS intensity_truth) EXCLUDE (recovery_ns) FROM te".replace("* REPLACE (round(CAST(intensity_truth AS DOUBLE), 5) AS intensity_truth) EXCLUDE (recovery_ns)", "* EXCLUDE (recovery_ns) REPLACE (round(CAST(intensity_truth AS DOUBLE), 5) AS intensity_truth)"))
def truth_events(spark, sf_dir):
    return rounded_floats(truth.events(spark, MVP))


def _effects_sql(c: cfg.RunConfig) -> str:
    p, q = c.pattern, lambda n: f"'{n}'"
    usual = c.population.opposite_direction_probability
    pairs = "[" + ", ".join(f"'{x}'" for x in truth.PAIRS) + "]"
    gains = []
    for k, (m, (factor, most)) in enumerate(truth.MODALITIES.items()):
        effect, lag, strength = p.latent_effects[factor], p.lag_sec[m], p.response_strength[m]
        by = lambda nth: "CASE archetype " + " ".join(f"WHEN '{a}' THEN {of[m][nth]}" for a, of in truth.ARCHETYPES.items()) + " END"  # noqa: B023, E731
        sign = f"CASE {_categorical('seed', q(f'direction/{factor}'), dict(effect.direction_probabilities))} WHEN 'increase' THEN 1.0 WHEN 'decrease' THEN -1.0 ELSE 0.0 END * CASE WHEN turned THEN -1.0 ELSE 1.0 END"
        size = f"(0.4 + 1.2 * {_beta('seed', f'magnitude/{factor}', effect.magnitude)})"
        answer = f"(0.3 + 0.7 * ({float(strength.min)} + {_u('seed', q(f'strength/{m}'))} * {float(strength.max - strength.min)}))"
        quiet = f"(silent OR coalesce(missing = {k}, false) OR (archetype = 'partial_response' AND NOT list_contains(string_split(pair, ' '), '{m}')))"
        target = f"CASE WHEN {quiet} THEN 0.0 ELSE {most} * intensity * {sign} * {size} * {answer} * {by(1)} END"
        hard = "CASE event_type " + " ".join(f"WHEN '{kind}' THEN {'CASE WHEN alone = ' + q(m) + ' THEN ' + str(of[m]) + ' ELSE 0.0 END' if kind == 'recovery_without_peak' else of[m]}" for kind, of in truth.HARD_EFFECTS.items()) + " ELSE 0.0 END"
        gains.append(f"round(CASE WHEN is_target THEN {target} ELSE {hard} * (0.5 + 0.5 * intensity) END, 6) AS gain_{m}")
        gains.append(f"CASE WHEN is_target THEN CAST(round(({float(lag.min)} + ({by(0)} + {_u('seed', q(f'lag/{m}'))}) / 3 * {float(lag.max - lag.min)}) * 1000) AS BIGINT) * 1000000 ELSE 0 END AS lag_{m}_ns")
    tendency = f"SELECT person_id AS tp, CAST(CAST({_u('seed', q('opposite'))} * 2 * {usual} AS FLOAT) AS DOUBLE) AS opposite, CAST(CAST({_u('seed', q('none'))} * 2 * {c.population.no_response_probability} AS FLOAT) AS DOUBLE) AS silence FROM pe"
    return f"""ef0 AS (SELECT te.*, CAST(intensity_truth AS DOUBLE) AS intensity, {_u('seed', q('opposite'))} < {p.exceptions.opposite_response_probability} * (opposite / {usual}) AS turned, {_u('seed', q('none'))} < silence AS silent,
           CASE WHEN {_u('seed', q('missing'))} < {p.exceptions.missing_modality_probability} THEN {_discrete('seed', q('which'), 0, 3)} END AS missing, {pairs}[{_discrete('seed', q('pair'), 0, 5)} + 1] AS pair,
           CASE WHEN {_u('seed', q('alone'))} < 0.5 THEN 'eeg' ELSE 'eda' END AS alone FROM te JOIN ({tendency}) ON tp = te.person_id WHERE NOT is_artifact_only_schedule),
    ef AS (SELECT *, {", ".join(gains)} FROM ef0)"""


_EFFECT_COLUMNS = [f"{n}_{m}{x}" for m in truth.MODALITIES for n, x in (("gain", ""), ("lag", "_ns"))]


@query(f"WITH {_people(MVP)}, {_events_sql(MVP)}, {_effects_sql(MVP)} SELECT event_id, recovery_ns, {', '.join(_EFFECT_COLUMNS)} FROM ef")
def event_effects(spark, sf_dir):
    """Gains and lags of every event: directions, archetypes, tendencies, exceptions and hard negatives."""
    ev = windows.written(truth.events(spark, MVP))
    return rounded_floats(truth.event_effects(ev, truth.participants(spark, MVP), MVP).select("event_id", "recovery_ns", *_EFFECT_COLUMNS), 6)


def _response_sql(t: str) -> str:
    early = "coalesce(pre_late_start_time_ns, CASE WHEN is_target THEN start_time_ns ELSE onset_time_ns END)"
    late, onset_end = "coalesce(onset_time_ns, recovery_ns)", "coalesce(peak_start_time_ns, recovery_ns)"
    share = lambda a, b: f"(({t} - {a})::DOUBLE / ({b} - {a})::DOUBLE)"
    e, l, o, p = share("start_time_ns", early), share(early, late), share(late, onset_end), share(onset_end, "recovery_ns")
    rec, tail = share("recovery_ns", "recovery_early_end_time_ns"), share("recovery_early_end_time_ns", "recovery_late_end_time_ns")
    before, top = "CASE WHEN pre_late_start_time_ns IS NULL THEN 0.0 ELSE 0.4 END", "CASE WHEN onset_time_ns IS NULL THEN 0.4 ELSE 1.0 END"
    return f"""CASE WHEN {t} < start_time_ns THEN 0.0 WHEN {t} < {early} THEN 0.2 * {e} * {e} * (3.0 - 2.0 * {e}) WHEN {t} < {late} THEN 0.2 + 0.2 * (exp(3.0 * {l}) - 1) / (exp(3.0) - 1)
      WHEN {t} < {onset_end} THEN {before} + (1.0 - {before}) / (1.0 + exp(-10.0 * ({o} - 0.5))) WHEN {t} < recovery_ns THEN 0.95 + 0.05 * cos(6.283185307179586 * {p})
      WHEN {t} < recovery_early_end_time_ns THEN {top} * (0.7 * exp(-4.0 * {rec}) + 0.3 * exp(-1.0 * {rec})) WHEN {t} < recovery_late_end_time_ns THEN {top} * 0.12 * exp(-2.0 * {tail}) ELSE 0.0 END"""


def _states_sql(c: cfg.RunConfig) -> str:
    """Seconds of a run with context, target, phase and drives, by plain interval joins."""
    drives = ", ".join(f"sum(CAST(round(gain_{m} * ({_response_sql(f'(t - lag_{m}_ns)')}) * 1000000) AS BIGINT)) / 1e6 AS drive_{m}" for m in truth.MODALITIES)
    phase = """CASE WHEN t < coalesce(pre_late_start_time_ns, onset_time_ns) THEN 'pre_early' WHEN t < onset_time_ns THEN 'pre_late' WHEN t < peak_start_time_ns THEN 'onset' WHEN t < peak_end_time_ns THEN 'peak'
      WHEN t < recovery_early_end_time_ns THEN 'recovery_early' WHEN t < recovery_late_end_time_ns THEN 'recovery_late' ELSE 'post' END"""
    return f"""gr AS (SELECT person_id, {c.run.start_ns} + s * {SECOND} AS t FROM pp, (SELECT unnest(range(0, {c.run.duration_sec})) AS s)),
    gc AS (SELECT gr.person_id, t, arg_min(context, priority * 100 + CASE context {' '.join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(sorted(truth.CONTEXTS)))} END) AS context FROM gr JOIN ci ON gr.person_id = ci.person_id AND t >= start_ns AND t < end_ns GROUP BY 1, 2),
    gt AS (SELECT gr.person_id, t, event_id AS target_id, {phase} AS target_phase FROM gr JOIN te ON gr.person_id = te.person_id AND is_target AND t >= start_time_ns AND t < end_time_ns),
    gd AS (SELECT gr.person_id, t, {drives} FROM gr JOIN ef ON gr.person_id = ef.person_id AND t >= start_time_ns - {60 * SECOND} AND t < recovery_late_end_time_ns + {61 * SECOND} GROUP BY 1, 2)"""


@query(f"""WITH {_people(QUICK)}, {_daily_sql(QUICK)}, {_contexts_sql(QUICK)}, {_events_sql(QUICK)}, {_effects_sql(QUICK)}, {_states_sql(QUICK)}
    SELECT gr.person_id, gr.t AS truth_time_ns, coalesce(context, 'wake_rest') AS context_state, target_id, target_phase, {', '.join(f'coalesce(drive_{m}, 0.0) AS drive_{m}' for m in truth.MODALITIES)}
    FROM gr LEFT JOIN gc ON gc.person_id = gr.person_id AND gc.t = gr.t LEFT JOIN gt ON gt.person_id = gr.person_id AND gt.t = gr.t LEFT JOIN gd ON gd.person_id = gr.person_id AND gd.t = gr.t""")
def timeline_states(spark, sf_dir):
    """Each second's context, active target and phase, and what events add to each modality: the timeline less its noise."""
    out = truth.states(spark, QUICK, windows.written(truth.events(spark, QUICK)))
    return out.drop("run_id")


@query()
def latent_timeline(spark, sf_dir):
    return truth.latent_timeline(spark, QUICK, truth.events(spark, QUICK))


def _artifacts_sql(c: cfg.RunConfig) -> str:
    kinds = ", ".join(f"('{s}', '{k}', {r_}, {lo}, {hi})" for s, k, r_, lo, hi in devices.artifact_kinds(c))
    families = ", ".join(f"('{d}', '{f}')" for d, fs in devices.DEVICE_FAMILIES.items() for f in fs)
    block, q = c.artifacts.block_dropouts_per_day, lambda n: f"'{n}'"
    end = c.run.start_ns + c.run.duration_sec * SECOND
    return f"""ak AS (SELECT * FROM (VALUES {kinds}) AS v(stream_name, artifact_type, rate, low, high)), fa AS (SELECT * FROM (VALUES {families}) AS v(device, stream_name)),
    au AS (SELECT pe.person_id, pe.seed, slot, ak.*, 'artifact/' || stream_name || '/' || artifact_type || '/' || slot AS nm FROM pe, (SELECT unnest(range(0, {-(-c.run.duration_sec // 60)})) AS slot), ak),
    ah AS (SELECT *, {_seed('seed', 'nm', "'is'")} AS aseed FROM au WHERE {_u('seed', 'nm')} < least(rate * 60 / 3600, 0.95)),
    ab AS (SELECT *, {c.run.start_ns} + (slot * 60 + CAST(floor({_u('aseed', q('at'))} * 60) AS BIGINT)) * {SECOND} AS s FROM ah),
    bd AS (SELECT person_id, d, device, {_seed('seed', q('dropout'), 'device', 'd')} AS dseed FROM pe, (SELECT unnest(range(0, {truth.day_count(c)})) AS d), (SELECT DISTINCT device FROM fa)),
    bk AS (SELECT *, {_seed('dseed', 'k')} AS aseed FROM (SELECT *, unnest(range(1, 1 + {_discrete('dseed', q('n'), block.min, block.max)})) AS k FROM bd)),
    bs AS (SELECT *, {c.run.start_ns} + d * {DAY} + {_discrete('aseed', q('at'), 0, 86399)} * {SECOND} AS s FROM bk),
    am0 AS (SELECT person_id, aseed AS seed, stream_name, CASE WHEN artifact_type IN ('channel_dropout', 'electrode_pop', 'impedance_drift') THEN ['tp9', 'af7', 'af8', 'tp10'][CAST(floor({_u('aseed', q('channel'))} * 4) AS BIGINT) + 1] END AS channel,
            artifact_type, s AS start_time_ns, s + CAST(low + floor({_u('aseed', q('for'))} * (high - low + 1)) AS BIGINT) * {SECOND} AS end_time_ns, CAST(0.2 + 0.8 * {_u('aseed', q('severity'))} AS FLOAT) AS severity FROM ab
      UNION ALL SELECT person_id, aseed, stream_name, NULL, 'block_dropout', s, s + {_discrete('aseed', q('for'), 30, 300)} * {SECOND}, 1.0 FROM bs JOIN fa ON fa.device = bs.device WHERE s < {end}),
    am AS (SELECT '{cfg.run_id(c)}' AS run_id, person_id, 'ar_' || lpad(printf('%x', seed), 15, '0') || '_' || stream_name AS artifact_id, CASE stream_name WHEN 'eeg' THEN 'headband' WHEN 'ecg' THEN 'strap' ELSE 'watch' END AS device_id,
            stream_name, channel, artifact_type, start_time_ns, end_time_ns, severity, seed FROM am0)"""


@query(f"WITH {_people(QUICK)}, {_artifacts_sql(QUICK)} SELECT * REPLACE (round(CAST(severity AS DOUBLE), 5) AS severity) FROM am")
def artifact_manifest(spark, sf_dir):
    return rounded_floats(devices.artifacts(spark, QUICK))


_MARKS = {"to_onset": "onset_time_ns", "to_peak": "peak_start_time_ns"}


@query(f"""WITH {_people(QUICK)}, {_events_sql(QUICK)}, {_artifacts_sql(QUICK)}, gr AS (SELECT person_id, {QUICK.run.start_ns} + s * {SECOND} AS t FROM pp, (SELECT unnest(range(0, {QUICK.run.duration_sec})) AS s)),
    tg AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY start_time_ns, event_id) AS k FROM te WHERE is_target),
    ge AS (SELECT gr.person_id, t, tg.* EXCLUDE (person_id), {"CASE WHEN t < coalesce(pre_late_start_time_ns, onset_time_ns) THEN 1 WHEN t < onset_time_ns THEN 2 WHEN t < peak_start_time_ns THEN 3 WHEN t < peak_end_time_ns THEN 4 WHEN t < recovery_early_end_time_ns THEN 5 WHEN t < recovery_late_end_time_ns THEN 6 ELSE 7 END"} AS code
           FROM gr JOIN tg ON gr.person_id = tg.person_id AND t >= start_time_ns AND t < end_time_ns),
    gn AS (SELECT gr.person_id, t, min(onset_time_ns) AS nxt FROM gr JOIN tg ON gr.person_id = tg.person_id AND onset_time_ns > t GROUP BY 1, 2),
    ga AS (SELECT gr.person_id, t, max(struct_pack(v := CAST(round(CAST(severity AS DOUBLE) * 1000000) AS BIGINT), k := artifact_type)) AS worst, bool_or(stream_name = 'eeg' AND severity >= 0.5) AS eeg,
           bool_or(stream_name = 'ecg' AND severity >= 0.5) AS ecg, bool_or(stream_name = 'eda' AND severity >= 0.5) AS eda FROM gr JOIN am ON gr.person_id = am.person_id AND t >= start_time_ns AND t < end_time_ns GROUP BY 1, 2)
    SELECT gr.person_id, gr.t AS canonical_time_ns, event_id, event_type, coalesce(code, 0) AS event_phase_code, event_id IS NOT NULL AS event_binary, CAST(k AS BIGINT) AS event_instance_index,
      CASE WHEN gr.t < onset_time_ns THEN (onset_time_ns - gr.t) / 1e9 END AS time_to_onset_sec, CASE WHEN gr.t >= onset_time_ns THEN (gr.t - onset_time_ns) / 1e9 END AS time_since_onset_sec,
      CASE WHEN gr.t < peak_start_time_ns THEN (peak_start_time_ns - gr.t) / 1e9 END AS time_to_peak_sec, CASE WHEN gr.t < end_time_ns THEN (end_time_ns - gr.t) / 1e9 END AS time_to_event_end_sec,
      CASE WHEN intensity_truth < 1 / 3.0 THEN 'low' WHEN intensity_truth < 2 / 3.0 THEN 'medium' WHEN intensity_truth IS NOT NULL THEN 'high' END AS event_intensity_class,
      (nxt - gr.t) / 1e9 AS next_target_onset_sec, {", ".join(f"coalesce(nxt - gr.t <= {h * SECOND}, false) AS will_target_start_within_{h}s" for h in labels.HORIZONS)},
      worst.k AS artifact_type_primary, coalesce(worst.v >= 700000, false) AS artifact_dominant, worst IS NOT NULL AS artifact_present, NOT coalesce(eeg, false) AS valid_for_eeg_model, NOT coalesce(ecg, false) AS valid_for_cardiac_model,
      NOT coalesce(eda, false) AS valid_for_eda_model, NOT (coalesce(eeg, false) OR coalesce(ecg, false) OR coalesce(eda, false)) AS valid_for_multimodal_model,
      CAST(coalesce(eeg, false) AS BIGINT) + CAST(coalesce(ecg, false) AS BIGINT) + CAST(coalesce(eda, false) AS BIGINT) AS missing_modality_count
    FROM gr LEFT JOIN ge ON ge.person_id = gr.person_id AND ge.t = gr.t LEFT JOIN gn ON gn.person_id = gr.person_id AND gn.t = gr.t LEFT JOIN ga ON ga.person_id = gr.person_id AND ga.t = gr.t""")
def truth_labels(spark, sf_dir):
    grid = truth.canonical_grid(spark, QUICK).select("run_id", "person_id", F.col("truth_time_ns").alias("canonical_time_ns"))
    out = labels.label_timeline(grid, windows.written(truth.events(spark, QUICK)), windows.written(devices.artifacts(spark, QUICK)))
    return out.drop("run_id", "event_phase", "label_source", "label_confidence", "event_intensity_truth", "time_since_peak_sec").withColumns({c: F.col(c).cast("long") for c in ("event_instance_index", "missing_modality_count")})


_CLIP = MVP.events.clip_pre_sec + MVP.events.clip_post_sec


#: The nearest pair of all first, then the nearest of those that are left, and so on: the same matching by another way.
_GREEDY = """g AS (SELECT DISTINCT person_id, CAST([] AS BIGINT[]) AS turns, CAST([] AS BIGINT[]) AS slots FROM pa
      UNION ALL SELECT person_id, list_append(turns, pick.turn), list_append(slots, pick.slot) FROM (SELECT g.person_id, any_value(turns) AS turns, any_value(slots) AS slots,
        min({{'apart': least(x, {DAY} - x), 'same_day': same_day, 'slot': slot, 'turn': turn}}) AS pick FROM g JOIN pa ON g.person_id = pa.person_id WHERE NOT list_contains(turns, turn) AND NOT list_contains(slots, slot) GROUP BY g.person_id)),
    picked AS (SELECT person_id, turns[-1] AS turn, slots[-1] AS slot FROM g WHERE len(turns) > 0)"""


@query(f"""WITH RECURSIVE {_people(MVP)}, {_events_sql(MVP)}, md AS (SELECT *, coalesce(onset_time_ns, start_time_ns) - {MVP.events.clip_pre_sec * SECOND} AS like_ns FROM te),
    sl2 AS (SELECT person_id, slot, {MVP.run.start_ns} + slot * {_CLIP * SECOND} AS a FROM pp, (SELECT unnest(range(0, {MVP.run.duration_sec // _CLIP})) AS slot)),
    fr AS (SELECT * FROM sl2 WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.person_id = sl2.person_id AND a < end_time_ns AND a + {_CLIP * SECOND} > start_time_ns)),
    ta AS (SELECT person_id, event_id, like_ns, row_number() OVER (PARTITION BY person_id ORDER BY seed, event_id) AS n FROM md WHERE is_target),
    wa AS (SELECT ta.*, turn FROM ta JOIN (SELECT person_id, max(n) AS top FROM ta GROUP BY 1) USING (person_id), (SELECT unnest(range(1, {MVP.events.matched_baseline_clips_per_day * truth.day_count(MVP) + 1})) AS turn) WHERE n = (turn - 1) % top + 1),
    pa AS (SELECT wa.person_id, turn, event_id, slot, a, ((a - like_ns) % {DAY} + {DAY}) % {DAY} AS x, CAST((a - {MVP.run.start_ns}) // {DAY} = CAST(floor((like_ns - {MVP.run.start_ns}) / {DAY}.0) AS BIGINT) AS INTEGER) AS same_day FROM wa JOIN fr ON fr.person_id = wa.person_id),
    {_GREEDY.format(DAY=DAY)}, p2 AS (SELECT pa.* FROM pa JOIN picked USING (person_id, turn, slot)),
    al AS (SELECT person_id, 'clip_' || event_id AS clip_id, 'event' AS clip_kind, event_id AS matched_event_id, like_ns AS a FROM md UNION ALL SELECT person_id, 'clip_baseline_' || person_id || '_' || slot, 'baseline', event_id, a FROM p2)
    SELECT person_id, clip_id, clip_kind, matched_event_id, greatest(a, {MVP.run.start_ns}) AS start_ns, least(a + {_CLIP * SECOND}, {MVP.run.start_ns + MVP.run.duration_sec * SECOND}) AS end_ns,
      a < {MVP.run.start_ns} OR a + {_CLIP * SECOND} > {MVP.run.start_ns + MVP.run.duration_sec * SECOND} AS truncated FROM al""")
def clip_manifest(spark, sf_dir):
    return truth.clips(spark, MVP, windows.written(truth.events(spark, MVP))).drop("run_id")


#: Hours of a stretch, and stretches, of the series.
_STRETCH, _STRETCHES = 4, 180


@query(f"""WITH RECURSIVE {EV}, wa AS (SELECT person_id, t AS like_ns, row_number() OVER (PARTITION BY person_id ORDER BY t, event_id) AS turn FROM ev WHERE event_type = 'error'),
    used AS (SELECT DISTINCT person_id, (t - 1704067200000000000) // {_STRETCH * H} AS slot FROM ev),
    fr AS (SELECT person_id, slot, 1704067200000000000 + slot * {_STRETCH * H} AS a FROM (SELECT DISTINCT person_id FROM ev), (SELECT unnest(range(0, {_STRETCHES})) AS slot) WHERE (person_id, slot) NOT IN (SELECT (person_id, slot) FROM used)),
    pa AS (SELECT wa.person_id, turn, slot, a, ((a - like_ns) % {D} + {D}) % {D} AS x, CAST((a - 1704067200000000000) // {D} = (like_ns - 1704067200000000000) // {D} AS INTEGER) AS same_day FROM wa JOIN fr ON fr.person_id = wa.person_id),
    {_GREEDY.format(DAY=D)} SELECT pa.person_id, pa.turn, pa.slot, least(x, {D} - x) AS apart FROM pa JOIN picked USING (person_id, turn, slot)""")
def matched_stretches(spark, sf_dir):
    """Every error of a user is matched with a stretch without events near it in time of day, while any is left."""
    s = series(spark, sf_dir)
    order = Window.partitionBy("person_id").orderBy("t", "event_id")  # a user's errors
    wanted = s.filter("event_type = 'error'").select("person_id", F.row_number().over(order).alias("turn"), F.col("t").alias("like"))
    zero, span = F.lit(1_704_067_200 * SECOND).cast("long"), F.lit(_STRETCH * H).cast("long")
    slot = floor_div(F.col("t") - zero, _STRETCH * H)
    used = s.groupBy("person_id").agg(F.collect_set(F.when(slot.between(0, _STRETCHES - 1), slot)).alias("used"))  # at most all stretches
    slots = F.sequence(F.lit(0).cast("long"), F.lit(_STRETCHES - 1).cast("long"))
    free = used.select("person_id", F.explode(F.array_except(slots, "used")).alias("slot")).withColumn("start", zero + F.col("slot") * span)
    return matching.deferred_acceptance(wanted, free, ["person_id"], DAY, 1_704_067_200 * SECOND).select("person_id", "turn", "slot", "apart")


def golden_truth(spark: SparkSession):
    """Configuration, events, latent timeline, people, days and artifacts of the golden run."""
    c = cfg.builtin("golden")
    ev = windows.written(truth.events(spark, c))
    latent, people, days = windows.written(truth.latent_timeline(spark, c, ev)), windows.written(truth.participants(spark, c)), truth.daily_context(spark, c)
    return c, ev, latent, people, days, windows.written(devices.artifacts(spark, c, latent, ev, days))


@query()
def native_streams(spark, sf_dir):
    """All streams of the golden run's clips, with clocks, packets and aligned times; samples as a digest."""
    c, ev, latent, people, days, faults = golden_truth(spark)
    rows = devices.native(latent, people, faults, truth.clips(spark, c, ev), c, days)
    out = devices.aligned(rows, latent, devices.clock_models(spark, c), c)
    return out.withColumn("samples_sha256", F.sha2(F.to_json("channels"), 256)).drop("channels")


@query("SELECT CAST(0 AS BIGINT) AS only_in_clips, CAST(0 AS BIGINT) AS differing WHERE false UNION ALL SELECT 0, 0")
def clip_is_slice(spark, sf_dir):
    """Seconds of clips that the whole recording lacks or has otherwise, for chunks of two lengths."""
    c, ev, latent, people, days, faults = golden_truth(spark)
    key = ["run_id", "person_id", "device_id", "stream_name", "second_ns"]
    short = c.model_copy(update={"run": c.run.model_copy(update={"chunk_duration_sec": 97})})
    whole, clip = devices.native(latent, people, faults, None, short, days), devices.native(latent, people, faults, truth.clips(spark, c, ev), c, days)
    return validation.clips_are_slices(clip, whole, key, [F.to_json("channels"), F.col("quality_native").cast("string"), F.col("missing_kind")])


# resampling and windows ---------------------------------------------------------------------------------------------


def hourly_values(ev: DataFrame) -> DataFrame:
    return ev.groupBy("person_id", (floor_div(F.col("t"), H) * F.lit(H).cast("long")).alias("hour_ns")).agg(F.avg("value").alias("value_mean"), F.count("value").alias("sample_count"), F.min("value").alias("value_min"), F.max("value").alias("value_max"))


@query(f"""WITH {EV} SELECT person_id, (t // {H}) * {H} AS hour_ns, round(avg(value), 6) AS value_mean, count(value) AS sample_count, min(value) AS value_min, max(value) AS value_max,
    round(count(value) / 2.0, 6) AS coverage_ratio FROM ev GROUP BY 1, 2""")
def resample_hourly_coverage(spark, sf_dir):
    h = hourly_values(series(spark, sf_dir))
    return h.select("person_id", "hour_ns", r(F.col("value_mean")).alias("value_mean"), "sample_count", "value_min", "value_max", r(F.col("sample_count") / 2.0).alias("coverage_ratio"))


_W = "OVER (PARTITION BY person_id ORDER BY t RANGE BETWEEN {0} PRECEDING AND CURRENT ROW)"
W72 = _W.format(72 * H - 1)


@query(f"""WITH {EV} SELECT event_id, count(value) {W72} AS n, round(avg(value) {W72}, 6) AS mean, round(min(value) {W72}, 6) AS low, round(max(value) {W72}, 6) AS high,
    CASE WHEN count(value) {W72} > 1 THEN round(stddev_samp(value) {W72}, 5) END AS std FROM ev""")
def rolling_mean_std_causal(spark, sf_dir):
    v = F.col("value")
    out = windows.trailing(series(spark, sf_dir), ["person_id"], "t", 72 * H, {"n": lambda w: F.count(v).over(w), "mean": lambda w: F.avg(v).over(w), "low": lambda w: F.min(v).over(w), "high": lambda w: F.max(v).over(w), "std": lambda w: F.stddev_samp(v).over(w)})
    return out.select("event_id", "n", *[r(F.col(c)).alias(c) for c in ("mean", "low", "high")], F.when(F.col("n") > 1, r(F.col("std"), 5)).alias("std"))


@query(f"""WITH {EV}, s AS (SELECT event_id, count(value) {W72} AS n, regr_slope(value, (t - 1704067200000000000) / 3600e9) {W72} AS b FROM ev)
    SELECT event_id, CASE WHEN n > 1 THEN round(b, 5) END AS slope_per_hour FROM s""")
def rolling_slope(spark, sf_dir):
    x = (F.col("t") - F.lit(1_704_067_200 * SECOND).cast("long")) / F.lit(3600e9)
    out = windows.trailing(series(spark, sf_dir), ["person_id"], "t", 72 * H, {"n": lambda w: F.count("value").over(w), "b": lambda w: F.regr_slope(F.col("value"), x).over(w)})
    return out.select("event_id", F.when(F.col("n") > 1, r(F.col("b"), 5)).alias("slope_per_hour"))


@query(f"""WITH {EV} SELECT event_id, round(median(value) {W72}, 6) AS med, round(mad(value) {W72}, 6) AS mad, round(quantile_cont(value, 0.95) {W72}, 6) AS p95 FROM ev""")
def rolling_median_mad(spark, sf_dir):
    frames = Frames(["person_id"], "t")
    w = frames.frame(72 * H)
    row, asked = frames.row("event_id"), {"med": w.median("value"), "mad": w.mad("value"), "p95": w.percentile("value", 0.95)}
    return frames.answer(series(spark, sf_dir), BLOCK).select(row.alias("event_id"), *[r(c).alias(n) for n, c in asked.items()])


_PAST = f"OVER (PARTITION BY person_id ORDER BY t RANGE BETWEEN {10 * 24 * H} PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {EV}, e AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS ok FROM ev),
    b AS (SELECT event_id, value, median(ok) {_PAST} AS med, mad(ok) {_PAST} AS mad, count(ok) {_PAST} AS n FROM e)
    SELECT event_id, n AS baseline_sample_count, CASE WHEN n >= 3 THEN round((value - med) / (1.4826 * mad + 1e-6), 4) END AS robust_z FROM b""")
def personal_robust_z(spark, sf_dir):
    """Against the strictly earlier ten days, targets left out of the baseline."""
    ok = F.when(F.col("event_type") != "error", F.col("value"))
    s = series(spark, sf_dir).withColumn("ok", ok)
    out = windows.trailing(s, ["person_id"], "t", 10 * DAY, {"n": lambda w: F.count("ok").over(w), "m": lambda w: F.percentile("ok", F.lit(0.5)).over(w), "d": lambda w: windows.mad(F.collect_list("ok").over(w))}, until=-1)
    z = (F.col("value") - F.col("m")) / (F.lit(1.4826) * F.col("d") + F.lit(1e-6))
    return out.select("event_id", F.col("n").alias("baseline_sample_count"), F.when(F.col("n") >= 3, r(z, 4)).alias("robust_z"))


_WD = "OVER (PARTITION BY person_id ORDER BY d RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {EV}, b AS (SELECT person_id, t // {D} AS d, median(value) FILTER (event_type <> 'error') AS m, count(*) FILTER (event_type <> 'error') AS n FROM ev GROUP BY 1, 2),
    p AS (SELECT person_id, d, sum(n) {_WD} AS n, median(m) {_WD} AS med, mad(m) {_WD} AS mad, d - min(CASE WHEN n > 0 THEN d END) {_WD} AS age FROM b)
    SELECT event_id, CAST(coalesce(p.n, 0) AS BIGINT) AS baseline_sample_count, round(age * 86400.0, 3) AS baseline_age_sec,
      CASE WHEN age >= 1 THEN round((value - med) / (1.4826 * mad + 1e-9), 3) END AS robust_z FROM ev JOIN p ON p.person_id = ev.person_id AND p.d = ev.t // {D}""")
def bucketed_baseline(spark, sf_dir):
    """The long-lookback baseline over daily medians."""
    s = series(spark, sf_dir).select("event_id", "person_id", "t", "value", "event_type")
    out = features.personal_baseline(s, ["person_id"], "t", "value", F.col("event_type") != "error", 10 * DAY, DAY, DAY)
    return out.select("event_id", "baseline_sample_count", r(F.col("baseline_age_sec"), 3).alias("baseline_age_sec"), r(F.col("value_personal_robust_z"), 3).alias("robust_z"))


@query(f"""WITH {EV} SELECT event_id, round((t - max(CASE WHEN event_type = 'error' THEN t END) OVER (PARTITION BY person_id ORDER BY t RANGE UNBOUNDED PRECEDING)) / 1e9, 6) AS time_since_onset_sec FROM ev""")
def time_since_last(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("onset", F.when(F.col("event_type") == "error", F.col("t")))
    out = windows.latest(s, ["person_id"], "t", ["onset"], BLOCK)
    return out.select("event_id", r((F.col("t") - F.col("onset")) / F.lit(1e9)).alias("time_since_onset_sec"))


@query(f"""WITH {EV}, n AS (SELECT event_id, t, min(CASE WHEN event_type = 'error' THEN t END) OVER (PARTITION BY person_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM ev)
    SELECT event_id, round((nxt - t) / 1e9, 6) AS next_target_onset_sec, coalesce(nxt - t <= {24 * H}, false) AS within_24h, coalesce(nxt - t <= {72 * H}, false) AS within_72h FROM n""")
def next_onset_forecast(spark, sf_dir):
    """The next onset strictly after each row, within (0, h]."""
    s = series(spark, sf_dir)
    marks = s.filter("event_type = 'error'").select("person_id", (F.col("t") - 1).alias("t"), F.col("t").alias("nxt"), F.lit(None).cast("long").alias("event_id"))
    both = s.select("person_id", "t", F.lit(None).cast("long").alias("nxt"), "event_id").unionByName(marks)
    out = windows.upcoming(both, ["person_id"], "t", ["nxt"], BLOCK).filter(F.col("event_id").isNotNull())
    within = labels.forecasts(F.col("nxt"), F.col("t"), (24, 72), HOUR)
    return out.select("event_id", r((F.col("nxt") - F.col("t")) / F.lit(1e9)).alias("next_target_onset_sec"), *[c.alias(n) for n, c in zip(("within_24h", "within_72h"), within.values(), strict=True)])


@query(f"""WITH {EV}
    SELECT a.event_id, b.value AS latest_purchase FROM ev a ASOF LEFT JOIN (SELECT person_id, t, value FROM ev WHERE event_type = 'purchase') b ON a.person_id = b.person_id AND a.t >= b.t""")
def asof_latest_value(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.latest(s, ["person_id"], "t", ["p"], BLOCK).select("event_id", F.col("p").alias("latest_purchase"))


@query(f"""WITH {EV}, n AS (SELECT a.event_id, a.t, b.t AS bt FROM ev a ASOF LEFT JOIN (SELECT person_id, t FROM ev WHERE event_type = 'view') b ON a.person_id = b.person_id AND a.t <= b.t WHERE a.event_type = 'click')
    SELECT event_id, round((bt - t) / 1e9, 6) AS transit_sec FROM n""")
def nearest_following_pair(spark, sf_dir):
    """Each click with the first view at or after it: how a heart beat finds its pulse."""
    s = series(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "view", F.col("t")))
    out = windows.upcoming(s, ["person_id"], "t", ["v"], BLOCK).filter("event_type = 'click'")
    return out.select("event_id", r((F.col("v") - F.col("t")) / F.lit(1e9)).alias("transit_sec"))


# intervals and labels -----------------------------------------------------------------------------------------------

_SPANS = f"""sp AS (SELECT person_id, event_id AS target_id, t - {6 * H} AS a, t - {H} AS pre_late, t AS onset, t + {H} AS peak, t + {3 * H} AS peak_end, t + {6 * H} AS rec, t + {10 * H} AS late, t + {12 * H} AS b FROM ev WHERE event_type = 'error')"""


def spans(s: DataFrame) -> DataFrame:
    """Intervals around the targets of a series, with the boundaries of their phases."""
    at = lambda h: F.col("t") + F.lit(int(h * H)).cast("long")
    marks = {"a": -6, "start_time_ns": -6, "pre_late_start_time_ns": -1, "onset_time_ns": 0, "peak_start_time_ns": 1, "peak_end_time_ns": 3, "recovery_early_end_time_ns": 6, "recovery_late_end_time_ns": 10, "end_time_ns": 12, "b": 12}
    return s.filter("event_type = 'error'").select("person_id", F.col("event_id").alias("target_id"), *[at(h).alias(n) for n, h in marks.items()])


@query(f"""WITH {EV}, {_SPANS} SELECT ev.event_id, target_id,
      CASE WHEN target_id IS NULL THEN 'baseline' WHEN t < pre_late THEN 'pre_early' WHEN t < onset THEN 'pre_late' WHEN t < peak THEN 'onset' WHEN t < peak_end THEN 'peak' WHEN t < rec THEN 'recovery_early' WHEN t < late THEN 'recovery_late' ELSE 'post' END AS event_phase,
      CASE WHEN target_id IS NULL THEN 0 WHEN t < pre_late THEN 1 WHEN t < onset THEN 2 WHEN t < peak THEN 3 WHEN t < peak_end THEN 4 WHEN t < rec THEN 5 WHEN t < late THEN 6 ELSE 7 END AS phase_code
    FROM ev LEFT JOIN sp ON ev.person_id = sp.person_id AND t >= a AND t < b""")
def phase_label_interval_join(spark, sf_dir):
    s = series(spark, sf_dir)
    j = intervals.during(s.select(F.col("event_id").alias("row_id"), "person_id", "t"), spans(s), ["person_id"], "t", "a", "b", DAY).withColumn("event_id", F.col("target_id"))
    phase = labels.phase_at(F.col("t"))
    return j.select(F.col("row_id").alias("event_id"), "target_id", phase.alias("event_phase"), labels.phase_code(phase).alias("phase_code"))


@query(f"""WITH {EV}, {_SPANS}, h AS (SELECT ev.event_id, string_agg(CAST(target_id AS VARCHAR), ',' ORDER BY CAST(target_id AS VARCHAR)) AS l, count(*) AS n FROM ev JOIN sp ON ev.person_id = sp.person_id AND t >= a AND t < b GROUP BY 1)
    SELECT ev.event_id, coalesce(l, '') AS active_targets, coalesce(n, 0) AS n_active FROM ev LEFT JOIN h USING (event_id)""")
def overlap_list(spark, sf_dir):
    s = series(spark, sf_dir)
    sp = spans(s).withColumn("target_id", F.col("target_id").cast("string"))
    out = intervals.overlap_lists(s.select("event_id", "person_id", "t"), sp, ["person_id"], "t", "a", "b", DAY, {"l": "target_id"})
    return out.select("event_id", F.array_join("l", ",").alias("active_targets"), F.size("l").cast("long").alias("n_active"))


@query(f"""WITH {EV}, {_SPANS} SELECT event_id FROM ev WHERE EXISTS (SELECT 1 FROM sp WHERE ev.person_id = sp.person_id AND t >= a AND t < b)""")
def clip_semi_join(spark, sf_dir):
    s = series(spark, sf_dir)
    return intervals.during(s, spans(s), ["person_id"], "t", "a", "b", DAY, "left_semi").select("event_id")


@query(f"""WITH {EV}, {_SPANS} SELECT event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM sp WHERE ev.person_id = sp.person_id AND t >= a AND t < b)""")
def matched_baseline_anti_join(spark, sf_dir):
    s = series(spark, sf_dir)
    return intervals.during(s, spans(s), ["person_id"], "t", "a", "b", DAY, "left_anti").select("event_id")


@query(f"""WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY person_id ORDER BY t, event_id) AS event_instance_index,
    CASE WHEN value / 100 < 1 / 3.0 THEN 'low' WHEN value / 100 < 2 / 3.0 THEN 'medium' WHEN value IS NOT NULL THEN 'high' END AS intensity_class FROM ev WHERE event_type = 'error'""")
def instance_index_intensity(spark, sf_dir):
    s = series(spark, sf_dir).filter("event_type = 'error'").select(F.lit("r").alias("run_id"), "person_id", "event_id", F.col("t").alias("start_time_ns"), "value")
    return s.select("event_id", labels.instance_index().cast("long").alias("event_instance_index"), labels.intensity_class(F.col("value") / 100).alias("intensity_class"))


@query(f"""WITH {EV}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY person_id ORDER BY t) AS d FROM ev), m AS (SELECT *, sum(CASE WHEN d IS NULL OR d > {12 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY t) AS k FROM g)
    SELECT person_id, min(t) AS session_start, count(*) AS n_events, round((max(t) - min(t)) / 1e9, 6) AS duration_sec FROM m GROUP BY person_id, k""")
def gap_sessions(spark, sf_dir):
    out = windows.sessions(series(spark, sf_dir), ["person_id"], "t", 12 * H)
    return out.groupBy("person_id", "session_start").agg(F.count(F.lit(1)).alias("n_events"), r((F.max("t") - F.min("t")) / F.lit(1e9)).alias("duration_sec"))


# physiology stand-ins -----------------------------------------------------------------------------------------------

_RR = f"""rr AS (SELECT person_id, t, (t - lag(t) OVER (PARTITION BY person_id ORDER BY t)) / 3600e9 AS rr FROM ev), dd AS (SELECT *, rr - lag(rr) OVER (PARTITION BY person_id ORDER BY t) AS d FROM rr)"""


def intervals_of(s: DataFrame) -> DataFrame:
    before = windows.lagged(s.select("person_id", "t"), ["person_id"], "t", "t", "_t", BLOCK)
    rr = before.select("person_id", "t", ((F.col("t") - F.col("_t")) / F.lit(3600e9)).alias("rr"))
    return windows.lagged(rr, ["person_id"], "t", "rr", "_rr", BLOCK).select("person_id", "t", "rr", (F.col("rr") - F.col("_rr")).alias("d"))


@query(f"""WITH {EV}, {_RR} SELECT person_id, round(avg(rr), 6) AS rr_mean, round(stddev_samp(rr), 5) AS sdnn, round(stddev_samp(d), 5) AS sdsd, round(sqrt(avg(d * d)), 5) AS rmssd, round(avg(CASE WHEN abs(d) > 5 THEN 1.0 ELSE 0.0 END) FILTER (d IS NOT NULL), 6) AS pnn5,
    round(stddev_samp(rr) / avg(rr), 6) AS cvnn, round(median(rr), 6) AS rr_median, round(mad(rr), 6) AS rr_mad FROM dd GROUP BY 1 HAVING count(d) >= 3""")
def rmssd_sdnn_pnn(spark, sf_dir):
    d = windows.written(intervals_of(series(spark, sf_dir)))
    out = d.groupBy("person_id").agg(F.count("d").alias("n"), r(F.avg("rr")).alias("rr_mean"), r(F.stddev_samp("rr"), 5).alias("sdnn"), r(F.stddev_samp("d"), 5).alias("sdsd"), r(F.sqrt(F.avg(F.col("d") * F.col("d"))), 5).alias("rmssd"),
        r(F.avg((F.abs("d") > 5).cast("double"))).alias("pnn5"), r(F.stddev_samp("rr") / F.avg("rr")).alias("cvnn"))
    middle = windows.group_mad(d, ["person_id"], "rr", "_m", "_mad").select("person_id", r(F.col("_m")).alias("rr_median"), r(F.col("_mad")).alias("rr_mad"))
    return out.filter("n >= 3").drop("n").join(middle, "person_id")


@query(f"""WITH {EV}, {_RR}, a AS (SELECT person_id, var_samp(d) AS vd, var_samp(rr) AS vr FROM dd GROUP BY 1 HAVING count(d) >= 3)
    SELECT person_id, round(sqrt(vd / 2), 5) AS sd1, round(sqrt(greatest(2 * vr - vd / 2, 0)), 5) AS sd2, CASE WHEN 2 * vr - vd / 2 > 1e-9 THEN round(sqrt(vd / 2) / sqrt(2 * vr - vd / 2), 5) END AS sd1_sd2_ratio FROM a""")
def poincare(spark, sf_dir):
    a = intervals_of(series(spark, sf_dir)).groupBy("person_id").agg(F.count("d").alias("n"), F.var_samp("d").alias("vd"), F.var_samp("rr").alias("vr")).filter("n >= 3")
    sd2 = 2 * F.col("vr") - F.col("vd") / 2
    return a.select("person_id", r(F.sqrt(F.col("vd") / 2), 5).alias("sd1"), r(F.sqrt(F.greatest(sd2, F.lit(0.0))), 5).alias("sd2"), F.when(sd2 > 1e-9, r(F.sqrt(F.col("vd") / 2) / F.sqrt(sd2), 5)).alias("sd1_sd2_ratio"))


@query("""SELECT l_orderkey, l_linenumber, round(sqrt(l_discount * l_discount + l_tax * l_tax + l_quantity / 50 * l_quantity / 50), 6) AS vm, round(greatest(sqrt(l_discount * l_discount + l_tax * l_tax + l_quantity / 50 * l_quantity / 50) - 1, 0), 6) AS enmo,
    round(abs(l_discount) + abs(l_tax) + abs(l_quantity / 50), 6) AS sma FROM lineitem""")
def vector_magnitude_enmo(spark, sf_dir):
    """Vector magnitude, ENMO and magnitude area; (discount, tax, quantity / 50) stand in for the axes."""
    x, y, z = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50
    vm = F.sqrt(x * x + y * y + F.col("l_quantity") / 50 * F.col("l_quantity") / 50)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", r(vm).alias("vm"), r(F.greatest(vm - 1, F.lit(0.0))).alias("enmo"), r(F.abs(x) + F.abs(y) + F.abs(z)).alias("sma"))


@query("""WITH j AS (SELECT l_orderkey, sqrt(pow(l_discount - lag(l_discount) OVER w, 2) + pow(l_tax - lag(l_tax) OVER w, 2)) AS j FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax))
    SELECT l_orderkey, round(avg(j), 6) AS jerk_mean, round(quantile_cont(j, 0.95), 6) AS jerk_p95 FROM j WHERE j IS NOT NULL GROUP BY 1""")
def jerk_p95(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    d = lambda c: F.pow(F.col(c) - F.lag(c).over(w), F.lit(2.0))
    j = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.sqrt(d("l_discount") + d("l_tax")).alias("j")).filter(F.col("j").isNotNull())
    return j.groupBy("l_orderkey").agg(r(F.avg("j")).alias("jerk_mean"), r(F.percentile("j", F.lit(0.95))).alias("jerk_p95"))


_DAILY = f"day AS (SELECT person_id, t // {D} AS d, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS x, sum(CASE WHEN event_type <> 'click' THEN value ELSE 0 END) AS y FROM ev GROUP BY 1, 2)"


def daily(s: DataFrame) -> DataFrame:
    x, v = F.col("event_type") == "click", F.col("value")
    return s.groupBy("person_id", floor_div(F.col("t"), D).alias("d")).agg(F.sum(F.when(x, v).otherwise(0)).alias("x"), F.sum(F.when(x, 0).otherwise(v)).alias("y"))


@query(f"""WITH {EV}, {_DAILY}, l AS (SELECT *, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2 FROM day WINDOW w AS (PARTITION BY person_id ORDER BY d)),
    c AS (SELECT person_id, corr(x, y) AS c0, corr(x, y1) AS c1, corr(x, y2) AS c2, count(y2) AS n, var_pop(x) AS vx FROM l GROUP BY 1)
    SELECT person_id, round(greatest(c0, c1, c2), 5) AS lag_corr_max, CASE greatest(c0, c1, c2) WHEN c0 THEN 0 WHEN c1 THEN 1 ELSE 2 END AS best_lag FROM c WHERE n >= 8 AND vx > 0""")
def lag_corr_max(spark, sf_dir):
    """The largest correlation of one series with another some days earlier, and that lag."""
    w = Window.partitionBy("person_id").orderBy("d")
    lagged = daily(series(spark, sf_dir)).select("*", F.lag("y").over(w).alias("y1"), F.lag("y", 2).over(w).alias("y2"))
    c = lagged.groupBy("person_id").agg(*[F.try_divide(F.covar_pop(*_paired("x", y)), F.nullif(F.stddev_pop(_paired("x", y)[0]) * F.stddev_pop(_paired("x", y)[1]), F.lit(0.0))).alias(n) for n, y in (("c0", "y"), ("c1", "y1"), ("c2", "y2"))], F.count("y2").alias("n"), F.var_pop("x").alias("vx"))
    best = F.greatest("c0", "c1", "c2")
    return c.filter("n >= 8 AND vx > 0").select("person_id", r(best, 5).alias("lag_corr_max"), F.when(best == F.col("c0"), 0).when(best == F.col("c1"), 1).otherwise(2).alias("best_lag"))


def _paired(x: str, y: str):
    return F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))


@query(f"""WITH {EV}, {_DAILY}, m AS (SELECT *, regr_intercept(x, y) OVER w AS a, regr_slope(x, y) OVER w AS b, count(*) OVER w AS n, var_pop(y) OVER w AS vy FROM day WINDOW w AS (PARTITION BY person_id ORDER BY d RANGE BETWEEN 14 PRECEDING AND CURRENT ROW))
    SELECT person_id, d, CASE WHEN n >= 4 AND vy > 1e-9 THEN round(x - (a + b * y), 4) END AS residual FROM m""")
def motion_residual(spark, sf_dir):
    """What a line on another series over the trailing fortnight leaves of a value."""
    x, y = F.col("x"), F.col("y")
    out = windows.trailing(daily(series(spark, sf_dir)), ["person_id"], "d", 15, {"a": lambda w: F.regr_intercept(x, y).over(w), "b": lambda w: F.regr_slope(x, y).over(w), "n": lambda w: F.count(F.lit(1)).over(w), "vy": lambda w: F.var_pop(y).over(w)})
    return out.select("person_id", "d", F.when((F.col("n") >= 4) & (F.col("vy") > 1e-9), r(x - (F.col("a") + F.col("b") * y), 4)).alias("residual"))


@query(f"""WITH {EV}, f AS (SELECT person_id, min(t) FILTER (event_type = 'click' AND value > 80) AS a, min(t) FILTER (event_type = 'view' AND value > 80) AS b, min(t) FILTER (event_type = 'signup' AND value > 80) AS c FROM ev GROUP BY 1),
    u AS (SELECT person_id, unnest(['eeg', 'eda', 'motor']) AS m, unnest([a, b, c]) AS t FROM f) SELECT person_id, coalesce(string_agg(m, '>' ORDER BY t) FILTER (t IS NOT NULL), '') AS onset_order FROM u GROUP BY 1""")
def onset_order_code(spark, sf_dir):
    s = series(spark, sf_dir)
    first = lambda kind: F.min(F.when((F.col("event_type") == kind) & (F.col("value") > 80), F.col("t")))
    f = s.groupBy("person_id").agg(first("click").alias("a"), first("view").alias("b"), first("signup").alias("c"))
    return f.select("person_id", features.onset_order({"eeg": F.col("a"), "eda": F.col("b"), "motor": F.col("c")}).alias("onset_order"))


_X = "embedding"


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), f AS (SELECT vec_id, x, list_transform(range(1, len(x)), lambda i: x[i + 1] - x[i]) AS d FROM e)
    SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 5) AS rms_uv, round(list_max(x) - list_min(x), 5) AS peak_to_peak_uv, round(list_sum(list_transform(d, lambda v: abs(v))), 4) AS line_length,
      round(list_sum(list_transform(range(1, len(x)), lambda i: CASE WHEN sign(x[i]) <> sign(x[i + 1]) THEN 1.0 ELSE 0.0 END)) / (len(x) - 1), 6) AS zero_crossing_rate,
      round(list_sum(list_transform(x, lambda v: v * v)) / len(x) - pow(list_sum(x) / len(x), 2), 5) AS hjorth_activity FROM f""")
def waveform_features(spark, sf_dir):
    """Time-domain features of one array of samples (an embedding stands in for a second of waveform)."""
    x = F.col(_X)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", r(arrays.rms(x), 5).alias("rms_uv"), r(arrays.peak_to_peak(x), 5).alias("peak_to_peak_uv"), r(arrays.line_length(x), 4).alias("line_length"), r(arrays.zero_crossing_rate(x)).alias("zero_crossing_rate"), r(arrays.variance(x), 5).alias("hjorth_activity"))


_BAND_OF = " ".join(f"WHEN k < {hi} THEN '{b}'" for b, (_, hi) in spectral.BANDS.items())
_BAND_COLUMNS = ", ".join(f"sum(CASE WHEN band = '{b}' THEN p ELSE 0 END) AS {b}" for b in spectral.BANDS)


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), m AS (SELECT vec_id, x, list_sum(x) / len(x) AS mu FROM e),
    i AS (SELECT vec_id, i, (x[i + 1] - mu) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS y FROM m, (SELECT unnest(range(0, 64)) AS i)),
    f AS (SELECT vec_id, k, (pow(sum(y * cos(2 * pi() * k * i / 64)), 2) + pow(sum(y * sin(2 * pi() * k * i / 64)), 2)) / (64 * 24.0) * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS p FROM i, (SELECT unnest(range(1, 33)) AS k) GROUP BY 1, 2),
    g AS (SELECT *, CASE {_BAND_OF} END AS band, k < 32 AS used FROM f), b AS (SELECT vec_id, {_BAND_COLUMNS}, sum(p) AS whole, sum(p) FILTER (used) AS u, sum(p) FILTER (k > 30) AS fast FROM g GROUP BY 1),
    q AS (SELECT g.vec_id, k, p, p / u AS s, sum(p / u) OVER (PARTITION BY g.vec_id ORDER BY k) AS upto FROM g JOIN b ON b.vec_id = g.vec_id WHERE used),
    h AS (SELECT vec_id, -sum(s * ln(s)) / ln(31) AS entropy, min(k) FILTER (upto >= 0.95) AS edge, min(k) FILTER (upto >= 0.5) AS middle, arg_max(k, p) AS top, regr_slope(log10(p), log10(k)) AS slope, regr_intercept(log10(p), log10(k)) AS base FROM q GROUP BY 1)
    SELECT b.vec_id, {", ".join(f"round({x} + 1e-9, 5) AS {x}_abs_power, round({x} / whole + 1e-9, 5) AS {x}_relative_power" for x in spectral.BANDS)}, round(theta / beta + 1e-9, 5) AS theta_beta_ratio, round(beta / alpha + 1e-9, 5) AS beta_alpha_ratio,
      round(entropy + 1e-9, 5) AS spectral_entropy, edge::DOUBLE AS spectral_edge_95hz, middle::DOUBLE AS median_frequency_hz, top::DOUBLE AS dominant_frequency_hz, round(-slope + 1e-9, 5) AS aperiodic_exponent, round(base + 1e-9, 5) AS aperiodic_offset,
      0.0 AS line_noise_ratio, round(fast / whole + 1e-9, 5) AS high_freq_artifact_ratio FROM b JOIN h ON h.vec_id = b.vec_id""")
def spectral_features(spark, sf_dir):
    """Band powers, ratios, entropy, edges and aperiodic fit by the Arrow kernel, against a discrete Fourier transform in SQL."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    s = e.withColumn("s", spectral.summary_udf(64.0)(F.col(_X)))
    plain = ("spectral_edge_95hz", "median_frequency_hz", "dominant_frequency_hz", "line_noise_ratio")
    return s.select("vec_id", *[F.col(f"s.{n}") if n in plain else r(F.col(f"s.{n}") + 1e-9, 5).alias(n) for n in spectral.SUMMARY_TYPE.names])


# features over a timeline that stands in for one ------------------------------------------------------------------------

#: Users dealt to sixteen persons; a person's events, in order, are one second each.
TL = """tl0 AS (SELECT 'p' || (user_id % 16) AS person_id, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS s, event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events),
    tl AS (SELECT *, CASE WHEN event_type <> 'signup' THEN 60 + value * 0.4 END AS hr, CASE WHEN event_type <> 'signup' THEN 60000 / (60 + value * 0.4) END AS rr, 60 + k * 0.4 AS whr, 60000 / (60 + k * 0.4) AS ibi, 1 + value / 20 AS eda,
      sqrt(value / 100 * value / 100 + k / 100 * k / 100 + 0.25) AS vm, greatest(sqrt(value / 100 * value / 100 + k / 100 * k / 100 + 0.25) - 1, 0) AS enmo, abs(value - k) / 10 AS jerk, value / 100 + k / 100 + 0.5 AS sma,
      CASE WHEN event_type = 'view' THEN value END AS skin, CASE WHEN event_type = 'click' THEN k END AS ambient, value * 50 AS dc, k + 1 AS ac, CASE WHEN event_type <> 'view' THEN 600 + value END AS pulse,
      CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.25 END AS cover, """ + ", ".join(f"1 + value * {b + 1} / 100 + k * {j + 1} / 50 AS {c}_{band}" for j, c in enumerate(features.CHANNELS) for b, band in enumerate(spectral.BANDS)) + " FROM tl0)"
_PR = """pr AS (SELECT *, rr - lag(rr) OVER o AS drr, hr - lag(hr) OVER o AS dhr, eda - lag(eda) OVER o AS deda, median(rr) OVER h AS rr_med, eda - median(eda) OVER h AS phasic, lag(eda) OVER o AS e1, lag(eda, 2) OVER o AS e2,
      lag(eda) OVER o - min(eda) OVER l AS amp, CASE WHEN enmo > 0.1 AND coalesce(lag(enmo) OVER o, 0) <= 0.1 THEN 1 ELSE 0 END AS burst, lag(hr, 5) OVER o AS hr5, lag(hr, 10) OVER o AS hr10, lag(hr, 20) OVER o AS hr20,
      acos(least(greatest((value / 100 * lag(value) OVER o / 100 + k / 100 * lag(k) OVER o / 100 + 0.25) / (vm * lag(vm) OVER o), -1), 1)) AS turn FROM tl
    WINDOW o AS (PARTITION BY person_id ORDER BY s), h AS (PARTITION BY person_id ORDER BY s RANGE BETWEEN 29 PRECEDING AND CURRENT ROW), l AS (PARTITION BY person_id ORDER BY s RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)),
    ps AS (SELECT *, e1 > e2 AND e1 >= eda AND amp > 0.03 AS scr FROM pr)"""


def stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a 1 Hz timeline: every event is a second of some person."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    person = F.concat(F.lit("p"), F.pmod("user_id", F.lit(16)).cast("string"))
    k, v = F.get_json_object("props", "$.k").cast("double"), F.col("value")
    second = F.row_number().over(Window.partitionBy(F.pmod("user_id", F.lit(16))).orderBy("ts", "event_id")).cast("long")
    base = e.select(F.lit("r").alias("run_id"), person.alias("person_id"), (second * F.lit(SECOND).cast("long")).alias("canonical_time_ns"), "event_type", "value", k.alias("k"))
    x, y = v / 100, F.col("k") / 100
    vm = F.sqrt(x * v / 100 + y * F.col("k") / 100 + 0.25)
    hr = F.when(F.col("event_type") != "signup", 60 + v * 0.4)
    given = {
        "hr_bpm": hr, "rr_ms": F.lit(60000) / hr, "watch_hr_bpm": 60 + F.col("k") * 0.4, "watch_ibi_ms": F.lit(60000) / (60 + F.col("k") * 0.4), "eda_us": 1 + v / 20, "wrist_x": x, "wrist_y": y, "wrist_z": F.lit(0.5), "wrist_vm": vm,
        "wrist_enmo": F.greatest(vm - 1, F.lit(0.0)), "wrist_jerk": F.abs(v - F.col("k")) / 10, "wrist_sma": x + y + 0.5, "wrist_coverage_ratio": F.lit(1.0), "skin_temp_c": F.when(F.col("event_type") == "view", v),
        "ambient_temp_c": F.when(F.col("event_type") == "click", F.col("k")),
    }
    given |= {"ppg_green_dc": v * 50, **{f"ppg_{c}_ac": F.col("k") + 1 for c in ("green", "ir", "red")}, "ppg_interval_ms": F.when(F.col("event_type") != "view", 600 + v)}
    for j, c in enumerate(features.CHANNELS):
        given |= {f"eeg_{c}_1s_{band}_abs_power": 1 + v * (b + 1) / 100 + F.col("k") * (j + 1) / 50 for b, band in enumerate(spectral.BANDS)}
        given |= {f"eeg_{c}_1s_{n}": F.col("k") / 100 for n in ("spectral_entropy", "line_noise_ratio", "high_freq_artifact_ratio")} | {f"eeg_{c}_rms_uv": v, f"eeg_{c}_coverage_ratio": F.when(F.col("event_type") != "error", 1.0).otherwise(0.25)}
    cover = F.when(F.col("event_type") != "error", 1.0).otherwise(0.25)
    given |= {
        "ecg_rpeak_count": F.floor(F.col("k") / 40).cast("double"), "ecg_coverage_ratio": cover, "ecg_rr_ms": F.when(F.col("event_type") != "view", F.lit(60000) / (60 + F.col("k") * 0.4)), "ecg_rpeak_confidence": F.col("k") / 100,
        "ecg_mean_uv": v, "ecg_rms_uv": v + 50, "ecg_line_length": v + F.col("k"), "chest_enmo": F.greatest(vm - 1, F.lit(0.0)), "head_vm": vm, "eeg_gfp": F.col("k"), "quality_min": cover,
    }
    missing = [f"{l}_{n}" for l in ("head", "chest") for n in ("x", "y", "z", "vm", "enmo", "jerk", "sma", "coverage_ratio") if f"{l}_{n}" not in given]
    return base.withColumns(given | {n: F.lit(None).cast("double") for n in missing})


def windowed_features(spark, sf_dir, family: str, names: list[str], window: int = 60, digits: int = 6) -> DataFrame:
    """Shipped window features of one family over the stand-in timeline."""
    out = features.window_features(stand_in(spark, sf_dir), window, families=(family,))
    second = floor_div(F.col("canonical_time_ns"), SECOND).alias("s")
    return out.select("person_id", second, "feature_valid", *[r(F.col(n).cast("double") + 1e-9, digits).alias(n) for n in names])  # off ties, that the order of sums would decide


def _window_sql(columns: dict[str, str], window: int = 60, digits: int = 6) -> str:
    """The same from SQL expressions, in which W stands for the window."""
    w = f"OVER (PARTITION BY person_id ORDER BY s RANGE BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    made = ", ".join(f"{re.sub(r'\bW\b', w, x)} AS {n}" for n, x in columns.items())
    gated = ", ".join(f"CASE WHEN rows_there >= {0.8 * window} THEN round(CAST({n} AS DOUBLE) + 1e-9, {digits}) END AS {n}" for n in columns)
    return f"WITH {TL}, {_PR}, wf AS (SELECT person_id, s, count(*) {w} AS rows_there, {made} FROM ps) SELECT person_id, s, rows_there >= {0.8 * window} AS feature_valid, {gated} FROM wf"


_ENOUGH = "CASE WHEN count(rr) W >= 30 THEN {0} END"
_CARDIAC = {
    "hr_mean_bpm": "avg(hr) W", "hr_median_bpm": "median(hr) W", "hr_min_bpm": "min(hr) W", "hr_max_bpm": "max(hr) W", "hr_std_bpm": "stddev_samp(hr) W", "hr_slope_bpm_per_min": "CASE WHEN count(hr) W >= 2 THEN regr_slope(hr, s::DOUBLE) W * 60 END",
    "hr_acceleration_bpm_per_sec": "avg(dhr) W", "polar_rr_device_median_ms": "median(rr) W", "ecg_rr_valid_ratio": "avg(CASE WHEN rr IS NOT NULL THEN CAST(rr BETWEEN 300 AND 2000 AS DOUBLE) END) W",
    "ecg_rr_missed_peak_suspect_count": "sum(CASE WHEN rr > 1.6 * rr_med THEN 1 WHEN rr IS NOT NULL THEN 0 END) W", "ecg_rr_extra_peak_suspect_count": "sum(CASE WHEN rr < 0.6 * rr_med THEN 1 WHEN rr IS NOT NULL THEN 0 END) W",
    **{n: _ENOUGH.format(x) for n, x in {"rr_mean_ms": "avg(rr) W", "rr_median_ms": "median(rr) W", "rr_mad_ms": "mad(rr) W", "sdnn_ms": "stddev_samp(rr) W", "rmssd_ms": "sqrt(avg(drr * drr) W)", "sdsd_ms": "stddev_samp(drr) W",
        "pnn20": "avg(CASE WHEN drr IS NOT NULL THEN CAST(abs(drr) > 20 AS DOUBLE) END) W", "pnn50": "avg(CASE WHEN drr IS NOT NULL THEN CAST(abs(drr) > 50 AS DOUBLE) END) W", "cvnn": "stddev_samp(rr) W / avg(rr) W"}.items()},
}
_EDA = {
    "eda_mean_us": "avg(eda) W", "eda_median_us": "median(eda) W", "eda_min_us": "min(eda) W", "eda_max_us": "max(eda) W", "eda_std_us": "stddev_samp(eda) W", "eda_slope_us_per_min": "CASE WHEN count(eda) W >= 2 THEN regr_slope(eda, s::DOUBLE) W * 60 END",
    "eda_tonic_level_us": "median(eda) W", "eda_phasic_level_us": "eda - median(eda) W", "eda_scr_count": "sum(CAST(scr AS BIGINT)) W", "eda_scr_amplitude_mean_us": "avg(CASE WHEN scr THEN amp END) W", "eda_scr_amplitude_max_us": "max(CASE WHEN scr THEN amp END) W",
    "eda_scr_area_us_sec": "sum(greatest(phasic, 0)) W", "eda_flatline_ratio": "avg(CAST(abs(deda) < 1e-6 AS DOUBLE)) W", "eda_spike_ratio": "avg(CAST(abs(deda) > 1.0 AS DOUBLE)) W", "eda_coverage_ratio": "count(eda) W / 60.0",
    "eda_quality_score": "count(eda) W / 60.0 * (1 - avg(CAST(abs(deda) > 1.0 AS DOUBLE)) W) * (1 - avg(CAST(abs(deda) < 1e-6 AS DOUBLE)) W)",
    "eda_time_since_last_scr_sec": "s - max(CASE WHEN scr THEN s END) OVER (PARTITION BY person_id ORDER BY s)",
}
_MOTION = {
    "wrist_acc_vm_mean_g": "avg(vm) W", "wrist_acc_vm_std_g": "stddev_samp(vm) W", "wrist_enmo_mean_g": "avg(enmo) W", "wrist_sma_g": "avg(sma) W", "wrist_jerk_mean_g_per_sec": "avg(jerk) W", "wrist_jerk_p95_g_per_sec": "quantile_cont(jerk, 0.95) W",
    "wrist_stillness_ratio": "avg(CAST(abs(vm - 1) < 0.05 AS DOUBLE)) W", "wrist_activity_burst_count": "sum(burst) W", "wrist_orientation_change_rate": "avg(turn) W", "wrist_coverage_ratio": "count(*) W / 60.0", "wrist_quality_score": "least(count(*) W / 60.0, 1)",
}


def _corr(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"covar_pop({x}, {y}) W / nullif(stddev_pop({x}) W * stddev_pop({y}) W, 0)"


_CROSS = {
    "watch_hr_vs_polar_hr_abs_diff_bpm": "abs(whr - hr)", "watch_ibi_vs_polar_rr_abs_diff_ms": "abs(ibi - rr)", "hr_motion_conditioned_residual": "hr - (regr_intercept(hr, enmo) W + regr_slope(hr, enmo) W * enmo)",
    "eda_motion_conditioned_residual": "eda - (regr_intercept(eda, enmo) W + regr_slope(eda, enmo) W * enmo)", "eda_hr_lag_corr_max": f"greatest({', '.join(_corr('eda', h) for h in ('hr', 'hr5', 'hr10', 'hr20'))})",
    "cross_modal_synchrony_score": f"({_corr('hr', 'eda')} + {_corr('hr', 'enmo')} + {_corr('eda', 'enmo')}) / 3", "multisensor_valid_axis_count": "CAST(count(hr) W >= 48 AS INTEGER) + CAST(count(eda) W >= 48 AS INTEGER) + CAST(count(vm) W >= 48 AS INTEGER) + CAST(count(*) W >= 48 AS INTEGER)",
    "cross_device_disagreement_score": "(avg(abs(whr - hr) / 10) W + avg(abs(ibi - rr) / 100) W) / 2",
}


@query(_window_sql(_CARDIAC))
def cardiac_window_features(spark, sf_dir):
    return windowed_features(spark, sf_dir, "cardiac", list(_CARDIAC))


_ECG = {
    "ecg_rpeak_count": "sum(floor(k / 40)) W", "polar_rr_device_median_ms": "median(rr) W", "polar_rr_ecg_median_ms": "median(CASE WHEN event_type <> 'view' THEN ibi END) W",
    "polar_rr_source_disagreement_ms": "abs(median(rr) W - median(CASE WHEN event_type <> 'view' THEN ibi END) W)", "ecg_coverage_ratio": "avg(cover) W", "ecg_rpeak_confidence_mean": "avg(k / 100) W",
    "ecg_baseline_wander_score": "stddev_samp(value) W / avg(value + 50) W", "ecg_motion_artifact_score": f"abs({_corr('(value + k)', 'enmo')})",
    "ecg_quality_score": "avg(cover) W * avg(CASE WHEN rr IS NOT NULL THEN CAST(rr BETWEEN 300 AND 2000 AS DOUBLE) END) W * avg(k / 100) W",
}
_QUALITY = {"eeg_global_field_power": "avg(k) W", "eeg_motion_correlation": _corr("value", "vm"), "multisensor_quality_min": "min(cover) W", "multisensor_quality_mean": "avg(cover) W"}


@query(_window_sql(_ECG, digits=5))
def ecg_window_features(spark, sf_dir):
    """Peaks, both sources of RR, wander, motion and quality of the ECG over a minute."""
    return windowed_features(spark, sf_dir, "cardiac", list(_ECG), digits=5)


@query(_window_sql(_QUALITY, digits=5))
def multisensor_quality_features(spark, sf_dir):
    return windowed_features(spark, sf_dir, "cross_modal", list(_QUALITY), digits=5)


_POINCARE = {"poincare_sd1_ms": "sqrt(var_samp(drr) W / 2)", "poincare_sd2_ms": "sqrt(greatest(2 * var_samp(rr) W - var_samp(drr) W / 2, 0))"}


@query(_window_sql({n: _ENOUGH.format(x) for n, x in _POINCARE.items()}, 180, 3))
def poincare_window_features(spark, sf_dir):
    return windowed_features(spark, sf_dir, "cardiac", list(_POINCARE), 180, 3)


@query(_window_sql(_EDA))
def eda_window_features(spark, sf_dir):
    return windowed_features(spark, sf_dir, "eda", list(_EDA))


@query(_window_sql(_MOTION))
def motion_window_features(spark, sf_dir):
    return windowed_features(spark, sf_dir, "motion", list(_MOTION))


@query(_window_sql(_CROSS, digits=5))
def cross_modal_window_features(spark, sf_dir):
    return windowed_features(spark, sf_dir, "cross_modal", list(_CROSS), digits=5)


#: Samples of one second from a vector of 64 entries: stream, rate, channels as (name, first entry, entries, scale, offset); entries under -0.15 are lost.
_VECTOR_STREAMS = (
    ("acc", 16, (("x", 1, 16, 4.0, 0.0), ("y", 17, 16, 4.0, 0.0), ("z", 33, 16, 4.0, 0.0))), ("eda", 4, (("eda", 1, 4, 1.0, 1.0),)), ("ecg", 32, (("ecg", 1, 32, 5000.0, 0.0),)),
    ("ppg", 16, (("green", 1, 16, 100.0, 50.0), ("ir", 17, 16, 100.0, 50.0), ("red", 33, 16, 100.0, 50.0))), ("temperature", 1, (("skin", 64, 1, 10.0, 30.0),)), ("hr_rr", 1, (("hr", 1, 1, 10.0, 60.0),)),
)
_SAMPLES = "sa AS (SELECT vec_id, label, i, CASE WHEN v >= -0.15 THEN v END AS v FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def vector_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as native seconds of six streams: every vector is a second."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    lost = F.transform("embedding", lambda v: F.when(v.cast("double") >= -0.15, v.cast("double")))

    def samples(first: int, n: int, scale: float, offset: float):
        return F.transform(F.slice("_v", first, n), lambda v: v * F.lit(scale) + F.lit(offset))

    def stream(name: str, rate: int, channels):
        pairs = [c for channel, *how in channels for c in (F.lit(channel), samples(*how))]
        quality = F.col("label") / F.lit(10.0) + F.lit(rate / 1000)
        return F.struct(F.lit(name).alias("stream_name"), F.lit(rate).alias("sample_rate_hz"), F.create_map(*pairs).alias("channels"), quality.alias("quality_native"))

    keys = [F.lit("r").alias("run_id"), F.pmod("vec_id", F.lit(16)).cast("string").alias("person_id"), F.expr("vec_id div 128").alias("clip_id"), F.lit("d").alias("device_id"), (F.col("vec_id") * F.lit(SECOND).cast("long")).alias("second_ns")]
    return e.withColumn("_v", lost).select(*keys, F.inline(F.array(*[stream(*x) for x in _VECTOR_STREAMS])))


_SECOND_COLUMNS = (
    "wrist_vm", "wrist_vm_sd", "wrist_enmo", "wrist_jerk", "wrist_sma", "wrist_coverage_ratio", "wrist_x", "ecg_rpeak_count", "ecg_rpeak_confidence", "ecg_mean_uv", "ecg_rms_uv", "ecg_line_length", "ecg_coverage_ratio",
    "eda_us", "eda_min_us", "eda_max_us", "eda_slope_us_per_sec", "eda_coverage_ratio", "ppg_green_dc", "ppg_green_ac", "ppg_ir_ac", "ppg_red_ac", "ppg_coverage_ratio", "skin_temp_c", "hr_bpm", "quality_min", "quality_score",
)


@query(f"""WITH {_SAMPLES}, ax AS (SELECT vec_id, (i - 1) % 16 AS j, max(CASE WHEN i <= 16 THEN 4 * v END) AS x, max(CASE WHEN i BETWEEN 17 AND 32 THEN 4 * v END) AS y, max(CASE WHEN i BETWEEN 33 AND 48 THEN 4 * v END) AS z FROM sa WHERE i <= 48 GROUP BY 1, 2),
    am AS (SELECT *, sqrt(x * x + y * y + z * z) AS vm, abs(x) + abs(y) + abs(z) AS sma FROM ax), ad AS (SELECT vec_id, abs(vm - lag(vm) OVER (PARTITION BY vec_id ORDER BY j)) AS d FROM am WHERE vm IS NOT NULL),
    aj AS (SELECT vec_id, avg(d) * 16 AS wrist_jerk FROM ad GROUP BY 1), aa AS (SELECT vec_id, avg(vm) AS wrist_vm, stddev_pop(vm) AS wrist_vm_sd, avg(greatest(vm - 1, 0)) FILTER (vm IS NOT NULL) AS wrist_enmo, avg(sma) AS wrist_sma,
      count(vm) / 16.0 AS wrist_coverage_ratio, avg(x) AS wrist_x FROM am GROUP BY 1),
    ec AS (SELECT vec_id, 5000 * v AS u, lag(5000 * v) OVER w AS before, lead(5000 * v) OVER w AS after FROM sa WHERE i <= 32 AND v IS NOT NULL WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
    ea AS (SELECT vec_id, count(*) FILTER (u > 500 AND u >= after AND u > coalesce(before, 0)) AS ecg_rpeak_count, least(greatest(max(u) / 1000, 0), 1) AS ecg_rpeak_confidence, avg(u) AS ecg_mean_uv, sqrt(avg(u * u)) AS ecg_rms_uv,
      sum(abs(u - before)) AS ecg_line_length, count(*) / 32.0 AS ecg_coverage_ratio FROM ec GROUP BY 1),
    ed AS (SELECT vec_id, v + 1 AS u, row_number() OVER (PARTITION BY vec_id ORDER BY i) / 4.0 AS sec FROM sa WHERE i <= 4 AND v IS NOT NULL),
    da AS (SELECT vec_id, avg(u) AS eda_us, min(u) AS eda_min_us, max(u) AS eda_max_us, CASE WHEN count(*) > 1 THEN regr_slope(u, sec) END AS eda_slope_us_per_sec FROM ed GROUP BY 1),
    re AS (SELECT vec_id, count(v) FILTER (i <= 4) / 4.0 AS eda_coverage_ratio, avg(100 * v + 50) FILTER (i <= 16) AS ppg_green_dc, {", ".join(f"100 * (max(v) FILTER (i BETWEEN {a} AND {a + 15}) - min(v) FILTER (i BETWEEN {a} AND {a + 15})) AS ppg_{c}_ac" for c, a in (("green", 1), ("ir", 17), ("red", 33)))},
      count(v) FILTER (i <= 16) / 16.0 AS ppg_coverage_ratio, max(10 * v + 30) FILTER (i = 64) AS skin_temp_c, max(10 * v + 60) FILTER (i = 1) AS hr_bpm, min(label) / 10.0 + 0.001 AS quality_min, min(label) / 10.0 + 70 / 6000.0 AS quality_score FROM sa GROUP BY 1)
    SELECT vec_id, {", ".join("CAST(coalesce(ecg_rpeak_count, 0) AS BIGINT) AS ecg_rpeak_count" if c == "ecg_rpeak_count" else f"round(CAST({c} AS DOUBLE) + 1e-9, 5) AS {c}" for c in _SECOND_COLUMNS)}
    FROM re LEFT JOIN aa USING (vec_id) LEFT JOIN aj USING (vec_id) LEFT JOIN ea USING (vec_id) LEFT JOIN da USING (vec_id)""")
def second_summaries(spark, sf_dir):
    """The 1 Hz summaries of motion, ECG, skin, optical and temperature samples, some of which are lost."""
    one = devices.one_second_summaries(vector_seconds(spark, sf_dir))
    second = floor_div(F.col("canonical_time_ns"), SECOND).alias("vec_id")
    whole = F.col("ecg_rpeak_count").cast("long").alias("ecg_rpeak_count")
    return one.select(second, *[whole if c == "ecg_rpeak_count" else r(F.col(c).cast("double") + 1e-9, 5).alias(c) for c in _SECOND_COLUMNS])


@query(f"""WITH {_SAMPLES}, st AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {rate}, {c[0][1]})" for s, rate, c in _VECTOR_STREAMS)}) AS v(stream, rate, first)),
    cl AS (SELECT vec_id % 16 AS p, vec_id // 128 AS c, stream, count(v) AS n, count(*) AS due FROM sa JOIN st ON i >= first AND i < first + rate GROUP BY 1, 2, 3)
    SELECT 'sample_count' AS "check", CAST(count(*) FILTER (n < 0.7 * due) AS BIGINT) AS violations FROM cl""")
def sample_count_check(spark, sf_dir):
    """Streams of a clip that lost more than three samples in ten."""
    return validation.sample_counts(vector_seconds(spark, sf_dir))


@query(f"""SELECT CAST({len(_VECTOR_STREAMS)} * count(*) FILTER (label = 7) AS BIGINT) AS only_in_clips, CAST({len(_VECTOR_STREAMS)} * count(*) FILTER (label = 3) AS BIGINT) AS differing FROM embeddings""")
def clip_slice_check(spark, sf_dir):
    """Clips whose recording lacks some seconds and has others with another quality: both are found and counted."""
    clips = vector_seconds(spark, sf_dir)
    label = F.round((F.col("quality_native") - F.col("sample_rate_hz") / 1000) * 10)
    faulty = clips.filter(label != 7).withColumn("quality_native", F.when(label == 3, F.lit(0.0)).otherwise(F.col("quality_native")))
    key = ["run_id", "person_id", "device_id", "stream_name", "second_ns"]
    return validation.clips_are_slices(clips.unionByName(clips), faulty, key, [F.to_json("channels"), F.col("quality_native").cast("string")])


_CUTS = (100, 300, 500)


@query(f"""WITH {TL}, n AS (SELECT person_id, max(s) AS last FROM tl GROUP BY 1)
    SELECT 'future_leak' AS "check", CAST(count(*) FILTER (last > cut) AS BIGINT) AS violations FROM n, (SELECT unnest([{", ".join(map(str, _CUTS))}]) AS cut)""")
def future_leak_check(spark, sf_dir):
    """One feature of several looks a second ahead: the last second before each cut gives it away, and no other."""

    def leaking(d: DataFrame) -> DataFrame:
        ahead = d.select(*features.KEYS, features.T, F.lead("value").over(Window.partitionBy(*features.KEYS).orderBy(features.T)).alias("next_value"))
        return features.window_features(d, 60, families=("eda", "motion")).join(ahead, [*features.KEYS, features.T])

    timeline = windows.written(stand_in(spark, sf_dir))
    columns = ["eda_mean_us", "eda_median_us", "eda_time_since_last_scr_sec", "wrist_jerk_p95_g_per_sec", "next_value"]
    return validation.future_leak(timeline, leaking, [x * SECOND for x in _CUTS], features.KEYS, features.T, columns)


def _eeg_sql(c: str) -> dict[str, str]:
    total = " + ".join(f"avg({c}_{b}) W" for b in spectral.BANDS)
    return {
        f"eeg_{c}_alpha_abs_power": f"avg({c}_alpha) W", f"eeg_{c}_gamma_relative_power": f"avg({c}_gamma) W / ({total})", f"eeg_{c}_theta_beta_ratio": f"avg({c}_theta) W / avg({c}_beta) W",
        f"eeg_{c}_beta_alpha_ratio": f"avg({c}_beta) W / avg({c}_alpha) W", f"eeg_{c}_spectral_entropy": "avg(k / 100) W", f"eeg_{c}_line_noise_ratio": "avg(k / 100) W", f"eeg_{c}_rms_uv": "sqrt(avg(value * value) W)", f"eeg_{c}_coverage_ratio": "sum(cover) W / 60.0",
    }


_EEG = {n: x for c in features.CHANNELS for n, x in _eeg_sql(c).items()} | {
    "eeg_frontal_alpha_asymmetry_af7_af8": "ln(avg(af8_alpha) W) - ln(avg(af7_alpha) W)", "eeg_temporal_alpha_asymmetry_tp9_tp10": "ln(avg(tp10_alpha) W) - ln(avg(tp9_alpha) W)",
    "eeg_valid_channel_count": "4 * CAST(sum(cover) W >= 48 AS INTEGER)",
}
_OPTICAL = {
    "watch_ppg_green_dc": "avg(dc) W", "watch_ppg_green_ac_amplitude": "avg(ac) W", "watch_ppg_ir_ac_amplitude": "avg(ac) W", "watch_ppg_pulse_amplitude_variability": "stddev_samp(ac) W / avg(ac) W", "watch_ppg_pulse_rate_bpm": "60000.0 / median(pulse) W",
    "watch_ppg_saturation_ratio": "avg(CAST(dc >= 4090 AS DOUBLE)) W", "watch_ppg_quality_score": "count(ac) W / 60.0 * (1 - avg(CAST(dc >= 4090 AS DOUBLE)) W)", "watch_skin_temp_mean_c": "avg(skin) W",
    "watch_skin_temp_slope_c_per_min": "CASE WHEN count(skin) W >= 2 THEN regr_slope(skin, s::DOUBLE) W * 60 END", "watch_temp_coverage_ratio": "count(skin) W / 60.0",
}


@query(_window_sql(_EEG))
def eeg_window_spectra(spark, sf_dir):
    return windowed_features(spark, sf_dir, "eeg", list(_EEG))


@query(_window_sql(_OPTICAL))
def optical_window_features(spark, sf_dir):
    return windowed_features(spark, sf_dir, "optical", list(_OPTICAL))


@query(f"""WITH {TL} SELECT person_id, s, last_value(skin IGNORE NULLS) OVER w AS watch_skin_temp_c, last_value(ambient IGNORE NULLS) OVER w AS watch_ambient_temp_c,
    round(last_value(skin IGNORE NULLS) OVER w - last_value(ambient IGNORE NULLS) OVER w, 6) AS watch_skin_ambient_gap_c FROM tl WINDOW w AS (PARTITION BY person_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def latest_temperature(spark, sf_dir):
    """Temperatures as last known at each second."""
    out = features.latest_temperature(stand_in(spark, sf_dir))
    return out.select("person_id", floor_div(F.col("canonical_time_ns"), SECOND).alias("s"), "watch_skin_temp_c", "watch_ambient_temp_c", r(F.col("watch_skin_ambient_gap_c")).alias("watch_skin_ambient_gap_c"))


_WB = "OVER (PARTITION BY person_id ORDER BY b RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)"
_zs = lambda n, c: f"({c} - c_{n}) / (1.4826 * d_{n} + 1e-3)"
_ZS = (("hr", "hr"), ("eda", "eda"), ("wrist_motion", "enmo"))


@query(f"""WITH {TL}, ok AS (SELECT *, s // 60 AS b, event_type <> 'error' AS fit FROM tl), bu AS (SELECT person_id, b, count(hr) FILTER (fit) AS n, {", ".join(f"median({c}) FILTER (fit) AS m_{n}" for n, c in _ZS)} FROM ok GROUP BY 1, 2),
    pa AS (SELECT person_id, b, coalesce(sum(n) {_WB}, 0) AS n, (b - min(CASE WHEN n > 0 THEN b END) {_WB}) * 60.0 AS age, {", ".join(f"median(m_{n}) {_WB} AS c_{n}, mad(m_{n}) {_WB} AS d_{n}" for n, _ in _ZS)} FROM bu)
    SELECT ok.person_id, s, CAST(pa.n AS BIGINT) AS baseline_sample_count, age AS baseline_age_sec, round(least(pa.n / 60.0, 1), 6) AS baseline_confidence,
      {", ".join(f"CASE WHEN age >= 60 THEN round({_zs(n, c)}, 4) END AS {n}_personal_robust_z" for n, c in _ZS)},
      CASE WHEN age >= 60 THEN round(({" + ".join(f"coalesce(abs({_zs(n, c)}), 0)" for n, c in _ZS)}) / nullif({" + ".join(f"CAST({_zs(n, c)} IS NOT NULL AS INTEGER)" for n, c in _ZS)}, 0) + 1e-9, 4) END AS multisensor_deviation_score
      FROM ok JOIN pa ON pa.person_id = ok.person_id AND pa.b = ok.b""")
def personal_z_features(spark, sf_dir):
    """Several personal z features in one pass, targets left out of the baseline."""
    values = {"hr": "hr_bpm", "eda": "eda_us", "wrist_motion": "wrist_enmo"}
    out = features.personal_baseline(stand_in(spark, sf_dir), features.KEYS, features.T, values, F.col("event_type") != "error", 600 * SECOND, 60 * SECOND, 60 * SECOND, 1e-3)
    out = features.with_deviation(out, list(values)).withColumn("multisensor_deviation_score", r(F.col("multisensor_deviation_score") + 1e-9, 4))
    return out.select("multisensor_deviation_score", "person_id", floor_div(F.col(features.T), SECOND).alias("s"), "baseline_sample_count", "baseline_age_sec", r(F.col("baseline_confidence")).alias("baseline_confidence"), *[r(F.col(f"{n}_personal_robust_z"), 4).alias(f"{n}_personal_robust_z") for n in values])


@query(f"""WITH {TL}, w AS (SELECT person_id, s // 300 AS w, s, rr FROM tl WHERE rr IS NOT NULL), g AS (SELECT person_id, w, count(*) AS n, avg(rr) AS mu, max(s) - min(s) AS span FROM w GROUP BY 1, 2),
    f AS (SELECT *, 0.003 + j / span::DOUBLE AS hz FROM (SELECT *, unnest(range(0, CAST(ceil((0.4 - 0.003) / (1 / span::DOUBLE)) AS BIGINT))) AS j FROM g WHERE n >= 30 AND span >= 240)),
    tau AS (SELECT f.person_id, f.w, hz, any_value(mu) AS mu, any_value(n) AS n, atan2(sum(sin(4 * pi() * hz * s)), sum(cos(4 * pi() * hz * s))) / (4 * pi() * hz) AS tau FROM f JOIN w ON w.person_id = f.person_id AND w.w = f.w GROUP BY 1, 2, 3),
    p AS (SELECT tau.person_id, tau.w, hz, (pow(sum((rr - mu) * cos(2 * pi() * hz * (s - tau))), 2) / sum(pow(cos(2 * pi() * hz * (s - tau)), 2))
      + pow(sum((rr - mu) * sin(2 * pi() * hz * (s - tau))), 2) / sum(pow(sin(2 * pi() * hz * (s - tau)), 2))) / any_value(n) AS power FROM tau JOIN w ON w.person_id = tau.person_id AND w.w = tau.w GROUP BY 1, 2, 3),
    b AS (SELECT person_id, w, sum(power) FILTER (hz >= 0.003 AND hz < 0.04) AS vlf, sum(power) FILTER (hz >= 0.04 AND hz < 0.15) AS lf, sum(power) FILTER (hz >= 0.15 AND hz < 0.4) AS hf FROM p GROUP BY 1, 2)
    SELECT g.person_id, g.w * 300 + 299 AS s, round(vlf, 3) AS hrv_vlf_power, round(lf, 3) AS hrv_lf_power, round(hf, 3) AS hrv_hf_power, round(lf / hf, 5) AS hrv_lf_hf_ratio, round(vlf + lf + hf, 3) AS hrv_total_power
    FROM g LEFT JOIN b ON b.person_id = g.person_id AND b.w = g.w""")
def hrv_frequency_powers(spark, sf_dir):
    """Powers of unevenly spaced intervals in windows of five minutes."""
    k = features.hrv_kernels(stand_in(spark, sf_dir), 300)
    digits = {"hrv_vlf_power": 3, "hrv_lf_power": 3, "hrv_hf_power": 3, "hrv_lf_hf_ratio": 5, "hrv_total_power": 3}
    return k.select("person_id", floor_div(F.col(features.T), SECOND).alias("s"), *[r(F.nanvl(n, F.lit(None).cast("double")), d).alias(n) for n, d in digits.items()])


@query(f"""WITH {EV}, sc AS (SELECT person_id, event_type, t // 1000000 AS t FROM ev), n AS (SELECT a.person_id, a.t, b.t AS bt FROM sc a ASOF LEFT JOIN (SELECT person_id, t FROM sc WHERE event_type = 'view') b ON a.person_id = b.person_id AND a.t <= b.t WHERE a.event_type = 'click')
    SELECT person_id, (t // 60000000000) * 60000000000 + 59000000000 AS canonical_time_ns, round(median((bt - t) / 1e6), 6) AS ppg_ecg_pulse_transit_proxy_ms, count(*) AS pairs FROM n WHERE (bt - t) / 1e6 <= 600.0 GROUP BY 1, 2""")
def pulse_transit_windows(spark, sf_dir):
    """Median delay from beats (clicks) to the pulses that follow (views), a millionth of the time of the events."""
    s = series(spark, sf_dir).select(F.lit("r").alias("run_id"), "person_id", floor_div(F.col("t"), 1_000_000).alias("t"), "event_type")
    out = features.pulse_transit(s.filter("event_type = 'click'"), s.filter("event_type = 'view'"))
    return out.select("person_id", "canonical_time_ns", r(F.col("ppg_ecg_pulse_transit_proxy_ms")).alias("ppg_ecg_pulse_transit_proxy_ms"), "pairs")


_HJ = "list_transform(range(1, len({0})), lambda i: {0}[i + 1] - {0}[i])"
_VAR = "(list_sum(list_transform({0}, lambda v: v * v)) / len({0}) - pow(list_sum({0}) / len({0}), 2))"


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), f AS (SELECT *, {_HJ.format('x')} AS d FROM e), g AS (SELECT *, {_HJ.format('d')} AS q FROM f)
    SELECT vec_id, round({_VAR.format('x')}, 5) AS activity, round(sqrt({_VAR.format('d')} / {_VAR.format('x')}), 5) AS mobility, round(sqrt({_VAR.format('q')} / {_VAR.format('d')}) / sqrt({_VAR.format('d')} / {_VAR.format('x')}), 5) AS complexity FROM g""")
def hjorth_parameters(spark, sf_dir):
    x = F.col(_X)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", r(arrays.variance(x), 5).alias("activity"), r(arrays.hjorth_mobility(x), 5).alias("mobility"), r(arrays.hjorth_complexity(x), 5).alias("complexity"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), r AS (SELECT *, 0.2 * list_stddev_pop(x) AS tol FROM e),
    i AS (SELECT *, unnest(range(1, len(x) - 1)) AS a FROM r), p AS (SELECT i.vec_id, a, b, abs(x[a + 2] - x[b + 2]) <= tol AS more FROM (SELECT *, unnest(range(a + 1, len(x) - 1)) AS b FROM i) AS i WHERE abs(x[a] - x[b]) <= tol AND abs(x[a + 1] - x[b + 1]) <= tol),
    s AS (SELECT vec_id, -ln(count(*) FILTER (more)::DOUBLE / count(*)) AS se FROM p GROUP BY 1 HAVING count(*) FILTER (more) > 0),
    t AS (SELECT vec_id, CASE WHEN x[a] <= x[a + 1] THEN 'a' ELSE 'b' END || CASE WHEN x[a] <= x[a + 2] THEN 'a' ELSE 'c' END || CASE WHEN x[a + 1] <= x[a + 2] THEN 'b' ELSE 'c' END AS pattern FROM i),
    c AS (SELECT vec_id, pattern, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2), q AS (SELECT vec_id, -sum(n / whole * ln(n / whole)) / ln(6) AS pe FROM (SELECT *, sum(n) OVER (PARTITION BY vec_id) AS whole FROM c) GROUP BY 1)
    SELECT e.vec_id, round(se, 6) AS sample_entropy, round(pe, 6) AS permutation_entropy FROM e LEFT JOIN s ON s.vec_id = e.vec_id LEFT JOIN q ON q.vec_id = e.vec_id""")
def entropy_features(spark, sf_dir):
    """Sample and permutation entropy of one array of samples."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("k", spectral.entropy_udf()(F.col(_X)))
    return e.select("vec_id", r(F.nanvl("k.sample_entropy", F.lit(None).cast("double"))).alias("sample_entropy"), r(F.col("k.permutation_entropy")).alias("permutation_entropy"))


@query("""SELECT CAST(f AS BIGINT) AS hz, f::DOUBLE AS dominant_frequency_hz, f::DOUBLE AS median_frequency_hz, CASE WHEN f < 4 THEN 'delta' WHEN f < 8 THEN 'theta' WHEN f < 13 THEN 'alpha' WHEN f < 30 THEN 'beta' ELSE 'gamma' END AS band,
    200 AS band_power, 0 AS line_noise_percent FROM (SELECT unnest([2, 3, 5, 6, 7, 9, 10, 11, 12, 15, 20, 25, 28, 33, 38, 42]) AS f)""")
def spectral_closed_form(spark, sf_dir):
    """Sinusoids of amplitude 20: their frequency, their band, and the power A^2 / 2 in it."""
    hz = spark.createDataFrame([(f,) for f in (2, 3, 5, 6, 7, 9, 10, 11, 12, 15, 20, 25, 28, 33, 38, 42)], "hz long")
    wave = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.lit(20.0) * F.sin(F.lit(2 * math.pi / 256) * F.col("hz") * i))
    k = hz.withColumn("k", spectral.summary_udf(256.0)(wave))
    power = {b: F.col(f"k.{b}_abs_power") for b in spectral.BANDS}
    best = F.greatest(*power.values())
    band = F.coalesce(*[F.when(p == best, F.lit(b)) for b, p in power.items()])
    return k.select("hz", "k.dominant_frequency_hz", "k.median_frequency_hz", band.alias("band"), F.round(best).cast("int").alias("band_power"), F.round(100 * F.col("k.line_noise_ratio")).cast("int").alias("line_noise_percent"))


# splits, validation, sinks ------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT DISTINCT user_id AS person_id FROM events), k AS (SELECT person_id, row_number() OVER (ORDER BY sha256('{SEED}/split/' || person_id), person_id) AS rn, count(*) OVER () AS n FROM p),
    c AS (SELECT *, n * 0.67 AS a, n * 0.17 AS b, n * 0.16 AS d FROM k), f AS (SELECT *, floor(a) AS fa, floor(b) AS fb, floor(d) AS fd FROM c), z AS (SELECT *, n - fa - fb - fd AS rest FROM f),
    q AS (SELECT *, fa + CASE WHEN rest > 0 AND (CASE WHEN b - fb > a - fa THEN 1 ELSE 0 END) + (CASE WHEN d - fd >= a - fa THEN 1 ELSE 0 END) < rest THEN 1 ELSE 0 END AS na,
      fb + CASE WHEN rest > 0 AND (CASE WHEN a - fa >= b - fb THEN 1 ELSE 0 END) + (CASE WHEN d - fd >= b - fb THEN 1 ELSE 0 END) < rest THEN 1 ELSE 0 END AS nb FROM z)
    SELECT person_id, CASE WHEN rn <= na THEN 'train' WHEN rn <= na + nb THEN 'validation' ELSE 'test' END AS split FROM q""")
def person_split(spark, sf_dir):
    people = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("person_id")).distinct()
    return splits.by_person(people, SEED, {"train": 0.67, "validation": 0.17, "test": 0.16})


@query(f"""WITH {EV} SELECT CASE WHEN t - 1704067200000000000 < {21 * D} THEN 'known_person_past' ELSE 'known_person_future_day' END AS split, count(*) AS n, count(DISTINCT person_id) AS persons FROM ev GROUP BY 1""")
def future_day_split(spark, sf_dir):
    day = floor_div(F.col("t") - F.lit(1_704_067_200 * SECOND).cast("long"), D)
    s = series(spark, sf_dir).withColumn("split", splits.day_split(day, 21))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("person_id").alias("persons"))


@query(f"""WITH {EV}, k AS (SELECT event_type = 'error' AS y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk FROM ev)
    SELECT CAST(count(*) FILTER (y) AS BIGINT) AS positives, CAST(count(*) FILTER (NOT y) AS BIGINT) AS negatives, round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM k""")
def auc_rank_sum(spark, sf_dir):
    """How well one feature alone tells targets apart; near one half here."""
    s = series(spark, sf_dir).withColumn("y", F.col("event_type") == "error")
    return splits.auc(s, "value", "y").withColumn("auc", r(F.col("auc")))


@query(f"""WITH {EV}, k AS (SELECT person_id, event_type = 'error' AS y, rank() OVER (PARTITION BY person_id ORDER BY value) + (count(*) OVER (PARTITION BY person_id, value) - 1) / 2.0 AS rk FROM ev),
    a AS (SELECT person_id, CAST(count(*) FILTER (y) AS BIGINT) AS positives, CAST(count(*) FILTER (NOT y) AS BIGINT) AS negatives, sum(rk) FILTER (y) AS s FROM k GROUP BY 1)
    SELECT person_id, positives, negatives, CASE WHEN positives > 0 AND negatives > 0 THEN round((s - positives * (positives + 1) / 2.0) / (positives * negatives), 6) END AS auc FROM a""")
def auc_by_person(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("y", F.col("event_type") == "error")
    return splits.auc(s, "value", "y", ["person_id"]).withColumn("auc", r(F.col("auc")))


@query(f"""WITH {TL}, g AS (SELECT person_id, s, lag(s) OVER (PARTITION BY person_id ORDER BY s) AS before FROM tl WHERE k <> 13)
    SELECT 'time_strictly_monotone_one_second' AS "check", CAST(count(*) FILTER (before IS NOT NULL AND s - before <> 1) AS BIGINT) AS violations FROM g""")
def monotonic_check(spark, sf_dir):
    """Seconds of a timeline from which some are missing."""
    return validation.monotone(stand_in(spark, sf_dir).filter("k <> 13"), ["run_id", "person_id"], "canonical_time_ns", block=100 * SECOND)


@query(f"WITH {_people(MVP)}, {_events_sql(MVP)} SELECT 'phase_order' AS \"check\", CAST(count(*) AS BIGINT) AS violations FROM te WHERE intensity_truth > 0.6 AND onset_time_ns IS NOT NULL")
def phase_order_check(spark, sf_dir):
    """Events of which the intense ones have their onset after their end."""
    late = F.when((F.col("intensity_truth") > 0.6) & F.col("onset_time_ns").isNotNull(), F.col("end_time_ns") + 1).otherwise(F.col("onset_time_ns"))
    return validation.phase_order(truth.events(spark, MVP).withColumn("onset_time_ns", late))


@query(f"""WITH {_people(MVP)}, {_events_sql(MVP)}, g AS (SELECT lead(start_time_ns) OVER (PARTITION BY person_id ORDER BY start_time_ns) - end_time_ns AS gap FROM te WHERE is_target)
    SELECT 'target_gap' AS "check", CAST(count(*) FILTER (gap < {20_000 * SECOND}) AS BIGINT) AS violations FROM g""")
def target_gap_check(spark, sf_dir):
    """Targets that follow each other within 20,000 s, far more than the least gap."""
    return validation.target_gap(truth.events(spark, MVP), 20_000)


@query(f"""WITH {{EV}} SELECT 'event_id_unique' AS "check", CAST(count(*) FILTER (value > 90) AS BIGINT) AS violations FROM ev""".replace("{EV}", EV))
def event_id_check(spark, sf_dir):
    """A table in which some events stand twice."""
    s = series(spark, sf_dir).select("event_id", "value")
    return validation.event_ids(s.unionAll(s.filter("value > 90")))


@query("SELECT 'features_recompute' AS \"check\", CAST(count(*) FILTER (value > 90 OR event_type = 'signup') AS BIGINT) AS violations FROM events")
def recompute_check(spark, sf_dir):
    """Stored values of which some differ and some are missing from the recomputed ones."""
    s = series(spark, sf_dir).select("event_id", "value", "event_type")
    again = s.withColumn("value", F.when((F.col("value") > 90) & (F.col("event_type") != "signup"), F.col("value") + 0.01).otherwise(F.col("value"))).filter("event_type <> 'signup'")
    return validation.recomputed(s, again, ["event_id"], ["value"])


@query(f"""WITH p AS (SELECT DISTINCT user_id AS person_id FROM events), k AS (SELECT person_id, row_number() OVER (ORDER BY sha256('{SEED}/split/' || person_id), person_id) AS rn, count(*) OVER () AS n FROM p)
    SELECT 'split_overlap' AS "check", CAST(count(*) FILTER (person_id % 10 = 0 AND rn <= ceil(n * 0.5)) AS BIGINT) AS violations FROM k""")
def split_leak_check(spark, sf_dir):
    """Splits into which every tenth person was put a second time."""
    people = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("person_id")).distinct()
    halves = splits.by_person(people, SEED, {"train": 0.5, "test": 0.5})
    return validation.split_overlap(halves.unionByName(halves.filter("person_id % 10 = 0").withColumn("split", F.lit("test"))))


@query(f"""WITH {EV} SELECT count(*) AS n_rows, bit_xor({HEX15.format("event_id || '|' || person_id || '|' || t || '|' || event_type")}) AS content_hash FROM ev""")
def logical_hash(spark, sf_dir):
    """Order-free content hash: the xor of the rows' digests."""
    row = F.concat_ws("|", "event_id", "person_id", "t", "event_type")
    h = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("long")
    return series(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("content_hash"))


_WORDS = ", ".join(f"sum(CAST(('0x' || substr(h, {1 + 8 * k}, 8)) AS BIGINT)) AS w{k}" for k in range(4))


@query(f"""WITH h AS (SELECT event_type, sha256('{{"event_id":' || event_id || ',"user_id":' || user_id || '}}') AS h FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'error')),
    s AS (SELECT event_type, count(*) AS rows, {_WORDS} FROM h GROUP BY 1), c3 AS (SELECT *, w3 // 4294967296 + w2 AS v2 FROM s), c2 AS (SELECT *, v2 // 4294967296 + w1 AS v1 FROM c3), c1 AS (SELECT *, v1 // 4294967296 + w0 AS v0 FROM c2)
    SELECT event_type, rows, {" || ".join(f"format('{{:08x}}', CAST({v} % 4294967296 AS BIGINT))" for v in ("v0", "v1", "v2", "w3"))} AS hash FROM c1""")
def content_hashes(spark, sf_dir):
    """Hash of each type's rows as a multiset; errors are there twice."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return tables.partition_hashes(e.unionByName(e.filter("event_type = 'error'")), ["event_type"], ["event_id", "user_id"])


@query("""SELECT user_id AS person_id, count(*) AS rows_a, count(*) AS rows_b FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error' AND value > 90) > 0""")
def differing_partitions(spark, sf_dir):
    """Persons whose rows differ between two runs, told by hashes of their rows; one run has a few changed values."""
    s = series(spark, sf_dir).select("event_id", "person_id", "value", "event_type")
    other = s.withColumn("value", F.when((F.col("event_type") == "error") & (F.col("value") > 90), F.col("value") + 1).otherwise(F.col("value")))
    return tables.differing_partitions(s, other, ["person_id"])


@query(f"""SELECT 'same_content' AS "check", CAST(2 * count(*) FILTER (event_type = 'error' AND value > 90) AS BIGINT) AS violations FROM events""")
def run_difference(spark, sf_dir):
    """Rows in which two runs differ; one run has a few changed values."""
    s = series(spark, sf_dir).select("event_id", "value", "event_type")
    other = s.withColumn("value", F.when((F.col("event_type") == "error") & (F.col("value") > 90), F.col("value") + 1).otherwise(F.col("value")))
    return validation.same_content(s, other)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 49 THEN 'ok' ELSE 'low_quality' END AS quality FROM events")
def props_json_quality(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", k.alias("k"), F.when(k.between(0, 49), "ok").otherwise("low_quality").alias("quality"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS persons, round(avg(value), 6) AS mean, round(stddev_samp(value), 5) AS std, round(median(value), 6) AS median,
    round(avg(CASE WHEN value > 90 THEN 1.0 ELSE 0.0 END), 6) AS saturation_ratio FROM events GROUP BY 1""")
def summary_statistics(spark, sf_dir):
    e, v = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("value")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("persons"), r(F.avg(v)).alias("mean"), r(F.stddev_samp(v), 5).alias("std"), r(F.percentile(v, F.lit(0.5))).alias("median"), r(F.avg((v > 90).cast("double"))).alias("saturation_ratio"))


@query("""SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_extendedprice, l_tax), 6) AS price_tax FROM lineitem""")
def correlation_matrix(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = (("l_quantity", "l_extendedprice", "quantity_price"), ("l_quantity", "l_discount", "quantity_discount"), ("l_extendedprice", "l_tax", "price_tax"))
    return li.agg(*[r(F.corr(a, b)).alias(n) for a, b, n in pairs])


@query(f"""WITH {EV}, w AS (SELECT person_id, t // {D} AS d, median(value) AS m, count(*) AS n FROM ev GROUP BY 1, 2) SELECT person_id, d, stat, round(v, 6) AS v FROM (SELECT person_id, d, unnest(['median', 'count']) AS stat, unnest([m, n::DOUBLE]) AS v FROM w)""")
def long_form_features(spark, sf_dir):
    """The long layout of features: a row for each name."""
    w = series(spark, sf_dir).groupBy("person_id", floor_div(F.col("t"), D).alias("d")).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count(F.lit(1)).cast("double").alias("count"))
    return w.unpivot(["person_id", "d"], ["median", "count"], "stat", "v").withColumn("v", r(F.col("v")))


_FLAG = f"""WITH {EV}, b AS (SELECT person_id, min(t // {H}) AS lo, max(t // {H}) AS hi FROM ev GROUP BY 1), g AS (SELECT person_id, unnest(range(lo, hi + 1)) * {H} AS hour_ns FROM b),
    h AS (SELECT person_id, (t // {H}) * {H} AS hour_ns, avg(value) AS m, count(value) AS n, max(CASE WHEN event_type = 'error' THEN t END) AS last_on, min(CASE WHEN event_type = 'error' THEN t END) AS first_on FROM ev GROUP BY 1, 2),
    j AS (SELECT g.person_id, g.hour_ns, m, coalesce(n, 0) AS n, last_on, first_on FROM g LEFT JOIN h ON g.person_id = h.person_id AND g.hour_ns = h.hour_ns)
    SELECT person_id, hour_ns, round(m, 6) AS value_mean, n AS sample_count, round(least(n, 1) * 1.0, 6) AS coverage_ratio,
      round(avg(m) OVER w, 6) AS trailing_mean, CASE WHEN count(m) OVER w > 1 THEN round(regr_slope(m, (hour_ns - 1704067200000000000) / 3600e9) OVER w, 7) END AS trailing_slope,
      round((hour_ns + {H} - max(last_on) OVER (PARTITION BY person_id ORDER BY hour_ns RANGE UNBOUNDED PRECEDING)) / 1e9, 6) AS since_onset_sec,
      coalesce(min(first_on) OVER (PARTITION BY person_id ORDER BY hour_ns RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - (hour_ns + {H}) <= {24 * H} - 1, false) AS onset_within_24h
    FROM j WINDOW w AS (PARTITION BY person_id ORDER BY hour_ns RANGE BETWEEN {24 * H - 1} PRECEDING AND CURRENT ROW)"""


@query(_FLAG)
def hourly_timeline(spark, sf_dir):
    """Flagship: hourly grid, coverage, trailing day, time since the last target and forecast of the next.

    Only hours with events are moved: each of them knows the next one, the targets on either side and the means of its
    trailing day, and then stands for the empty hours up to the next one as well.
    """
    s = series(spark, sf_dir)
    on = F.when(F.col("event_type") == "error", F.col("t"))
    one, day = F.lit(H).cast("long"), F.lit(24 * H).cast("long")
    h = s.groupBy("person_id", (floor_div(F.col("t"), H) * one).alias("hour_ns")).agg(F.avg("value").alias("m"), F.count("value").alias("n"), F.max(on).alias("last_on"), F.min(on).alias("first_on"))
    # an hour's own onsets are past at its end; the forecast looks at the hours after it
    found = windows.nearest(h.withColumn("next_ns", F.col("hour_ns")), ["person_id"], "hour_ns", ["last_on"], ["first_on", "next_ns"], BLOCK)
    x = (F.col("hour_ns") - F.lit(1_704_067_200 * SECOND).cast("long")) / F.lit(3600e9)
    pair = F.when(F.col("m").isNotNull(), F.struct(x.alias("x"), F.col("m").alias("y"), F.col("hour_ns").alias("at")))
    rolled = windows.trailing(found, ["person_id"], "hour_ns", 24 * H, {"past": lambda w: F.collect_list(pair).over(w)}, tasks=windows.tasks_of(spark))  # at most 24
    hours = rolled.withColumn("_hour", F.explode(F.sequence("hour_ns", F.coalesce(F.col("next_ns") - one, F.col("hour_ns")), one)))
    there, end = F.col("_hour") == F.col("hour_ns"), F.col("_hour") + one
    day_of = windows.moments(F.filter("past", lambda p: p["at"] > F.col("_hour") - day))
    full = hours.select("person_id", "_hour", F.when(there, F.col("m")).alias("m"), F.when(there, F.col("n")).otherwise(0).alias("n"), "last_on", "first_on", day_of.alias("day"))
    return full.select(
        "person_id", F.col("_hour").alias("hour_ns"), r(F.col("m")).alias("value_mean"), F.col("n").alias("sample_count"), r(F.least(F.col("n"), F.lit(1)) * 1.0).alias("coverage_ratio"), r(F.col("day.mean")).alias("trailing_mean"),
        F.when(F.col("day.n") > 1, r(F.col("day.slope"), 7)).alias("trailing_slope"), r((end - F.col("last_on")) / F.lit(1e9)).alias("since_onset_sec"), F.coalesce(F.col("first_on") - end <= 24 * H - 1, F.lit(False)).alias("onset_within_24h"),
    )


_DELAY = "(CAST(('0x' || substr(sha256('delay|' || event_id), 1, 13)) AS BIGINT) % 7200000) * 1000000"


@query(f"""WITH {EV}, p AS (SELECT person_id, event_id AS packet_id, t AS time_ns, t + {_DELAY} AS arrival_ns FROM ev)
    SELECT person_id, packet_id, time_ns, row_number() OVER (PARTITION BY person_id ORDER BY time_ns, packet_id) AS place,
      coalesce(max(time_ns) OVER (PARTITION BY person_id ORDER BY arrival_ns, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > time_ns, false) AS overtaken FROM p""")
def reordered_packets(spark, sf_dir):
    """Events that arrive up to two hours late, put back in order by a stateful stream."""
    from pulsegrid.streaming import reorder

    delay = F.conv(F.substring(F.sha2(F.concat(F.lit("delay|"), F.col("event_id").cast("string")), 256), 1, 13), 16, 10).cast("long") % 7_200_000 * 1_000_000
    packets = series(spark, sf_dir).select("person_id", F.col("event_id").alias("packet_id"), F.col("t").alias("time_ns"), (F.col("t") + delay).alias("arrival_ns"))
    path = windows.fresh_path(spark, "packets")
    batches = max(6, -(-packets.count() // reorder.BATCH_ROWS))
    reorder.arrive(packets, f"{path}/in", "person_id", batches)
    late = reorder.run(spark, f"{path}/in", packets.schema, f"{path}/out", "person_id", "3 hours")
    if late:
        raise RuntimeError(f"{late} packets came later than the watermark allows")
    return spark.read.parquet(f"{path}/out").filter("packet_id >= 0")


@query("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, count(value) AS sample_count, round(avg(value), 6) AS value_mean FROM events GROUP BY 1, 2")
def streaming_hourly(spark, sf_dir):
    """The streaming form of the hourly resampling, run here as a batch (a test runs it as a stream)."""
    from pulsegrid.streaming.incremental import hourly

    out = hourly(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return out.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "sample_count", r(F.col("value_mean")).alias("value_mean"))


@query(f"""WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events), k AS (SELECT *, sum(CASE WHEN d IS NULL OR d >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n_events FROM k GROUP BY user_id, s""")
def streaming_sessions(spark, sf_dir):
    """Sessions by Spark's session window, as the streaming query has them."""
    from pulsegrid.streaming.incremental import activity_sessions

    out = activity_sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "12 hours")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n_events")


@query(f"""WITH {EV}, d AS (SELECT person_id, t // {D} AS d, count(*) AS n, sum(value) AS s FROM ev GROUP BY 1, 2), p AS (SELECT person_id, min(d) AS lo, max(d) AS hi FROM d GROUP BY 1),
    g AS (SELECT person_id, unnest(range(lo, hi + 1)) AS d FROM p)
    SELECT g.person_id, g.d AS day_no, coalesce(n, 0) AS sample_count, round(least(coalesce(n, 0) / 3.0, 1), 6) AS coverage_ratio, CASE WHEN coalesce(n, 0) / 3.0 >= 0.8 THEN round(s / n, 6) END AS gated_mean, coalesce(n, 0) / 3.0 >= 0.8 AS feature_valid
    FROM g LEFT JOIN d ON d.person_id = g.person_id AND d.d = g.d""")
def coverage_gating(spark, sf_dir):
    """A feature is null, not 0, where coverage of its day is short; rows survive."""
    s = series(spark, sf_dir).groupBy("person_id", floor_div(F.col("t"), D).alias("day_no")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    lim = s.groupBy("person_id").agg(F.min("day_no").alias("lo"), F.max("day_no").alias("hi"))
    g = lim.select("person_id", F.explode(F.sequence("lo", "hi")).alias("day_no")).join(s, ["person_id", "day_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    c = F.col("n") / F.lit(3.0)
    return g.select("person_id", "day_no", F.col("n").alias("sample_count"), r(F.least(c, F.lit(1.0))).alias("coverage_ratio"), F.when(c >= 0.8, r(F.col("m"))).alias("gated_mean"), (c >= 0.8).alias("feature_valid"))


@query(f"""WITH {EV}, x AS (SELECT user_id AS person_id, unnest([0, 1, 2]) AS kind FROM (SELECT DISTINCT user_id FROM events)),
    c AS (SELECT person_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS kind, count(*) AS n FROM ev GROUP BY 1, 2)
    SELECT x.person_id, x.kind AS stream_no, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AS missing FROM x LEFT JOIN c ON c.person_id = x.person_id AND c.kind = x.kind""")
def stream_sample_counts(spark, sf_dir):
    """Samples of each person and stream, streams without any included."""
    s = series(spark, sf_dir)
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    n = s.groupBy("person_id", kind.alias("stream_no")).agg(F.count(F.lit(1)).alias("n"))
    all_ = s.select("person_id").distinct().select("person_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("stream_no"))
    return all_.join(n, ["person_id", "stream_no"], "left").select("person_id", "stream_no", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) == 0).alias("missing"))


_FEATURES = """f AS (SELECT user_id AS person_id, event_type = 'error' AS y, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, hour(ts) AS h FROM events)"""


@query(f"""WITH {_FEATURES}, u AS (SELECT y, unnest(['value', 'k', 'h']) AS feature, unnest([value, k, h::DOUBLE]) AS v FROM f),
    r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk FROM u),
    a AS (SELECT feature, CAST(count(*) FILTER (y) AS BIGINT) AS positives, CAST(count(*) FILTER (NOT y) AS BIGINT) AS negatives, sum(rk) FILTER (y) AS s FROM r GROUP BY 1)
    SELECT feature, positives, negatives, round((s - positives * (positives + 1) / 2.0) / (positives * negatives), 6) AS auc FROM a""")
def single_feature_auc(spark, sf_dir):
    """No single feature, person or time of day may tell targets apart."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    f = e.select((F.col("event_type") == "error").alias("y"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.hour("ts").cast("double").alias("h"))
    return sanity.feature_aucs(f, ["value", "k", "h"], "y").withColumn("auc", r(F.col("auc")))


@query("SELECT user_id AS person_id, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS share FROM events GROUP BY 1")
def label_share_by_person(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("person_id"), (F.col("event_type") == "error").alias("y"))
    return sanity.key_entropy(e, "person_id", "y").withColumn("share", r(F.col("share")))


@query()
def sanity_models(spark, sf_dir):
    """AUC of a logistic, a forest and an isolation model on held-out persons; near one half, as the label is random here."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    f = e.select("user_id", (F.col("event_type") == "error").alias("y"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    f = windows.written(f)  # models read it many times
    train, test = f.filter(F.xxhash64("user_id") % 3 != 0), f.filter(F.xxhash64("user_id") % 3 == 0)
    rows = [sanity.model_auc(train, test, ["value", "k"], "y", kind).withColumn("model", F.lit(kind)) for kind in ("logistic", "forest", "isolation")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def golden_timeline(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Native streams of the whole golden run as aligned to the grid, and its 1 Hz timeline."""
    c, _, latent, people, days, faults = golden_truth(spark)
    rows = devices.native(latent, people, faults, None, c, days)
    rows = windows.written(devices.on_grid(devices.aligned(rows, latent, devices.clock_models(spark, c), c)))
    return rows, windows.written(run.observed_timeline(rows, latent, c))


@query()
def timeline_1hz(spark, sf_dir):
    """The 1 Hz timeline of the golden run; raw EEG as digests."""
    one = golden_timeline(spark)[1]
    return one.withColumns({f"eeg_{c}": F.sha2(F.to_json(f"eeg_{c}"), 256) for c in features.CHANNELS})


@query()
def window_features(spark, sf_dir):
    """All window features of the golden run, over a minute."""
    return features.window_features(run.slim(golden_timeline(spark)[1]), 60)


@query()
def eeg_window_features(spark, sf_dir):
    return features.eeg_features(golden_timeline(spark)[1], 5, stride=1)


@query()
def motion_spectra(spark, sf_dir):
    return features.motion_spectra(golden_timeline(spark)[0], 5, 1)


def _weighted_median(rows: str, v: str) -> str:
    """Per event: the least value up to which at least half of the weight lies."""
    return f"""SELECT id, min({v}) AS m FROM (SELECT id, {v}, sum(w) OVER (PARTITION BY id ORDER BY {v}, w) AS upto, sum(w) OVER (PARTITION BY id) AS whole FROM {rows}) WHERE upto >= whole / 2 GROUP BY id"""


@query(f"""WITH {EV}, p AS (SELECT a.event_id AS id, b.value::DOUBLE AS v, pow(0.5, (a.t - b.t) / {float(3 * DAY)}) AS w FROM ev a JOIN ev b ON a.person_id = b.person_id AND b.t < a.t AND b.t >= a.t - {10 * DAY} WHERE b.value IS NOT NULL),
    m AS ({_weighted_median('p', 'v')}), q AS (SELECT p.id, abs(v - m) AS g, w FROM p JOIN m ON m.id = p.id), d AS (SELECT id, m AS mad FROM ({_weighted_median('q', 'g')}))
    SELECT event_id, round(m.m, 6) AS ew_median, round(mad, 6) AS ew_mad FROM ev LEFT JOIN m ON m.id = event_id LEFT JOIN d ON d.id = event_id""")
def exponential_baseline(spark, sf_dir):
    """Exponentially weighted median and MAD of the last ten days, the present left out."""
    out = windows.exponential_robust(series(spark, sf_dir).select("event_id", "person_id", "t", "value"), ["person_id"], "t", "value", 3 * DAY, 10 * DAY, BLOCK)
    return out.select("event_id", r(F.col("ew_median")).alias("ew_median"), r(F.col("ew_mad")).alias("ew_mad"))


CHANGED = "event_type = 'error' AND value > 90 AND person_id % 4 = 1 AND {0} % 10 = 3"


@query(f"""WITH {EV}, e AS (SELECT event_id, person_id, t, t // {D} AS day, person_id % 4 AS shard, CASE WHEN {CHANGED.format(f't // {D}')} THEN value + 1 ELSE value END AS value FROM ev),
    c AS (SELECT DISTINCT person_id % 4 AS shard, t // {D} AS day FROM ev WHERE {CHANGED.format(f't // {D}')}),
    reached AS (SELECT DISTINCT shard, day + k AS day FROM c, (SELECT unnest([0, 1, 2]) AS k))
    SELECT e.event_id, CAST(e.shard AS INTEGER) AS shard, e.day, count(e.value) OVER w AS n, round(avg(e.value) OVER w, 6) AS mean, reached.day IS NOT NULL AS remade
    FROM e LEFT JOIN reached ON reached.shard = e.shard AND reached.day = e.day WINDOW w AS (PARTITION BY person_id ORDER BY t RANGE BETWEEN {48 * H - 1} PRECEDING AND CURRENT ROW)""")
def incremental_update(spark, sf_dir):
    """A derived table of two-day means made once, and brought up to a source of which some days have changed."""
    day = floor_div(F.col("t"), D)
    s = series(spark, sf_dir).withColumns({"day": day, "shard": F.expr("CAST(person_id % 4 AS INT)")})
    before = s.select("event_id", "person_id", "t", "value", "shard", "day")
    now = s.withColumn("value", F.when(F.expr(CHANGED.format("day")), F.col("value") + 1).otherwise(F.col("value"))).select(before.columns)
    home = windows.fresh_path(spark, "derived")

    def make(df):
        v = F.col("value")
        out = windows.trailing(df, ["person_id"], "t", 48 * H, {"n": lambda w: F.count(v).over(w), "mean": lambda w: F.avg(v).over(w)}, BLOCK)
        return out.select("event_id", "n", "mean", "shard", "day")

    derived.update(before, make, home, "two_day_means", ["shard"], "day", 2)
    remade = derived.update(now, make, home, "two_day_means", ["shard"], "day", 2).withColumn("remade", F.lit(True))
    out = spark.read.parquet(f"{home}/two_day_means").withColumn("day", F.col("day").cast("long")).join(tables.broadcast_if_small(remade, 100_000), ["shard", "day"], "left")
    return out.select("event_id", "shard", "day", "n", r(F.col("mean")).alias("mean"), F.coalesce("remade", F.lit(False)).alias("remade"))


def _least_half(rows: str, c: str) -> str:
    """Per event: the least cell up to which half of the weight lies, less what sums are off by."""
    return f"""SELECT id, min({c}) AS m FROM (SELECT id, {c}, sum(w) OVER (PARTITION BY id ORDER BY {c}) AS upto, sum(w) OVER (PARTITION BY id) AS whole
        FROM (SELECT id, {c}, sum(w) AS w FROM {rows} GROUP BY 1, 2)) WHERE upto >= whole * {decayed.HALF!r} GROUP BY id"""


@query(f"""WITH {EV}, p AS (SELECT a.event_id AS id, CAST(floor(b.value / 0.5 + 0.5) AS BIGINT) AS c, pow(2.0, (b.t - a.t) / {float(3 * DAY)}) AS w
      FROM ev a JOIN ev b ON a.person_id = b.person_id AND b.t < a.t WHERE b.value IS NOT NULL),
    m AS ({_least_half('p', 'c')}), q AS (SELECT p.id, abs(c - m) AS g, w FROM p JOIN m ON m.id = p.id), d AS ({_least_half('q', 'g')})
    SELECT event_id, round(m.m * 0.5, 6) AS ew_median, round(d.m * 0.5, 6) AS ew_mad FROM ev LEFT JOIN m ON m.id = event_id LEFT JOIN d ON d.id = event_id""")
def decayed_baseline(spark, sf_dir):
    """Decayed median and MAD of all earlier values, from merged sketches with cells of half a unit."""
    out = decayed.decayed_median_mad(series(spark, sf_dir).select("event_id", "person_id", "t", "value"), ["person_id"], "t", "value", 3 * DAY, 0.5, BLOCK)
    return out.select("event_id", r(F.col("ew_median")).alias("ew_median"), r(F.col("ew_mad")).alias("ew_mad"))


@query(f"""WITH d AS (SELECT user_id AS person_id, avg(CASE WHEN value > 75 THEN 1.0 ELSE 0.0 END) AS a FROM events GROUP BY 1), q AS (SELECT quantile_cont(a, 0.75) AS lim FROM d)
    SELECT person_id, round(a, 6) AS artifact_share, a >= lim AS stress FROM d, q""")
def artifact_stress_split(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("person_id"), (F.col("value") > 75).alias("artifact_present"))
    return splits.artifact_stress(e, ["person_id"]).withColumn("artifact_share", r(F.col("artifact_share")))


_PERSON_SPLIT = f"""ks AS (SELECT person_id, row_number() OVER (ORDER BY sha256('{MVP.splits.seed}/split/' || person_id), person_id) AS rn FROM pp), sx AS (SELECT person_id, CASE WHEN rn <= 8 THEN 'train' WHEN rn <= 10 THEN 'validation' ELSE 'test' END AS split FROM ks)"""


@query(f"""WITH {_people(MVP)}, {_events_sql(MVP)}, {_PERSON_SPLIT} SELECT split, te.person_id, event_type, count(*) AS n, round(avg(CAST(intensity_truth AS DOUBLE)), 5) AS intensity_mean FROM te JOIN sx ON sx.person_id = te.person_id GROUP BY ROLLUP (split, te.person_id, event_type)""")
def run_counts(spark, sf_dir):
    """Events by split, person and type, with totals at each level."""
    split = splits.by_person(truth.persons(spark, MVP).select("person_id"), MVP.splits.seed, MVP.splits.fractions)
    return run.counts(windows.written(truth.events(spark, MVP)), split).withColumn("intensity_mean", r(F.col("intensity_mean"), 5))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 5) AS value_std FROM events GROUP BY 1")
def run_statistics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return run.statistics(e, ("value",), ["event_type"]).withColumns({"value_mean": r(F.col("value_mean")), "value_std": r(F.col("value_std"), 5)})


@query(f"""WITH {EV} SELECT event_id, CAST((t // {DAY} + CAST(('0x' || substr(sha256(CAST(person_id AS VARCHAR)), 1, 8)) AS BIGINT) % 2) % 2 AS INTEGER) AS fold FROM ev""")
def cross_day_fold(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.select("event_id", splits.cross_day(floor_div(F.col("t"), DAY), F.col("person_id")).alias("fold"))


@query("""WITH f AS (SELECT user_id AS k, event_type = 'error' AS y FROM events), s AS (SELECT y, avg(CAST(y AS DOUBLE)) OVER (PARTITION BY k) AS p, count(*) OVER (PARTITION BY k) AS n FROM f),
    q AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s WHERE n > 1)
    SELECT CAST(count(*) FILTER (y) AS BIGINT) AS positives, CAST(count(*) FILTER (NOT y) AS BIGINT) AS negatives, round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 5) AS auc FROM q""")
def key_auc(spark, sf_dir):
    """How well the person alone tells targets apart."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("event_type") == "error").alias("y"))
    return sanity.key_auc(e, "user_id", "y").withColumn("auc", r(F.col("auc"), 5))
