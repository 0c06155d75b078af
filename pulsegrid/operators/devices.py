"""Observed streams: ideal signals, artifacts, clocks and packets, and their way back to the 1 Hz grid.

A row of ``native`` is one second of one stream: its samples lie in arrays, one for each channel.  A second is made
from its own row alone - latent factors, the person's constants, where the heart stands, and the artifacts that hold
it - so clips and chunks are only choices of seconds: a clip is the slice of the whole recording.  Beats are counted
in Spark from the person's start, in whole millionths of a beat, so that no sum depends on the order of its terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import arrays, seeds, spectral
from pulsegrid.functions.timecols import DAY, HOUR, SECOND, floor_div
from pulsegrid.operators.intervals import during
from pulsegrid.operators.labels import by_second
from pulsegrid.operators.truth import persons
from pulsegrid.operators.windows import lagged, tasks_of, trailing
from pulsegrid.sources.config import RunConfig
from pulsegrid.sources.tables import broadcast_if_small

NATIVE_SCHEMA = (
    "run_id string, person_id string, clip_id string, device_id string, stream_name string, second_ns long, sample_rate_hz int, "
    "channels map<string,array<float>>, quality_native float, missing_kind string"
)
#: Kinds of artifact by stream, usual number an hour, least and greatest length in seconds.
ARTIFACTS = {
    "eeg": (("blink", 600, 1, 1), ("jaw_emg", 4.8, 2, 8), ("head_motion", 2, 3, 20), ("electrode_pop", 0.2, 1, 2), ("impedance_drift", 0.2, 60, 300), ("channel_dropout", 0.05, 30, 300),
            ("common_mode", 0.1, 5, 60), ("mains", 0.2, 30, 300), ("clipping", 0.1, 1, 5), ("flatline", 0.05, 5, 60)),
    "ecg": (("baseline_wander", 0.5, 20, 120), ("motion", 2.4, 3, 20), ("contact_loss", 0.1, 5, 60), ("missed_peak", 1, 1, 1), ("extra_peak", 0.5, 1, 1), ("ectopic_like", 0.2, 1, 1), ("gap", 0.05, 5, 30)),
    "ppg": (("motion_coupling", 3, 5, 60), ("amplitude_modulation", 0.5, 20, 120), ("contact_loss", 0.05, 5, 60), ("ambient_leak", 0.2, 10, 60), ("saturation", 0.1, 2, 20), ("block_drop", 0.1, 5, 60)),
    "eda": (("drift", 0.2, 60, 600), ("sparse_scr", 0.5, 5, 20), ("motion_spike", 1.8, 1, 3), ("contact_loss", 0.05, 5, 60), ("dry_skin", 0.05, 60, 600), ("flatline", 0.02, 30, 300), ("quantisation", 0.1, 60, 600)),
    "acc": (("bias", 0.1, 60, 600), ("scale", 0.1, 60, 600), ("rotation", 0.1, 60, 600), ("gravity_leak", 0.1, 30, 300), ("clipping", 0.005, 1, 5), ("jitter", 0.2, 10, 60), ("loss", 0.1, 5, 60)),
}
#: What goes missing, the more severe later: single samples, packets, a channel, all of a stream.
DROPS = {"random_missing": "random", "loss": "packet", "channel_dropout": "channel", "contact_loss": "block", "gap": "block", "block_drop": "block", "block_dropout": "block"}
MISSING = ("random", "packet", "channel", "block")
#: Samples in a packet, mean delay of a packet in ms, share of packets that are held up, and for how long.
PACKET, DELAY_MS, HELD_SHARE, HELD_MS = 12, 35.0, 0.01, 250.0
#: Fixed value: seconds between two comparisons of a device's clock with the grid.
SYNC_SEC = 60
#: Seconds whose samples a Python worker makes at once.
ROWS_AT_ONCE = 256
EEG_CHANNELS = ("tp9", "af7", "af8", "tp10")


def clock_models(spark: SparkSession, config: RunConfig) -> DataFrame:
    """(run_id, person_id, device_id, initial_offset_ms, drift_ppm, jitter_ms_std, seed)"""
    base = persons(spark, config)
    out = None
    for device, c in config.clocks.items():
        seed = seeds.child_seed(config.run.seed, "person", F.col("person_id"), "clock", device)
        rows = base.select("run_id", "person_id", F.lit(device).alias("device_id"), seed.alias("seed")).select(
            "run_id", "person_id", "device_id", seeds.uniform_range(F.col("seed"), "offset", c.offset_ms.min, c.offset_ms.max).alias("initial_offset_ms"),
            seeds.uniform_range(F.col("seed"), "drift", c.drift_ppm.min, c.drift_ppm.max).alias("drift_ppm"), F.lit(float(c.jitter_ms_std)).alias("jitter_ms_std"), "seed",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def device_time(truth_ns, start_ns, offset_ms, drift_ppm, jitter_ms):
    """Truth + initial offset + drift x elapsed + jitter, in whole nanoseconds."""
    drift = (truth_ns - start_ns).cast("double") * drift_ppm / F.lit(1e6)
    return truth_ns + F.round(offset_ms * 1e6 + drift + jitter_ms * 1e6).cast("long")


def artifact_kinds(config: RunConfig) -> list[tuple[str, str, float, int, int]]:
    """(stream, kind, number an hour, least and greatest length), the configuration's rates over the usual ones."""
    own = config.artifacts.rates_per_hour
    usual = [(stream, kind, float(own.get(stream, {}).get(kind, rate)), low, high) for stream, rows in ARTIFACTS.items() for kind, rate, low, high in rows]
    return usual + [(stream, "random_missing", config.artifacts.random_missing_probability_per_hour, 5, 60) for stream in ARTIFACTS]


def artifacts(spark: SparkSession, config: RunConfig, timeline: DataFrame | None = None, schedule: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Truth manifest of artifacts, made before any is applied.

    Each kind may begin in each minute with a probability that its rate gives; motion at that time raises the chance
    where ``timeline`` is there, and a day on which sensors are poorly borne where ``days`` are.  Blocks of all
    streams of a device drop out some times a day.  Artifact-only events of ``schedule`` disturb three streams for as
    long as they last.
    """
    out_columns = ["run_id", "person_id", "artifact_id", "device_id", "stream_name", "channel", "artifact_type", "start_time_ns", "end_time_ns", "severity", "seed"]
    table = spark.createDataFrame(artifact_kinds(config), "stream_name string, artifact_type string, rate double, low int, high int")
    slot = 60  # seconds
    slots = -(-config.run.duration_sec // slot)
    start_ns, second = F.lit(config.run.start_ns).cast("long"), F.lit(SECOND).cast("long")
    who = persons(spark, config)
    grid = who.select("run_id", "person_id", "seed", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    if timeline is not None:
        motion = timeline.groupBy("person_id", floor_div(F.col("seconds_from_start"), slot).cast("int").alias("slot")).agg(F.avg("motor_activation").alias("motor"))
        grid = grid.join(motion, ["person_id", "slot"], "left")
    if days is not None:
        worn = days.select("person_id", F.col("day_index").cast("int").alias("_day"), F.col("sensor_tolerance_truth").cast("double").alias("tolerance"))
        grid = grid.withColumn("_day", floor_div(F.col("slot"), 1440).cast("int")).join(broadcast_if_small(worn, 100_000), ["person_id", "_day"], "left")
    base = grid.crossJoin(F.broadcast(table))  # 42 kinds
    u = seeds.uniform(F.col("seed"), F.concat_ws("/", F.lit("artifact"), "stream_name", "artifact_type", F.col("slot").cast("string")))
    chance = F.col("rate") * slot / 3600
    if timeline is not None:
        chance = chance * (F.lit(0.5) + F.lit(config.artifacts.motion_coupling) * F.coalesce("motor", F.lit(0.25)))
    if days is not None:
        chance = chance * F.exp(-2 * F.coalesce("tolerance", F.lit(0.0)))
    hit = base.filter(F.lit(config.artifacts.enabled) & (u < F.least(chance, F.lit(0.95))))
    name = F.concat_ws("/", F.lit("artifact"), "stream_name", "artifact_type", F.col("slot").cast("string"), F.lit("is"))
    hit = hit.withColumn("aseed", seeds.child_seed(F.col("seed"), name))
    of = lambda n: seeds.uniform(F.col("aseed"), n)
    begin = start_ns + (F.col("slot") * slot + F.floor(of("at") * slot)).cast("long") * second
    length = (F.col("low") + F.floor(of("for") * (F.col("high") - F.col("low") + 1))).cast("long")
    one_of_four = F.element_at(F.array(*[F.lit(c) for c in EEG_CHANNELS]), (F.floor(of("channel") * 4) + 1).cast("int"))
    channel = F.when(F.col("artifact_type").isin("channel_dropout", "electrode_pop", "impedance_drift"), one_of_four)
    severity = (F.lit(0.2) + F.lit(0.8) * of("severity")).cast("float")
    usual = hit.select("run_id", "person_id", F.col("aseed").alias("seed"), "stream_name", channel.alias("channel"), "artifact_type", begin.alias("start_time_ns"), (begin + length * second).alias("end_time_ns"), severity.alias("severity"))
    # blocks of a device: all its streams at once
    n_days = -(-config.run.duration_sec // 86_400)
    r = config.artifacts.block_dropouts_per_day
    day = who.select("run_id", "person_id", "seed", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))).alias("day"))
    day = day.select("*", F.explode(F.array(*[F.lit(d) for d in DEVICE_FAMILIES])).alias("device"))
    day = day.withColumn("dseed", seeds.child_seed(F.col("seed"), "dropout", F.col("device"), F.col("day")))
    n = seeds.discrete_uniform(F.col("dseed"), "n", int(r.min), int(r.max))
    each = day.filter(F.lit(config.artifacts.enabled) & (n > 0)).select("*", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("k")).withColumn("aseed", seeds.child_seed(F.col("dseed"), F.col("k")))
    drop_at = start_ns + F.col("day").cast("long") * F.lit(DAY).cast("long") + seeds.discrete_uniform(F.col("aseed"), "at", 0, 86_399) * second
    families = F.element_at(F.create_map(*[x for d, f in DEVICE_FAMILIES.items() for x in (F.lit(d), F.array(*[F.lit(y) for y in f]))]), F.col("device"))
    blocks = each.select("run_id", "person_id", F.col("aseed").alias("seed"), F.explode(families).alias("stream_name"), F.lit(None).cast("string").alias("channel"), F.lit("block_dropout").alias("artifact_type"),
                         drop_at.alias("start_time_ns"), (drop_at + seeds.discrete_uniform(F.col("aseed"), "for", 30, 300) * second).alias("end_time_ns"), F.lit(1.0).cast("float").alias("severity"))
    out = usual.unionByName(blocks.filter(F.col("start_time_ns") < start_ns + F.lit(config.run.duration_sec).cast("long") * second))
    if schedule is not None:
        streams = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("k")) for s, k in EPISODE]))
        only = schedule.filter("is_artifact_only_schedule").select("run_id", "person_id", "start_time_ns", "end_time_ns", F.col("intensity_truth"), "seed", streams.alias("x"))
        out = out.unionByName(only.select("run_id", "person_id", seeds.child_seed(F.col("seed"), F.col("x.s")).alias("seed"), F.col("x.s").alias("stream_name"), F.lit(None).cast("string").alias("channel"), F.col("x.k").alias("artifact_type"),
                                          "start_time_ns", "end_time_ns", (F.lit(0.5) + F.lit(0.5) * F.col("intensity_truth")).cast("float").alias("severity")))
    device = F.when(F.col("stream_name") == "eeg", "headband").when(F.col("stream_name") == "ecg", "strap").otherwise("watch")
    ident = F.concat(F.lit("ar_"), F.lpad(F.lower(F.hex("seed")), 15, "0"), F.lit("_"), "stream_name")
    return out.withColumns({"artifact_id": ident, "device_id": device}).select(*out_columns)


#: Families of streams of a device, and what an artifact-only episode does to which.
DEVICE_FAMILIES = {"headband": ("eeg",), "strap": ("ecg",), "watch": ("ppg", "eda", "acc")}
EPISODE = (("eeg", "head_motion"), ("ppg", "motion_coupling"), ("eda", "motion_spike"), ("ecg", "motion"))


def heart(timeline: DataFrame, people: DataFrame) -> DataFrame:
    """(keys, truth_time_ns, beat_micro, rate_micro, last_beat_ns, rr_ms): where the heart stands in each second.

    ``beat_micro`` is the number of beats since the person's start, in millionths; beats fall on whole numbers.
    ``last_beat_ns`` and ``rr_ms`` are the last beat of the second (or before) and the interval that it ends.
    """
    keys, t = ["run_id", "person_id"], "truth_time_ns"
    person = people.select(*keys, F.col("seed").alias("_seed"), F.col("resting_hr_bpm_truth").cast("double").alias("_hr"), F.col("rmssd_ms_truth").cast("double").alias("_rmssd"))
    x = timeline.select(*keys, t, "autonomic_arousal", "motor_activation").join(broadcast_if_small(person, 100_000), keys)
    hz = F.col("_hr") * (F.lit(0.85) + F.lit(0.45) * F.col("autonomic_arousal") + F.lit(0.3) * F.col("motor_activation")) / 60
    z = F.least(F.greatest(seeds.fast_normal(F.xxhash64("_seed", F.lit("rr")), floor_div(F.col(t), SECOND)), F.lit(-2.5)), F.lit(2.5))
    swing = F.least(F.col("_rmssd") / 1000 * hz * 0.7 * (F.lit(1.2) - F.col("autonomic_arousal")), F.lit(0.15)) * z
    x = x.select(*keys, t, F.greatest(F.round(hz * (1 - swing) * 1_000_000), F.lit(400_000)).cast("long").alias("rate_micro"), floor_div(F.col(t), HOUR).alias("_block"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each hour
    before = x.groupBy(*keys, "_block").agg(F.sum("rate_micro").alias("_n")).select(*keys, "_block", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    local = x.withColumn("_local", F.coalesce(F.sum("rate_micro").over(within), F.lit(0)))
    stand = local.join(before, [*keys, "_block"]).select(*keys, t, (F.col("_before") + F.col("_local")).alias("beat_micro"), "rate_micro")
    # the two last beats lie within eight seconds at 24 beats a minute and more
    recent = trailing(stand, keys, t, 8 * SECOND, {"_recent": lambda w: F.collect_list(F.struct(F.col(t).alias("t"), F.col("beat_micro").alias("b"), F.col("rate_micro").alias("r"))).over(w)}, HOUR)

    def time_of(number: Column) -> Column:
        holds = F.filter("_recent", lambda e: (e["b"] <= number) & (number < e["b"] + e["r"]))
        return F.try_element_at(F.transform(holds, lambda e: e["t"] + F.round((number - e["b"]).cast("double") / e["r"] * F.lit(1e9)).cast("long")), F.lit(1))

    million = F.lit(1_000_000).cast("long")
    last = floor_div(F.col("beat_micro") + F.col("rate_micro") - 1, 1_000_000) * million
    timed = recent.withColumns({"_last": last}).select("*", time_of(F.col("_last")).alias("last_beat_ns"), time_of(F.col("_last") - million).alias("_prev"))
    return timed.select(*keys, t, "beat_micro", "rate_micro", "last_beat_ns", ((F.col("last_beat_ns") - F.col("_prev")) / F.lit(1e6)).alias("rr_ms"))


def _hashed(key: int, second: np.ndarray, salt: int, n: int) -> np.ndarray:
    """Uniform in [0, 1), n for each second: the mix of a counter, so a value depends on its key, second and place alone."""
    with np.errstate(over="ignore"):
        z = (second.astype(np.uint64)[:, None] * np.uint64(1 << 12) + np.arange(n, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0x632BE59BD9B4E019 + salt * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


def _normal(key: int, second: np.ndarray, salt: int, n: int) -> np.ndarray:
    u, v = _hashed(key, second, 2 * salt, n), _hashed(key, second, 2 * salt + 1, n)
    return np.sqrt(-2 * np.log1p(-u * (1 - 1e-16))) * np.cos(2 * np.pi * v)


def _bump(phase: np.ndarray, at: float, width: float, height: float) -> np.ndarray:
    """A Gaussian bump at a place of the cardiac cycle; R peaks stand at 0."""
    return height * np.exp(-(((phase - at + 0.5) % 1 - 0.5) ** 2) / (2 * width**2))


class Seconds:
    """Some seconds of one person as arrays, and the ideal signals of each stream as (seconds, samples)."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.second = columns["truth_time_ns"] // SECOND
        self.col = {k: v.astype(float)[:, None] for k, v in columns.items() if k not in ("truth_time_ns", "seed", "beat_micro")}
        self.beat = (columns["beat_micro"] % 1_000_000_000).astype(float)[:, None] / 1e6
        self.key = int(columns["seed"][0])
        u = _hashed(self.key, np.arange(8), 1, 40)
        self.phases = 2 * np.pi * u
        self.worn = 1 + np.maximum(-3 * self.col["sensor_tolerance_truth"], 0)  # a poorly borne sensor is noisier

    def time(self, rate: int) -> np.ndarray:
        return (self.second % 86_400)[:, None] + np.arange(rate) / rate

    def noise(self, salt: int, n: int) -> np.ndarray:
        return _normal(self.key, self.second, salt, n)

    def placed(self, device: str) -> float:
        """What a device makes of a signal on this person: its gain, some per cent off 1."""
        return 1 + 0.06 * (self.phases[0, len(device)] / (2 * np.pi) - 0.5)

    def cycle(self, rate: int, delay: float = 0.0) -> np.ndarray:
        hz = self.col["rate_micro"] / 1e6
        return self.beat + hz * (np.arange(rate) / rate - delay)

    def eeg(self, rate: int) -> dict[str, np.ndarray]:
        """1/f background, rhythms that follow load and arousal, and bursts of alpha."""
        t, load, arousal, out = self.time(rate), self.col["cognitive_load"], self.col["autonomic_arousal"], {}
        f = np.geomspace(0.7, 60, 24)
        exponent, alpha, gamma = (float(self.col[c][0, 0]) for c in ("eeg_aperiodic_exponent_truth", "eeg_relative_alpha_truth", "eeg_relative_gamma_truth"))
        for k, name in enumerate(EEG_CHANNELS):
            phase = self.phases
            x = 6 * sum(f[j] ** (-exponent / 2) * np.sin(2 * np.pi * f[j] * t + phase[k, j]) for j in range(len(f)))
            burst = 1 + 0.8 * np.maximum(np.sin(2 * np.pi * 0.11 * t + phase[4, k]), 0) ** 8
            x = x + 30 * alpha * burst * (1 - 0.5 * load) * np.sin(2 * np.pi * 10 * t + phase[4, k]) + 12 * (0.3 + load) * np.sin(2 * np.pi * 6 * t + phase[5, k])
            x = x + 8 * (0.3 + arousal) * np.sin(2 * np.pi * 20 * t + phase[6, k]) + 20 * gamma * np.sin(2 * np.pi * 37 * t + phase[7, k])
            out[name] = x + 2 * self.worn * self.noise(10 + k, rate)
        return out

    def ecg(self, rate: int) -> dict[str, np.ndarray]:
        p = self.cycle(rate)
        x = _bump(p, -0.18, 0.02, 120) + _bump(p, -0.02, 0.008, -100) + _bump(p, 0.0, 0.012, 1000) + _bump(p, 0.02, 0.008, -180) + _bump(p, 0.24, 0.04, 220)
        return {"ecg": x + 8 * self.worn * self.noise(20, rate)}

    def ppg(self, rate: int) -> dict[str, np.ndarray]:
        """Pulses some 0.3 s behind the beat, stronger in some colours than in others."""
        p = self.cycle(rate, 0.22) % 1
        wave = np.exp(-((p - 0.12) ** 2) / 0.012) + 0.4 * np.exp(-((p - 0.38) ** 2) / 0.01)
        rough = 3 * (1 + 4 * self.col["motor_activation"]) * self.worn
        return {c: 1000 * g + 40 * g * wave + rough * self.noise(30 + n, rate) for n, (c, g) in enumerate((("green", 1.0), ("ir", 1.4), ("red", 1.2)))}

    def acc(self, rate: int, device: str) -> dict[str, np.ndarray]:
        """Gravity under a slow turn, a repeated movement that grows with motor activation, and noise; worn a little askew."""
        t, motor, n = self.time(rate), self.col["motor_activation"], len(device)
        g = np.stack([np.sin(0.01 * t), 0.2 * np.sin(0.007 * t), np.cos(0.01 * t)])
        g /= np.sqrt((g**2).sum(axis=0))
        x = g + (0.02 + 0.5 * motor**2) * np.stack([np.sin(2 * np.pi * 1.8 * t + k) for k in range(3)]) + 0.01 * np.stack([self.noise(40 + 3 * n + k, rate) for k in range(3)])
        a = 0.3 * (self.phases[1, n] / (2 * np.pi) - 0.5)
        return {"x": np.cos(a) * x[0] - np.sin(a) * x[1], "y": np.sin(a) * x[0] + np.cos(a) * x[1], "z": x[2]}

    def eda(self, rate: int) -> dict[str, np.ndarray]:
        """A tonic level and responses that begin at hashed seconds, both by the drive of the skin."""
        drive, scr = self.col["eda_drive"], 0.0
        for back in range(20):
            begun = _hashed(self.key, self.second - back, 50, 1) < 0.035
            scr = scr + begun * (0.3 + _hashed(self.key, self.second - back, 51, 1)) * (1 - np.exp(-back / 1.0)) * np.exp(-back / 5.0)
        x = self.col["eda_tonic_level_us_truth"] * (0.7 + 0.9 * drive) + 1.5 * drive * scr
        return {"eda": np.repeat(x, rate, axis=1) + 0.01 * self.worn * self.noise(52, rate)}

    def interval(self, rate: int, name: str, rough: float, salt: int) -> dict[str, np.ndarray]:
        """Heart rate and the last interval as a device tells them."""
        rr = np.where(np.isfinite(self.col["rr_ms"]), self.col["rr_ms"], 1e9 / self.col["rate_micro"])
        err = rough * self.noise(salt, 2)
        return {"hr": 60e3 / rr + err[:, :1], name: rr + err[:, 1:]}

    def temperature(self, rate: int) -> dict[str, np.ndarray]:
        slow = np.sin(2 * np.pi * self.second[:, None] / 86_400)
        return {"skin": 33 + 0.6 * slow - 0.8 * self.col["motor_activation"], "ambient": 24 + 1.5 * slow}


#: Streams: the family of artifacts, range, step, and how they are named beside their device.
FAMILY = {"eeg": ("eeg", -1000, 1000, 2000 / 4096), "ecg": ("ecg", -4000, 4000, 1), "ppg": ("ppg", 0, 4096, 1), "acc": ("acc", -8, 8, 1 / 4096), "eda": ("eda", 0.01, 100, 0.01),
          "hr_rr": ("ecg", 1, 3000, 0.001), "hr_ibi": ("ppg", 1, 3000, 0.001), "temperature": ("none", -20, 60, 0.01)}


def disturbed(kind: str, x: np.ndarray, severity: np.ndarray, s: Seconds, rows: np.ndarray, channel: int, high: float, mains: int, stream: str) -> np.ndarray:
    """Samples ``x`` (seconds, samples) of one channel under one kind of artifact, each in its own way."""
    rate = x.shape[1]
    t, frac = s.time(rate)[rows], np.arange(rate) / rate
    noise = lambda salt: _normal(s.key, s.second[rows], 100 + salt, rate)
    slow = lambda f: np.sin(2 * np.pi * f * t)
    if kind == "blink":  # a pulse over the eyes
        return x + (160 if channel in (1, 2) else 25) * severity * np.exp(-((frac - 0.4) ** 2) / 0.008)
    if kind == "jaw_emg":  # fast and rough, over the temples
        return x + (60 if channel in (0, 3) else 20) * severity * np.diff(noise(1), axis=1, prepend=0)
    if kind == "head_motion":
        return x + 80 * severity * (slow(1.3) + 0.5 * slow(2.9))
    if kind == "electrode_pop":  # a step that decays
        return x + 300 * severity * (frac >= 0.3) * np.exp(-np.maximum(frac - 0.3, 0) / 0.15)
    if kind == "impedance_drift":
        return x + 60 * severity * slow(0.05) + 10 * severity * noise(2 + channel)
    if kind == "common_mode":  # the same on all channels
        return x + 50 * severity * _normal(s.key, s.second[rows], 99, rate)
    if kind == "mains":
        return x + 30 * severity * np.sin(2 * np.pi * mains * t)
    if kind in ("clipping", "saturation"):
        return np.full_like(x, high) if stream == "ppg" else np.clip(x * (1 + 40 * severity), -high, high)
    if kind == "flatline":
        return np.repeat(x[:, :1], rate, axis=1)
    if kind == "baseline_wander":
        return x + 300 * severity * slow(0.25)
    if kind == "motion":
        return x + 200 * severity * (slow(1.8) + noise(6) * 0.4)
    p = s.cycle(rate)[rows]
    if kind == "missed_peak":  # no QRS
        return x - _bump(p, 0.0, 0.012, 1000) - _bump(p, -0.02, 0.008, -100) - _bump(p, 0.02, 0.008, -180)
    if kind == "extra_peak":
        return x + _bump(p, 0.5, 0.012, 900)
    if kind == "ectopic_like":  # early and wide
        return x - _bump(p, 0.0, 0.012, 1000) + _bump(p, -0.25, 0.03, 1200)
    if kind == "motion_coupling":  # the wrist's movement
        return x + 60 * severity * (0.3 + s.col["motor_activation"][rows]) * slow(1.8)
    if kind == "amplitude_modulation":
        middle = x.mean(axis=1, keepdims=True)
        return middle + (x - middle) * (1 - 0.7 * severity)
    if kind == "ambient_leak":
        return x + 400 * severity + 30 * severity * np.sin(2 * np.pi * (2 * mains % rate) * t)
    if kind == "drift":
        return x * (1 + 0.3 * severity * slow(0.004))
    if kind == "sparse_scr":
        return x + 0.4 * severity * np.exp(-((s.second[rows][:, None] % 13) - 2) ** 2 / 8)
    if kind == "motion_spike":
        return x + 2.5 * severity * (_hashed(s.key, s.second[rows], 107, 1) - 0.3)
    if kind == "dry_skin":
        return x * (1 - 0.7 * severity)
    if kind == "quantisation":
        return np.round(x / 0.1) * 0.1
    if kind == "bias":
        return x + (0.05 if channel else -0.05) * severity
    if kind == "scale":
        return x * (1 + 0.15 * severity)
    if kind == "gravity_leak":
        return x + (0.3 * severity if channel == 2 else 0)
    if kind == "jitter":  # samples are taken a little early or late
        at = np.clip(np.arange(rate) + 0.9 * severity * noise(8), 0, rate - 1)
        low = np.floor(at).astype(int)
        return np.take_along_axis(x, low, 1) + (at - low) * (np.take_along_axis(x, np.minimum(low + 1, rate - 1), 1) - np.take_along_axis(x, low, 1))
    return x


def lost(kind: str, n: int, rate: int, severity: np.ndarray, s: Seconds, rows: np.ndarray) -> np.ndarray:
    """Which samples a dropping artifact takes: single ones, packets, or all."""
    if kind == "random_missing":
        return _hashed(s.key, s.second[rows], 109, rate) < 0.5 * severity
    if kind == "loss":
        packets = -(-rate // PACKET)
        return np.repeat(_hashed(s.key, s.second[rows], 110, packets) < severity, PACKET, axis=1)[:, :rate]
    return np.ones((n, rate), bool)


def make_stream(s: Seconds, device: str, name: str, rate: int, faults: list[list[dict]], mains: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """Channels, samples and their absence as (seconds, channels, samples), quality, and kind of what is missing."""
    family, low, high, step = FAMILY[name]
    made = {"acc": lambda: s.acc(rate, device), "hr_rr": lambda: s.interval(rate, "rr", 0.3, 60), "hr_ibi": lambda: s.interval(rate, "ibi", 1.5, 61)}.get(name, lambda: getattr(s, name)(rate))()
    gain = s.placed(device) if name in ("eeg", "ecg", "ppg", "eda") else 1.0
    x = np.stack([v * gain for v in made.values()], axis=1)
    n = len(x)
    gone, quality, kinds = np.zeros(x.shape, bool), np.ones(n), np.full(n, -1)
    found: dict[tuple[str, str | None], list[tuple[int, float]]] = {}
    for i, listed in enumerate(faults):
        for a in listed or ():
            if a["stream_name"] == family:
                found.setdefault((a["artifact_type"], a["channel"]), []).append((i, a["severity"]))
    for (kind, only), hits in sorted(found.items(), key=lambda kv: (kv[0][0], kv[0][1] or "")):
        rows, severity = np.array([i for i, _ in hits]), np.array([v for _, v in hits])[:, None]
        np.minimum.at(quality, rows, 1 - severity[:, 0])
        if kind == "rotation" and name == "acc":
            a = 0.8 * severity
            old = x[rows].copy()
            x[rows, 0], x[rows, 1] = np.cos(a) * old[:, 0] - np.sin(a) * old[:, 1], np.sin(a) * old[:, 0] + np.cos(a) * old[:, 1]
        if name in ("hr_rr", "hr_ibi"):  # what the device makes of a missed, an extra or an early beat
            by = {"missed_peak": 2.0, "extra_peak": 0.5, "ectopic_like": 0.7}.get(kind)
            if by:
                x[rows, 1] *= by
                x[rows, 0] /= by
        for c, ch in enumerate(made):
            if only is not None and only != ch and name == "eeg":
                continue
            if kind in DROPS:
                gone[rows, c] |= lost(kind, len(rows), x.shape[2], severity, s, rows)
                kinds[rows] = np.maximum(kinds[rows], MISSING.index(DROPS[kind]))
            elif name not in ("hr_rr", "hr_ibi"):
                x[rows, c] = disturbed(kind, x[rows, c], severity, s, rows, c, high, mains, name)
    x = np.clip(np.round(x / step) * step, low, high).astype(np.float32)
    return list(made), x, gone, quality, [MISSING[k] if k >= 0 else None for k in kinds]


STATE = ("autonomic_arousal", "motor_activation", "cognitive_load", "eda_drive", "eeg_aperiodic_exponent_truth", "eeg_relative_alpha_truth", "eeg_relative_gamma_truth", "eda_tonic_level_us_truth", "sensor_tolerance_truth", "rr_ms")


def make_seconds(batches: Iterator[pa.RecordBatch], streams: list[tuple[str, str, str, int]], mains: int) -> Iterator[pa.RecordBatch]:
    """Rows of all streams for rows of seconds, some seconds of one person at a time."""
    for b in batches:
        if not b.num_rows:
            continue
        person = b.column("seed").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], person[1:] != person[:-1], [True])))
        pieces = [(i, min(i + ROWS_AT_ONCE, z)) for a, z in zip(cuts[:-1], cuts[1:], strict=True) for i in range(a, z, ROWS_AT_ONCE)]
        for a, z in pieces:
            part = b.slice(a, z - a)
            s = Seconds({c: part.column(c).to_numpy(zero_copy_only=False) for c in ("truth_time_ns", "seed", "beat_micro", "rate_micro", *STATE)})
            faults = part.column("artifacts").to_pylist()
            for device, name, called, rate in streams:
                channels, x, gone, quality, missing = make_stream(s, device, name, rate, faults, mains)
                n, c, k = x.shape
                items = pa.ListArray.from_arrays(pa.array(np.arange(0, n * c + 1) * k, pa.int32()), pa.array(x.reshape(-1), pa.float32(), mask=gone.reshape(-1)))
                maps = pa.MapArray.from_arrays(pa.array(np.arange(0, n + 1) * c, pa.int32()), pa.array(channels * n, pa.string()), items)
                values = [*(part.column(m) for m in ("run_id", "person_id", "clip_id")), pa.array([device] * n), pa.array([called] * n), part.column("truth_time_ns"), pa.array([k] * n, pa.int32()), maps,
                          pa.array(quality, pa.float32()), pa.array(missing, pa.string())]
                yield pa.RecordBatch.from_arrays(values, names=[f.split()[0] for f in NATIVE_SCHEMA.split(", ")])


def streams_of(config: RunConfig) -> list[tuple[str, str, str, int]]:
    """(device, stream, name of the stream in tables, rate) of all enabled streams."""
    called = lambda d, n: n if n != "acc" or d == "watch" else f"{d}_acc"
    return [(d, n, called(d, n), s.sample_rate_hz) for d, names in config.devices.items() for n, s in names.items() if s.enabled and not n.startswith("on_demand")]


def native(timeline: DataFrame, people: DataFrame, faults: DataFrame, spans: DataFrame | None, config: RunConfig, days: DataFrame | None = None) -> DataFrame:
    """Seconds of all streams: those that lie in ``spans`` (clips), or all of the timeline where that is None.

    ``timeline`` reaches from each person's start, since beats are counted from there.
    """
    keys, t = ["run_id", "person_id"], "truth_time_ns"
    beats = heart(timeline, people)
    latent = timeline.select(*keys, t, "autonomic_arousal", "motor_activation", "cognitive_load", "eda_drive")
    if spans is None:
        hour = floor_div(F.col(t), config.run.chunk_duration_sec * SECOND)
        seconds = latent.withColumn("clip_id", F.concat(F.lit("chunk_"), hour.cast("string")))
    else:
        seconds = during(latent, spans.select(*keys, "clip_id", "start_ns", "end_ns"), keys, t, "start_ns", "end_ns", HOUR, "inner").drop("start_ns", "end_ns")
    active = by_second(faults.drop("seed"), "start_time_ns", "end_time_ns", t).groupBy(*keys, t).agg(F.array_sort(F.collect_list(F.struct("stream_name", "artifact_type", "channel", "severity"))).alias("artifacts"))
    constants = people.select(*keys, "seed", "eeg_aperiodic_exponent_truth", "eeg_relative_alpha_truth", "eeg_relative_gamma_truth", "eda_tonic_level_us_truth")
    rows = seconds.join(beats, [*keys, t]).join(active, [*keys, t], "left").join(broadcast_if_small(constants, 100_000), keys)
    if days is None:
        rows = rows.withColumn("sensor_tolerance_truth", F.lit(0.0))
    else:
        day = floor_div(F.col(t) - F.lit(config.run.start_ns).cast("long"), DAY).cast("int")
        worn = days.select(*keys, F.col("day_index").cast("int").alias("_day"), "sensor_tolerance_truth")
        rows = rows.withColumn("_day", day).join(broadcast_if_small(worn, 100_000), [*keys, "_day"], "left").withColumn("sensor_tolerance_truth", F.coalesce("sensor_tolerance_truth", F.lit(0.0)))
    streams, mains = streams_of(config), config.artifacts.line_noise_hz
    light = rows.select(*keys, "clip_id", t, "seed", "beat_micro", "rate_micro", *[F.col(c).cast("double").alias(c) for c in STATE], "artifacts")
    # a row of some hundred bytes becomes 1,600 samples: dealt by hours, two of them a task at most, whatever the bytes
    tasks = max(tasks_of(timeline.sparkSession), config.run.participant_count * config.run.duration_sec // 7200)
    light = light.repartition(tasks, *keys, floor_div(F.col(t), HOUR)).sortWithinPartitions("seed", t)
    return light.mapInArrow(lambda batches: make_seconds(batches, streams, mains), NATIVE_SCHEMA)


def received(device_ns: Column, index: Column, rate: Column, seed: Column) -> Column:
    """When the packet of a sample arrives: once its last sample is taken, after a delay of its own; some are held up and overtaken."""
    packet = floor_div(index, PACKET)
    whole = device_ns + (((packet + 1) * PACKET - 1 - index).cast("double") / rate * F.lit(1e9)).cast("long")
    late = F.lit(DELAY_MS) * -F.log(F.lit(1.0) - seeds.fast_uniform(seed, packet))
    held = F.when(seeds.fast_uniform(F.xxhash64(seed, F.lit("held")), packet) < HELD_SHARE, F.lit(HELD_MS)).otherwise(F.lit(0.0))
    return whole + F.round((late + held) * 1e6).cast("long")


def with_clocks(rows: DataFrame, clocks: DataFrame, start_ns: int) -> DataFrame:
    """Add device and receive times of each second's first sample, and its packet; ``packet_seed`` gives the delay of each packet."""
    j = rows.join(broadcast_if_small(clocks.withColumnRenamed("seed", "clock_seed"), 100_000), ["run_id", "person_id", "device_id"])
    k = floor_div(F.col("second_ns"), SECOND)
    jitter = seeds.fast_normal(F.xxhash64("clock_seed", "stream_name"), k) * F.col("jitter_ms_std")
    t = device_time(F.col("second_ns"), F.lit(start_ns).cast("long"), F.col("initial_offset_ms"), F.col("drift_ppm"), jitter)
    index = (k - F.lit(start_ns // SECOND)) * F.col("sample_rate_hz")
    out = j.withColumns({"device_time_ns": t, "sample_index": index, "packet_id": floor_div(index, PACKET), "packet_seed": F.xxhash64("clock_seed", F.lit("delay"), "stream_name")})
    out = out.withColumn("receive_time_ns", received(F.col("device_time_ns"), F.col("sample_index"), F.col("sample_rate_hz"), F.col("packet_seed")))
    return out.drop("initial_offset_ms", "drift_ppm", "jitter_ms_std", "clock_seed")


def samples(rows: DataFrame) -> DataFrame:
    """One row for each sample and channel of timed rows; a sample is received with its packet."""
    kept = ["run_id", "person_id", "clip_id", "device_id", "stream_name", "quality_native"]
    wide = rows.select(*kept, "sample_rate_hz", "device_time_ns", "sample_index", "packet_seed", F.explode("channels").alias("channel", "x"))
    each = wide.select("*", F.posexplode("x").alias("k", "value"))
    step = (F.col("k").cast("double") * F.lit(1e9) / F.col("sample_rate_hz")).cast("long")
    timed = each.select(*kept, "channel", "value", "sample_rate_hz", "packet_seed", (F.col("device_time_ns") + step).alias("device_time_ns"), (F.col("sample_index") + F.col("k")).alias("sample_index"))
    arrived = received(F.col("device_time_ns"), F.col("sample_index"), F.col("sample_rate_hz"), F.col("packet_seed"))
    return timed.withColumns({"receive_time_ns": arrived, "packet_id": floor_div(F.col("sample_index"), PACKET)}).drop("sample_rate_hz", "packet_seed")


def marks(timeline: DataFrame, config: RunConfig) -> DataFrame:
    """Rows of ``native`` without samples, one a minute and device: the moments at which a device sends its own time."""
    first = {d: (called, rate) for d, _, called, rate in reversed(streams_of(config))}
    begun = F.pmod("truth_time_ns", F.lit(SYNC_SEC * SECOND).cast("long")) == 0
    at = timeline.filter(begun | (F.col("truth_time_ns") == F.lit(config.run.start_ns).cast("long"))).select("run_id", "person_id", F.col("truth_time_ns").alias("second_ns"))
    table = timeline.sparkSession.createDataFrame([(d, *x) for d, x in first.items()], "device_id string, stream_name string, sample_rate_hz int")
    return at.crossJoin(F.broadcast(table))  # three devices


def heard(timed: DataFrame) -> DataFrame:
    """(keys, device_time_ns, host_time_ns): marks as the collector hears them, stamped by its own clock after a delay of their own."""
    late = F.lit(DELAY_MS) * -F.log(F.lit(1.0) - seeds.fast_uniform(F.xxhash64("packet_seed", F.lit("mark")), F.col("packet_id")))
    held = F.when(seeds.fast_uniform(F.xxhash64("packet_seed", F.lit("mark held")), F.col("packet_id")) < HELD_SHARE, F.lit(HELD_MS)).otherwise(F.lit(0.0))
    return timed.select("run_id", "person_id", "device_id", "device_time_ns", (F.col("second_ns") + F.round((late + held) * 1e6).cast("long")).alias("host_time_ns"))


#: Marks from which on the drift is estimated too; before, the offset alone.
LEAST_MARKS = 10


def clock_track(marks: DataFrame) -> DataFrame:
    """What is known of each device's clock in each minute of its own time, from marks of earlier minutes alone.

    (run_id, person_id, device_id, first_ns, step, slope, at_sec, late_sec): minutes are counted from the device's first
    mark, and minute 0 knows that mark alone.  The line of the clock's error (device less host time, and the usual delay) over
    device time is a regression whose moments are running sums: a row a minute and device, so an estimate never
    changes when more is recorded.  Minutes without marks keep the last estimate.
    """
    keys = ["run_id", "person_id", "device_id"]
    first = marks.groupBy(*keys).agg(F.min("device_time_ns").alias("first_ns"), F.min_by("host_time_ns", "device_time_ns").alias("heard_ns"))
    usual = F.lit((DELAY_MS + HELD_SHARE * HELD_MS) / 1e3)
    own = marks.join(broadcast_if_small(first, 200_000), keys)
    x = (F.col("device_time_ns") - F.col("first_ns")) / F.lit(1e9)
    y = (F.col("device_time_ns") - F.col("host_time_ns")) / F.lit(1e9) + usual
    minute = floor_div(F.col("device_time_ns") - F.col("first_ns"), SYNC_SEC * SECOND)
    sums = {"n": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}
    by_minute = own.groupBy(*keys, "first_ns", minute.alias("minute")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    past = Window.partitionBy(*keys).orderBy("minute")  # a row a minute
    known = by_minute.select(*keys, "first_ns", "minute", *[F.sum(n).over(past.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in sums], F.lead("minute").over(past).alias("next"))
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when((F.col("n") >= LEAST_MARKS) & (spread > 0), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).otherwise(F.lit(0.0))
    until = F.coalesce("next", F.col("minute") + 2)
    later = known.select(*keys, "first_ns", F.explode(F.sequence(F.col("minute") + 1, until)).alias("step"), slope.alias("slope"), (F.col("sx") / F.col("n")).alias("at_sec"), (F.col("sy") / F.col("n")).alias("late_sec"))
    begin = first.select(*keys, "first_ns", F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("slope"), F.lit(0.0).alias("at_sec"), ((F.col("first_ns") - F.col("heard_ns")) / F.lit(1e9) + usual).alias("late_sec"))
    return begin.unionByName(later)


def align(rows: DataFrame, track: DataFrame) -> DataFrame:
    """Estimate grid time from device time, less what ``track`` knows of the device's clock by then.

    Jitter is no part of the line and stays; ``alignment_residual_sec`` is the error that is left, which only the
    simulation can tell.
    """
    keys = ["run_id", "person_id", "device_id"]
    first = track.groupBy(*keys).agg(F.min("first_ns").alias("first_ns"))
    begun = rows.join(broadcast_if_small(first, 200_000), keys, "left")
    begun = begun.withColumn("step", F.greatest(floor_div(F.col("device_time_ns") - F.col("first_ns"), SYNC_SEC * SECOND), F.lit(0).cast("long")))
    out = begun.join(broadcast_if_small(track.drop("first_ns"), 200_000), [*keys, "step"], "left")
    x = (F.col("device_time_ns") - F.col("first_ns")) / F.lit(1e9)
    late = F.coalesce(F.col("late_sec") + F.col("slope") * (x - F.col("at_sec")), F.lit(0.0))
    aligned = F.col("device_time_ns") - F.round(late * F.lit(1e9)).cast("long")
    return out.withColumns({"aligned_time_ns": aligned, "alignment_residual_sec": (aligned - F.col("second_ns")) / F.lit(1e9)}).drop("slope", "at_sec", "late_sec", "first_ns", "step")


def aligned(rows: DataFrame, timeline: DataFrame, clocks: DataFrame, config: RunConfig) -> DataFrame:
    """Rows with device, receive and aligned times; clocks are followed by their marks, so no sample is made for it."""
    start = config.run.start_ns
    return align(with_clocks(rows, clocks, start), clock_track(heard(with_clocks(marks(timeline, config), clocks, start))))


def on_grid(rows: DataFrame) -> DataFrame:
    """Aligned rows, each in the grid second nearest to the aligned time of its first sample; the true second is left behind."""
    return rows.withColumn("second_ns", floor_div(F.col("aligned_time_ns") + F.lit(SECOND // 2).cast("long"), SECOND) * F.lit(SECOND).cast("long"))


def global_field_power(channels: list) -> Column:
    """Mean over samples of the spatial standard deviation of the channels."""
    n = float(len(channels))
    zipped = F.arrays_zip(*channels)
    names = [str(i) for i in range(len(channels))]
    values = lambda s: F.array(*[F.coalesce(s[k].cast("double"), F.lit(0.0)) for k in names])
    spread = lambda v: F.sqrt(F.greatest(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / n - F.pow(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n, F.lit(2.0)), F.lit(0.0)))
    return arrays.mean(F.transform(zipped, lambda s: spread(values(s))))


def peaks(rows: DataFrame, stream: str, channel: str, threshold: float) -> DataFrame:
    """(run_id, person_id, t): times of local maxima above ``threshold`` times the second's range over its minimum.

    A second whose range is under half of what is usual in its hour holds no peak.
    """
    keys = ["run_id", "person_id"]
    x = F.transform(F.filter(F.try_element_at("channels", F.lit(channel)), lambda v: v.isNotNull()), lambda v: v.cast("double"))
    one = rows.filter(F.col("stream_name") == stream).select(*keys, "second_ns", "sample_rate_hz", x.alias("x")).filter(F.size("x") > 2)
    one = one.withColumns({"span": F.array_max("x") - F.array_min("x"), "_hour": floor_div(F.col("second_ns"), HOUR)})
    usual = one.groupBy(*keys, "_hour").agg(F.percentile("span", F.lit(0.5)).alias("usual"))
    level = F.array_min("x") + F.lit(threshold) * F.col("span")
    clear = one.join(broadcast_if_small(usual, 200_000), [*keys, "_hour"]).filter(F.col("span") >= F.col("usual") / 2)
    each = clear.select("*", level.alias("level"), F.posexplode("x").alias("k", "v"))
    before, after = F.try_element_at("x", F.col("k")), F.try_element_at("x", F.col("k") + 2)
    inner = (F.col("k") > 0) & (F.col("k") < F.size("x") - 1)
    top = each.filter(inner).filter((F.col("v") > F.col("level")) & (F.col("v") > before) & (F.col("v") >= after))
    return top.select(*keys, (F.col("second_ns") + (F.col("k") * F.lit(1e9) / F.col("sample_rate_hz")).cast("long")).alias("t"))


def intervals_by_second(times: DataFrame, name: str, low_ms: float = 300.0, high_ms: float = 2000.0) -> DataFrame:
    """(run_id, person_id, canonical_time_ns, name): median of the intervals that end in each second, from times of peaks; others than of beats are left out."""
    keys = ["run_id", "person_id"]
    gap = (F.col("t") - F.col("_before")) / F.lit(1e6)
    each = lagged(times, keys, "t", "t", "_before", HOUR).withColumn("gap", gap).filter(F.col("gap").between(low_ms, high_ms))
    second = floor_div(F.col("t"), SECOND) * F.lit(SECOND).cast("long")
    return each.groupBy(*keys, second.alias("canonical_time_ns")).agg(F.percentile("gap", F.lit(0.5)).alias(name))


def valid(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull() & ~F.isnan(v))


def eeg_seconds(rows: DataFrame, mains: float = 60.0) -> DataFrame:
    """(keys, canonical_time_ns, and for each channel band powers, spectral entropy, and shares of mains and of muscle): never a mean of raw EEG."""
    eeg = rows.filter(F.col("stream_name") == "eeg")
    rate = 256.0
    kept = ("delta_abs_power", "theta_abs_power", "alpha_abs_power", "beta_abs_power", "gamma_abs_power", "spectral_entropy", "line_noise_ratio", "high_freq_artifact_ratio")
    summary = spectral.summary_udf(rate, mains)
    for c in EEG_CHANNELS:
        eeg = eeg.withColumn(f"_{c}", summary(valid(F.try_element_at("channels", F.lit(c)))))
    return eeg.select("run_id", "person_id", F.col("second_ns").alias("canonical_time_ns"), *[F.col(f"_{c}.{n}").alias(f"eeg_{c}_1s_{n}") for c in EEG_CHANNELS for n in kept])


def one_second_summaries(rows: DataFrame) -> DataFrame:
    """timeline_1hz columns from native seconds (``on_grid`` where clocks run): one pivoting aggregate of what each stream is worth."""
    ch = lambda c: F.try_element_at("channels", F.lit(c))
    wide = lambda a: F.transform(valid(a), lambda v: v.cast("double"))
    one = lambda c: F.try_element_at(valid(ch(c)), F.lit(1)).cast("double")
    of = lambda stream, value: F.max(F.when(F.col("stream_name") == stream, value))
    there = lambda c: F.size(valid(ch(c))) / F.col("sample_rate_hz")
    columns = {}
    for c in EEG_CHANNELS:
        is_eeg = F.col("stream_name") == "eeg"
        columns |= {
            f"eeg_{c}": F.max_by(F.when(is_eeg, ch(c)), F.when(is_eeg, F.col("second_ns"))), f"eeg_{c}_rms_uv": of("eeg", arrays.rms(valid(ch(c)))),
            f"eeg_{c}_coverage_ratio": of("eeg", there(c)), f"eeg_{c}_sample_count": of("eeg", F.size(valid(ch(c)))),
        }
    vm = F.zip_with(F.zip_with(ch("x"), ch("y"), lambda a, b: a * a + b * b), ch("z"), lambda s, c: F.sqrt(s + c * c).cast("double"))
    sma = F.zip_with(F.zip_with(ch("x"), ch("y"), lambda a, b: F.abs(a) + F.abs(b)), ch("z"), lambda s, c: (s + F.abs(c)).cast("double"))
    for loc, stream in (("wrist", "acc"), ("head", "headband_acc"), ("chest", "strap_acc")):
        jerk = F.when(F.size(valid(vm)) > 1, arrays.line_length(valid(vm)) * F.col("sample_rate_hz") / (F.size(valid(vm)) - 1))
        columns |= {
            f"{loc}_vm": of(stream, arrays.mean(valid(vm))), f"{loc}_vm_sd": of(stream, F.sqrt(arrays.variance(valid(vm)))),
            f"{loc}_enmo": of(stream, arrays.mean(F.transform(valid(vm), lambda v: F.greatest(v - 1, F.lit(0.0))))), f"{loc}_jerk": of(stream, jerk), f"{loc}_sma": of(stream, arrays.mean(valid(sma))),
            f"{loc}_coverage_ratio": of(stream, F.size(valid(vm)) / F.col("sample_rate_hz")), f"{loc}_sample_count": of(stream, F.size(valid(vm))),
        }
        columns |= {f"{loc}_{a}": of(stream, arrays.mean(wide(ch(a)))) for a in "xyz"}
    ecg = wide(ch("ecg"))
    following = F.slice(ecg, 2, F.greatest(F.size(ecg) - 1, F.lit(0)))
    pairs = F.zip_with(ecg, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    tops = F.zip_with(pairs, F.concat(F.array(F.lit(0.0)), ecg), lambda s, p: (s["a"] > 500) & (s["a"] >= s["b"]) & (s["a"] > p))
    columns |= {
        "ecg_rpeak_count": of("ecg", F.size(F.filter(tops, lambda v: F.coalesce(v, F.lit(False))))), "ecg_rpeak_confidence": of("ecg", F.least(F.greatest(F.array_max(ecg) / 1000.0, F.lit(0.0)), F.lit(1.0))),
        "ecg_mean_uv": of("ecg", arrays.mean(ecg)), "ecg_rms_uv": of("ecg", arrays.rms(ecg)), "ecg_line_length": of("ecg", arrays.line_length(ecg)), "ecg_coverage_ratio": of("ecg", there("ecg")),
        "ecg_sample_count": of("ecg", F.size(ecg)), "hr_bpm": of("hr_rr", one("hr")), "rr_ms": of("hr_rr", one("rr")), "watch_hr_bpm": of("hr_ibi", one("hr")), "watch_ibi_ms": of("hr_ibi", one("ibi")),
    }
    eda = wide(ch("eda"))
    steps = F.sequence(F.lit(0), F.size(eda) - 1)
    slope = F.when(F.size(eda) > 1, arrays.slope(F.transform(steps, lambda k: k.cast("double") / F.col("sample_rate_hz")), eda))
    columns |= {"eda_us": of("eda", arrays.mean(eda)), "eda_min_us": of("eda", F.array_min(eda)), "eda_max_us": of("eda", F.array_max(eda)), "eda_slope_us_per_sec": of("eda", slope), "eda_sample_count": of("eda", F.size(eda)), "eda_coverage_ratio": of("eda", there("eda"))}
    columns |= {
        "ppg_green_dc": of("ppg", arrays.mean(wide(ch("green")))), **{f"ppg_{c}_ac": of("ppg", arrays.peak_to_peak(valid(ch(c)))) for c in ("green", "ir", "red")}, "ppg_coverage_ratio": of("ppg", there("green")),
        "ppg_sample_count": of("ppg", F.size(valid(ch("green")))), "skin_temp_c": of("temperature", one("skin")), "ambient_temp_c": of("temperature", one("ambient")),
        "eeg_gfp": of("eeg", global_field_power([ch(c) for c in EEG_CHANNELS])), "quality_min": F.min("quality_native"), "quality_score": F.avg("quality_native"),
    }
    return rows.groupBy("run_id", "person_id", F.col("second_ns").alias("canonical_time_ns")).agg(*[v.alias(k) for k, v in columns.items()])
