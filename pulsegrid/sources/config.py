"""Run configuration: YAML with explicit ``extends``, strictly checked, unknown keys rejected."""

from __future__ import annotations

import hashlib
import json
import os
from typing import Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator


class ConfigError(ValueError):
    """The configuration can't be used; the command line ends with code 2."""


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid", frozen=True)


class Range(Strict):
    min: float
    max: float

    @model_validator(mode="after")
    def _ordered(self):
        if self.min > self.max:
            raise ValueError("min is above max")
        return self


class TruncatedNormal(Range):
    mean: float
    std: float = Field(gt=0)


class LogNormal(Strict):
    median: float = Field(gt=0)
    geometric_std: float = Field(gt=1)


class Beta(Strict):
    alpha: float = Field(gt=0)
    beta: float = Field(gt=0)


def _probabilities(weights: dict[str, float]) -> dict[str, float]:
    if any(not 0 <= w <= 1 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("weights must be probabilities that sum to 1")
    return weights


class Run(Strict):
    seed: int = Field(ge=0)
    start_time_utc: str
    duration_sec: int = Field(gt=0)
    participant_count: int = Field(gt=0)
    canonical_rate_hz: Literal[1] = 1
    local_utc_offset_hours: int = Field(default=9, ge=-12, le=14)
    chunk_duration_sec: int = Field(default=3600, gt=0)

    @field_validator("start_time_utc")
    @classmethod
    def _utc(cls, value: str) -> str:
        if not value.endswith("Z"):
            raise ValueError("the start must be in UTC and end in Z")
        return value

    @property
    def start_ns(self) -> int:
        from datetime import UTC, datetime

        at = datetime.strptime(self.start_time_utc, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
        return int(at.timestamp()) * 1_000_000_000


class Stream(Strict):
    """A device stream; rate, channels and unit are contracts and are checked, not tuned."""

    enabled: bool = True
    sample_rate_hz: int
    channels: tuple[str, ...]
    unit: str
    range_abs: float | None = None
    needs_capability: bool = False
    on_demand: Literal["none", "calibration_only"] = "none"


class Population(Strict):
    age_years: TruncatedNormal
    female_probability: float = Field(ge=0, le=1)
    resting_hr_bpm: TruncatedNormal
    rmssd_ms: LogNormal
    eeg_aperiodic_exponent: TruncatedNormal
    eeg_relative_alpha: Beta
    eeg_relative_gamma: Beta
    eda_tonic_level_us: LogNormal
    recovery_capacity: Beta
    response_archetypes: dict[str, float]
    research_prior_strength: float = Field(ge=0, le=1)
    opposite_direction_probability: float = Field(ge=0, le=1)
    no_response_probability: float = Field(ge=0, le=1)

    _weights = field_validator("response_archetypes")(_probabilities)


class Circadian(Strict):
    enabled: bool = True
    amplitude_variation: float = Field(default=0.25, ge=0, le=1)


class Sleep(Strict):
    enabled: bool = True
    bedtime_local_hour: TruncatedNormal
    duration_hours: TruncatedNormal


class Activity(Strict):
    daily_bouts: Range


class Meals(Strict):
    enabled: bool = True
    daily_count: int = Field(default=3, ge=0, le=6)


class Context(Strict):
    circadian: Circadian
    sleep: Sleep
    ordinary_activity: Activity
    meals: Meals


class Effect(Strict):
    """How an event moves a latent factor: in which direction, and how far."""

    direction_probabilities: dict[Literal["increase", "decrease", "unchanged"], float]
    magnitude: Beta

    _weights = field_validator("direction_probabilities")(_probabilities)


class Exceptions(Strict):
    no_precursor_probability: float = Field(ge=0, le=1)
    opposite_response_probability: float = Field(ge=0, le=1)
    missing_modality_probability: float = Field(ge=0, le=1)


class Pattern(Strict):
    """How a target shows: effects on latent factors, lags and strengths of the modalities, and exceptions."""

    latent_effects: dict[Literal["autonomic_arousal", "motor_activation", "cognitive_load"], Effect]
    lag_sec: dict[Literal["eeg", "cardiac", "eda", "motor"], Range]
    response_strength: dict[Literal["eeg", "cardiac", "eda", "motor"], Range]
    exceptions: Exceptions

    @model_validator(mode="after")
    def _complete(self):
        if len(self.latent_effects) < 3 or len(self.lag_sec) < 4 or len(self.response_strength) < 4:
            raise ValueError("a pattern names all three factors and all four modalities")
        if any(r.min < 0 or r.max > 1 for r in self.response_strength.values()):
            raise ValueError("strengths lie within 0 and 1")
        return self


class Artifacts(Strict):
    """Chances of artifacts; ``rates_per_hour`` by stream and kind replaces the usual rates."""

    enabled: bool = True
    random_missing_probability_per_hour: float = Field(ge=0, le=1)
    block_dropouts_per_day: Range
    line_noise_hz: Literal[50, 60] = 60
    motion_coupling: float = Field(default=2.0, ge=0)
    rates_per_hour: dict[str, dict[str, float]] = {}


class Events(Strict):
    target_events_per_day: Range
    minimum_gap_sec: int = Field(ge=0)
    clip_pre_sec: int = Field(ge=0)
    clip_post_sec: int = Field(ge=0)
    phases_sec: dict[str, Range]
    intensity: Beta
    hard_negative_ratio: float = Field(ge=0)
    hard_negatives: dict[str, float]
    matched_baseline_clips_per_day: int = Field(ge=0)

    _weights = field_validator("hard_negatives")(_probabilities)


class Clock(Strict):
    offset_ms: Range
    drift_ppm: Range
    jitter_ms_std: float = Field(ge=0)


class Features(Strict):
    windows_sec: tuple[int, ...]
    minimum_coverage: float = Field(gt=0, le=1)
    baseline_lookback_sec: int = Field(gt=0)
    baseline_warmup_sec: int = Field(ge=0)
    baseline_excluded_contexts: tuple[str, ...]


class Splits(Strict):
    seed: int
    fractions: dict[str, float]

    _weights = field_validator("fractions")(_probabilities)


class RunConfig(Strict):
    schema_version: Literal["1.0"] = "1.0"
    profile: str
    run: Run
    devices: dict[str, dict[str, Stream]]
    capabilities: tuple[str, ...] = ()
    population: Population
    context: Context
    events: Events
    pattern: Pattern
    artifacts: Artifacts
    clocks: dict[str, Clock]
    features: Features
    splits: Splits
    native_storage: Literal["clips", "all"] = "clips"
    size_guard_gb: float = Field(default=20, gt=0)

    @model_validator(mode="after")
    def _contracts(self):
        on_demand = 0
        for device, streams in self.devices.items():
            for name, s in streams.items():
                wanted = CONTRACTS.get(f"{device}.{name}")
                if wanted is None:
                    raise ValueError(f"unknown stream {device}.{name}")
                rates, channels, unit, ranges = wanted
                if s.sample_rate_hz not in rates or s.channels != channels or s.unit != unit:
                    raise ValueError(f"{device}.{name} breaks its contract")
                if ranges and s.range_abs not in ranges:
                    raise ValueError(f"{device}.{name} has no such range")
                if s.enabled and s.needs_capability and f"{device}.{name}" not in self.capabilities:
                    raise ValueError(f"{device}.{name} needs a capability flag")
                if s.enabled and name.startswith("on_demand"):
                    on_demand += 1
                    if s.on_demand != "calibration_only":
                        raise ValueError("on-demand streams are for calibration only")
        if on_demand > 1:
            raise ValueError("one on-demand stream at a time")
        return self


#: Allowed rates, channels, unit and ranges of each stream.
CONTRACTS = {
    "headband.eeg": ((256,), ("tp9", "af7", "af8", "tp10"), "uV", ()),
    "headband.acc": ((52,), ("x", "y", "z"), "g", (4.0,)),
    "headband.ppg": ((64,), ("ir_1", "ir_2", "red"), "au", ()),
    "strap.ecg": ((130,), ("ecg",), "uV", ()),
    "strap.acc": ((25, 50, 100, 200), ("x", "y", "z"), "g", (2.0, 4.0, 8.0)),
    "strap.hr_rr": ((1,), ("hr", "rr"), "bpm_ms", ()),
    "watch.acc": ((25,), ("x", "y", "z"), "g", ()),
    "watch.eda": ((1,), ("eda",), "uS", ()),
    "watch.hr_ibi": ((1,), ("hr", "ibi"), "bpm_ms", ()),
    "watch.ppg": ((25,), ("green", "ir", "red"), "au", ()),
    "watch.temperature": ((1,), ("skin", "ambient"), "C", ()),
    "watch.on_demand_ecg": ((500,), ("ecg",), "uV", ()),
    "watch.on_demand_ppg": ((100,), ("green",), "au", ()),
}


def merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_yaml(path: str, seen: tuple[str, ...] = ()) -> dict:
    """A YAML file over the one that its ``extends`` names, relative to it."""
    path = os.path.abspath(path)
    if path in seen:
        raise ConfigError(f"{path} extends itself")
    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    parent = own.pop("extends", None)
    return merged(read_yaml(os.path.join(os.path.dirname(path), parent), (*seen, path)), own) if parent else own


def source_files(path: str) -> dict[str, str]:
    """The text of a YAML file and of those that it extends, by their paths."""
    path = os.path.abspath(path)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    parent = (yaml.safe_load(text) or {}).get("extends")
    return {path: text} | (source_files(os.path.join(os.path.dirname(path), parent)) if parent else {})


def parse(raw: dict) -> RunConfig:
    try:
        return RunConfig.model_validate(raw)
    except ValueError as e:
        raise ConfigError(str(e)) from e


def load(path: str) -> RunConfig:
    return parse(read_yaml(path))


def profile_path(profile: str) -> str:
    """The file of a profile that comes with the package: golden, quick, mvp, full_raw."""
    return os.path.join(os.path.dirname(os.path.dirname(__file__)), "profiles", f"{profile}.yaml")


def builtin(profile: str) -> RunConfig:
    return load(profile_path(profile))


def resolved(config: RunConfig) -> str:
    """Canonical JSON of the whole configuration."""
    return json.dumps(config.model_dump(mode="json"), sort_keys=True, separators=(",", ":"))


def config_hash(config: RunConfig) -> str:
    return hashlib.sha256(resolved(config).encode()).hexdigest()


def run_id(config: RunConfig, version: str = "1") -> str:
    """Stable id of configuration, seed and version."""
    return "run_" + hashlib.sha256(f"{resolved(config)}/{config.run.seed}/{version}".encode()).hexdigest()[:16]


def json_schema() -> dict:
    return RunConfig.model_json_schema()


def estimate(config: RunConfig) -> dict[str, float]:
    """Rows and size to expect, before anything is generated."""
    persons, seconds = config.run.participant_count, config.run.duration_sec
    days = max(1, -(-seconds // 86_400))
    samples = sum(s.sample_rate_hz for streams in config.devices.values() for s in streams.values() if s.enabled)
    most = int(config.events.target_events_per_day.max) * days * persons
    clips = most * (1 + config.events.hard_negative_ratio) + config.events.matched_baseline_clips_per_day * days * persons
    clip_seconds = clips * (config.events.clip_pre_sec + config.events.clip_post_sec)
    rows = persons * seconds
    if config.native_storage == "all":
        clip_seconds = rows
    return {
        "canonical_rows": rows, "target_events_min": int(config.events.target_events_per_day.min) * days * persons, "target_events_max": most,
        "clip_seconds": clip_seconds, "native_samples": clip_seconds * samples, "size_gb": round((rows * 1200 + clip_seconds * samples * 6) / 1e9, 3),
    }


def guard(config: RunConfig) -> None:
    size = estimate(config)["size_gb"]
    if size > config.size_guard_gb:
        raise ConfigError(f"the run would take {size} GB; the guard is {config.size_guard_gb}")
