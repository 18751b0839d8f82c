"""Declarative pipelines: named steps over a recording's tables, from code or JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

VERSION = "1.0"


@dataclass(frozen=True)
class Recording:
    """Named tables and scalars that steps read and replace."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    scalars: dict[str, object] = field(default_factory=dict)

    def with_table(self, name: str, table: DataFrame) -> Recording:
        return replace(self, tables={**self.tables, name: table})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no step has made a table {name}")
        return self.tables[name]


#: Steps that a pipeline may name; only what is registered here can be loaded.
STEPS: dict[str, Callable[..., Recording]] = {}


def step(f: Callable[..., Recording]) -> Callable[..., Recording]:
    STEPS[f.__name__] = f
    return f


class Pipeline:
    """Steps in order; run() builds one lazy plan over all tables."""

    def __init__(self):
        self.steps: list[dict] = []

    def add(self, process: str, name: str | None = None, **parameters) -> Pipeline:
        """Names that are taken get a number."""
        if process not in STEPS:
            raise ValueError(f"unknown step {process}; known are {sorted(STEPS)}")
        name = name or process
        taken = {s["name"] for s in self.steps}
        base, k = name, 1
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        self.steps.append({"name": name, "process": process, "parameters": parameters})
        return self

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"version": VERSION, "steps": self.steps}, f, indent=2)

    @classmethod
    def load(cls, path: str, on_unknown: str = "raise") -> Pipeline:
        with open(path) as f:
            spec = json.load(f)
        if spec.get("version", "").split(".")[0] != VERSION.split(".")[0]:
            raise ValueError(f"pipeline of version {spec.get('version')} cannot be read by {VERSION}")
        out = cls()
        for s in spec["steps"]:
            if s["process"] not in STEPS and on_unknown == "skip":
                continue
            out.add(s["process"], s["name"], **s["parameters"])
        return out

    def run(self, recording: Recording) -> Recording:
        for s in self.steps:
            recording = STEPS[s["process"]](recording, **s["parameters"])
        return recording


@step
def fill_gaps(recording: Recording, step: float, fills: dict | None = None) -> Recording:
    from kinelake.operators.timeline import filled

    return recording.with_table("samples", filled(recording["samples"], step, fills or {"ax": 0.0, "ay": 0.0, "az": 1.0}))


@step
def day_windows(recording: Recording, base: int = 0, period: int = 24, tz: str = "UTC") -> Recording:
    from kinelake.operators.timeline import day_windows as windows

    return recording.with_table("days", windows(recording["samples"], base, period, tz))


@step
def enmo_epochs(recording: Recording, length: int) -> Recording:
    from kinelake.operators.activity import metric_enmo

    return recording.with_table("epochs", metric_enmo(recording["samples"], length))


@step
def intensity(recording: Recording, cutpoints: str, per_minute: float) -> Recording:
    from kinelake.operators.activity import intensity_minutes

    return recording.with_table("intensity", intensity_minutes(recording["epochs"], ["recording_id"], per_minute, cutpoints))


@step
def wear_temperature(recording: Recording, length: int) -> Recording:
    from kinelake.operators.wear import temperature_wear

    return recording.with_table("wear", temperature_wear(recording["samples"], length))


@step
def activity_days(recording: Recording, fs: float, cutpoints: str = "migueles_wrist_adult", seconds: float = 5.0, least_wear: float = 10.0) -> Recording:
    """Reads samples, days and, where a step has made them, wear and sleep."""
    from kinelake.operators.days import daily_activity

    t = recording.tables
    return recording.with_table("activity", daily_activity(recording["samples"], recording["days"], fs, t.get("wear"), t.get("sleep"), cutpoints, seconds, least_wear))


@step
def sleep_days(recording: Recording, fs: float, least_hours: float = 6.0, least_wear: float = 0.0) -> Recording:
    """Reads samples, days and wear if there; makes sleep_days, and the opportunities as sleep."""
    from kinelake.operators.days import daily_sleep

    nights = daily_sleep(recording["samples"], recording["days"], fs, recording.tables.get("wear"), least_hours, least_wear)
    return recording.with_table("sleep_days", nights).with_table("sleep", nights.filter("start_idx is not null").select("recording_id", "start_idx", "stop_idx"))


@step
def gait_days(recording: Recording, fs: float, leg: float, events: str = "forward") -> Recording:
    """Reads samples, days and bouts if there; makes strides."""
    from kinelake.operators.days import daily_gait

    return recording.with_table("strides", daily_gait(recording["samples"], recording["days"], fs, leg, recording.tables.get("bouts"), events))
