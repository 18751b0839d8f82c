"""Gait endpoints of a stride table.

strides: recording_id, day_n, bout_n, stride_idx, ic, fc, fc_opp (sample numbers
of initial contact, final contact and the other foot's final contact),
forward_cycles (0-2: how many following contacts belong to the same walk), and
optionally h1, h2, h2b (vertical displacements in m).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUT = ["recording_id", "day_n", "bout_n"]
#: Differences of each with the next step: asymmetries.
ASYMMETRIC = ("stride_time", "stance_time", "swing_time", "step_time", "initial_double_support", "terminal_double_support", "double_support", "single_support", "step_length_1", "step_length", "stride_length_1", "stride_length", "gait_speed_1", "gait_speed")


def _ahead(c: str, k: int) -> Column:
    """The value k contacts on, if the walk goes that far."""
    return F.when(F.col("forward_cycles") >= k, F.lead(c, k).over(Window.partitionBy(*BOUT).orderBy("ic")))


def temporal(strides: DataFrame, fs: float) -> DataFrame:
    """Times of steps and supports in seconds, and cadence in steps a minute."""
    out = strides.withColumns({"_ic1": _ahead("ic", 1), "_ic2": _ahead("ic", 2), "_opp1": _ahead("fc_opp", 1)})
    out = out.withColumns({
        "stride_time": (F.col("_ic2") - F.col("ic")) / fs,
        "stance_time": (F.col("fc") - F.col("ic")) / fs,
        "swing_time": (F.col("_ic2") - F.col("fc")) / fs,
        "step_time": (F.col("_ic1") - F.col("ic")) / fs,
        "initial_double_support": (F.col("fc_opp") - F.col("ic")) / fs,
        "terminal_double_support": (F.col("_opp1") - F.col("_ic1")) / fs,
        "single_support": (F.col("_ic1") - F.col("fc_opp")) / fs,
    })
    return out.withColumns({"double_support": F.col("initial_double_support") + F.col("terminal_double_support"), "cadence": F.try_divide(F.lit(60.0), F.col("step_time"))}).drop("_ic1", "_ic2", "_opp1")


def _pendulum(leg: Column, h: str) -> Column:
    """Reach of an inverted pendulum that falls by h."""
    inner = 2 * leg * F.col(h) - F.col(h) * F.col(h)
    return 2 * F.sqrt(F.when(inner >= 0, inner))


def spatial(table: DataFrame, leg: float) -> DataFrame:
    """Lengths and speeds of the one- and two-phase pendulum; table as of temporal(), with h1, h2, h2b."""
    bout = Window.partitionBy(*BOUT)
    foot = F.try_divide(F.expr("percentile(initial_double_support, 0.5)").over(bout), F.expr("percentile(single_support, 0.5)").over(bout)) * leg
    out = table.withColumns({"step_length_1": _pendulum(F.lit(leg), "h1"), "step_length": _pendulum(F.lit(leg), "h2") + _pendulum(foot * 1.1, "h2b")})
    out = out.withColumns({"stride_length_1": F.col("step_length_1") + _ahead("step_length_1", 1), "stride_length": F.col("step_length") + _ahead("step_length", 1)})
    return out.withColumns({"gait_speed_1": F.try_divide(F.col("stride_length_1"), F.col("stride_time")), "gait_speed": F.try_divide(F.col("stride_length"), F.col("stride_time"))})


def asymmetries(table: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return table.withColumns({f"{c}_asymmetry": _ahead(c, 1) - F.col(c) for c in names if c in table.columns})


def phase_coordination(table: DataFrame) -> DataFrame:
    """Per bout: 100 (cv of phases + mean deviation from one half, by one half), phase = step by stride time."""
    p = table.select(*BOUT, F.try_divide(F.col("step_time"), F.col("stride_time")).alias("phase")).filter("phase is not null")
    return p.groupBy(*BOUT).agg((100 * (F.stddev_samp("phase") / F.avg("phase") + F.avg(F.abs(F.col("phase") - 0.5)) / 0.5)).alias("phase_coordination_index"))


def symmetry(table: DataFrame) -> DataFrame:
    """Autocovariance symmetry |a - b| and regularity index 1 - 2 |a - b| / (a + b) of step and stride regularity."""
    d = F.abs(F.col("stride_regularity") - F.col("step_regularity"))
    return table.withColumns({"autocovariance_symmetry": d, "regularity_index": 1 - 2 * F.try_divide(d, F.col("stride_regularity") + F.col("step_regularity"))})


def bout_summary(table: DataFrame, names: list[str]) -> DataFrame:
    return table.groupBy(*BOUT).agg(F.count(F.lit(1)).alias("strides"), *[F.avg(n).alias(f"{n}_mean") for n in names], *[F.stddev_samp(n).alias(f"{n}_sd") for n in names])
