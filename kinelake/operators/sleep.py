"""Sleep: opportunity window, sleep scores and nightly endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.fragmentation import fragmentation
from kinelake.operators.intervals import drop_short, longest, runs
from kinelake.operators.windows import KEY, moving, ordered

# Weights of the minute itself, the two after and the four before it.
_AFTER, _BEFORE = (5.84, 4.024), (16.19, 5.07, 3.75, 6.87, 4.64)
SCALE = 0.243


def sleep_scores(df: DataFrame, value: str, scale: float = SCALE) -> DataFrame:
    """Weighted sums of neighbouring minutes of an activity index; under 0.5 is sleep."""
    by = ordered(df)
    terms = [F.coalesce(F.lag(value, k).over(by), F.lit(0.0)) * w for k, w in enumerate(_BEFORE)]
    terms += [F.coalesce(F.lead(value, k + 1).over(by), F.lit(0.0)) * w for k, w in enumerate(_AFTER)]
    score = sum(terms[1:], terms[0]) * scale
    return df.select(KEY, "sample_idx", score.alias("score")).withColumn("sleep", F.when(F.col("score") < 0.5, 1).otherwise(0))


def rest_threshold(df: DataFrame, value: str, percentile: float = 0.10, factor: float = 15.0, lowest: float = 0.1, highest: float = 0.5) -> DataFrame:
    """Per recording: a low percentile times a factor, within bounds."""
    p = F.expr(f"percentile({value}, {percentile}D)")
    return df.groupBy(KEY).agg(F.least(F.greatest(p * factor, F.lit(lowest)), F.lit(highest)).alias("threshold"))


def sleep_opportunity(angles: DataFrame, smooth: int = 60, rest: int = 360, pause: int = 720, half: int = 30, allowed: DataFrame | None = None, **threshold) -> DataFrame:
    """The longest rest: recording_id, start_idx, stop_idx in windows of `angles` (sample_idx, angle).

    Median-smoothed changes of angle under the threshold are rest; rests under
    `rest` windows and breaks under `pause` go; ends move by half a smoothing window.
    allowed: the windows (recording_id, sample_idx) that may be rest, if not all.
    """
    change = F.coalesce(F.abs(F.col("angle") - F.lag("angle").over(ordered(angles))), F.lit(0.0))
    d = moving(angles.select(KEY, "sample_idx", change.alias("d")), "d", smooth, 1, ["median"])
    low = F.col("median") < F.col("threshold")
    if allowed is not None:
        d, low = d.join(allowed.select(KEY, "sample_idx", F.lit(True).alias("_ok")), [KEY, "sample_idx"], "left"), low & F.col("_ok").isNotNull()
    marked = d.join(rest_threshold(d, "median", **threshold), KEY).select(KEY, "sample_idx", F.when(low, 1).otherwise(0).alias("s"))
    kept = drop_short(marked, "s", rest, 1, 0).withColumnRenamed("new_state", "s")
    kept = drop_short(kept, "s", pause, 0, 1).withColumnRenamed("new_state", "s")
    return longest(kept, "s", 1).select(KEY, (F.col("start_idx") + half).alias("start_idx"), (F.col("stop_idx") + half).alias("stop_idx"))


def night_endpoints(df: DataFrame) -> DataFrame:
    """Endpoints of a minute series (sample_idx from 0, sleep 0 or 1)."""
    by, whole = ordered(df), Window.partitionBy(KEY)
    d = df.select(KEY, "sample_idx", "sleep", F.lag("sleep").over(by).alias("before"), F.min(F.when(F.col("sleep") == 1, F.col("sample_idx"))).over(whole).alias("first"), F.max(F.when(F.col("sleep") == 1, F.col("sample_idx"))).over(whole).alias("last"))
    base = d.groupBy(KEY).agg(
        F.sum("sleep").alias("total_sleep_time"),
        F.round(100.0 * F.sum("sleep") / F.count("sleep"), 3).alias("percent_time_asleep"),
        F.greatest(F.sum(F.when((F.col("before") == 1) & (F.col("sleep") == 0), 1).otherwise(0)) - 1, F.lit(0)).alias("wake_bouts"),
        F.min("first").alias("sleep_onset_latency"),
        (F.min("last") - F.min("first") - F.sum(F.when((F.col("sleep") == 1) & (F.col("sample_idx") < F.col("last")), 1).otherwise(0))).alias("wake_after_sleep_onset"),
    )
    r = runs(df, "sleep")
    names = ["average_duration", "transition_probability", "gini_index", "average_hazard", "power_law"]
    for state, prefix in ((1, "sleep"), (0, "wake")):
        f = fragmentation(r.filter(F.col("state") == state), [KEY])
        base = base.join(f.select(KEY, *[F.col(c).alias(f"{prefix}_{c}") for c in names]), KEY, "left")
    return base
