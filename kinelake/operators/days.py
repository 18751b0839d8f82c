"""Days of recordings: activity, sleep, gait and transfers of each day, from samples and day windows.

days has recording_id, day_n, start_idx, stop_idx; wear, sleep and bouts are
intervals of the recording.  Within a day the key is a struct of recording and
day (and segment), so every operator that takes a recording takes a day as well,
and no task holds more than a day.  Samples find their interval by an equi-join
on blocks of samples, not by a range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import axes
from kinelake.functions.cutpoints import CUTPOINTS, LEVELS, level_range
from kinelake.functions.fragmentation import fragmentation
from kinelake.operators import activity, detectors, gait, kernels, sleep, walking
from kinelake.operators.intervals import intersection, merged_bouts, runs
from kinelake.operators.windows import KEY, epochs, moving, ordered

#: Samples that share a block when they are matched with intervals.
BLOCK = 1 << 16
DAY = [KEY, "day_n"]


def within(samples: DataFrame, spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """Samples with the columns of each interval (recording_id, start_idx, stop_idx, ...) that holds them."""
    dealt = spans.filter("stop_idx > start_idx").withColumn("_block", F.explode(F.sequence(F.floor(F.col("start_idx") / block), F.floor((F.col("stop_idx") - 1) / block))))
    rows = samples.withColumn("_block", F.floor(F.col("sample_idx") / block)).join(dealt, [KEY, "_block"])
    return rows.filter((F.col("sample_idx") >= F.col("start_idx")) & (F.col("sample_idx") < F.col("stop_idx"))).drop("_block")


def _keyed(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumn(KEY, F.struct(F.col(KEY).alias("recording"), *names))


def _flat(df: DataFrame, *names: str) -> DataFrame:
    """recording_id and the other parts of the key as columns again."""
    return df.select(F.col(f"{KEY}.recording").alias(KEY), *[F.col(f"{KEY}.{n}").alias(n) for n in names], *[c for c in df.columns if c != KEY])


def clipped(days: DataFrame, spans: DataFrame) -> DataFrame:
    """Intervals of a recording as far as they lie in a day; the key holds recording and day."""
    both = days.select(*DAY, F.col("start_idx").alias("_lo"), F.col("stop_idx").alias("_hi")).join(spans.select(KEY, "start_idx", "stop_idx"), KEY)
    cut = both.select(*DAY, F.greatest("start_idx", "_lo").alias("start_idx"), F.least("stop_idx", "_hi").alias("stop_idx")).filter("stop_idx > start_idx")
    return _keyed(cut, "day_n").select(KEY, "start_idx", "stop_idx")


def segments(days: DataFrame, included: list[DataFrame], excluded: list[DataFrame]) -> DataFrame:
    """recording_id, day_n, start_idx, stop_idx: what of each day all of `included` cover and none of `excluded`."""
    spans = _keyed(days, "day_n").select(KEY, F.col("start_idx").alias("lo"), F.col("stop_idx").alias("hi"))
    return _flat(intersection(spans, [clipped(days, i) for i in included], [clipped(days, e) for e in excluded]), "day_n")


def _hours(parts: DataFrame, fs: float, name: str) -> DataFrame:
    return parts.groupBy(*DAY).agg(F.round(F.sum(F.col("stop_idx") - F.col("start_idx")) / (3600 * fs), 1).alias(name))


def segment_metric(samples: DataFrame, parts: DataFrame, fs: float, seconds: float, cutpoints: str | dict) -> DataFrame:
    """recording_id, day_n, segment, epoch, metric of segments; epochs begin anew with each."""
    cuts = CUTPOINTS[cutpoints] if isinstance(cutpoints, str) else cutpoints
    length, name = int(seconds * fs), cuts["metric"]
    rows = within(samples, parts.withColumn("segment", F.col("start_idx"))).withColumn("sample_idx", F.col("sample_idx") - F.col("start_idx"))
    rows = _keyed(rows, "day_n", "segment")
    if name == "enmo":
        out = activity.metric_enmo(rows, length, cuts.get("take_abs", False), cuts.get("trim_zero", True))
    elif name == "mad":
        out = activity.metric_mad(rows, length)
    elif name == "enmo_met":
        out = activity.metric_enmo_met(rows, int(fs), int(seconds))
    elif name in ("bfen", "hfen", "hfenplus"):
        out = kernels.filtered_metric(rows, fs, length, name, cuts.get("low", 0.2), cuts.get("high", 15.0))
    else:
        raise ValueError(f"unknown metric: {name}")
    return _flat(out, "day_n", "segment")


def activity_endpoints(table: DataFrame, minutes: DataFrame, seconds: float, cutpoints: str | dict, bout: float = 5.0, window: float = 15.0) -> DataFrame:
    """One row a day from epochs of `seconds` and of a minute of its segments.

    Minutes in each level that the cut-points tell, in bouts of moderate to
    vigorous activity, the intensity gradient, extreme means, and fragmentation of
    sedentary minutes.  Runs, bouts and windows end with their segment.
    """
    cuts = CUTPOINTS[cutpoints] if isinstance(cutpoints, str) else cutpoints
    levels = tuple(v for v, bounds in LEVELS.items() if all(b is None or b in cuts for b in bounds))
    per_minute, each = 60 / seconds, [*DAY, "segment"]
    out = activity.intensity_minutes(table, DAY, per_minute, cuts, levels)
    out = out.join(activity.intensity_gradient(table, DAY, per_minute), DAY, "left")
    extremes = activity.extreme_means(table, each, int(window * per_minute)).groupBy(*DAY).agg(F.max("max_mean").alias("max_mean"), F.min("min_mean").alias("min_mean"))
    out = out.join(extremes, DAY, "left")
    if "mvpa" in levels:
        bouts = activity.bout_minutes(table, each, *level_range("mvpa", cuts), int(seconds), bout, 0.8).groupBy(*DAY).agg(F.sum("bout_minutes").alias("mvpa_bout_minutes"))
        out = out.join(bouts, DAY, "left")
    if "sed" in levels:
        states = _keyed(minutes, "day_n", "segment").select(KEY, F.col("epoch").alias("sample_idx"), F.when(activity.in_level("sed", cuts), 1).otherwise(0).alias("state"))
        still = _flat(runs(states, "state").filter("state = 1"), "day_n", "segment")
        names = [c for c in fragmentation(still, DAY).columns if c not in DAY]
        out = out.join(fragmentation(still, DAY).select(*DAY, *[F.col(c).alias(f"sed_{c}") for c in names]), DAY, "left")
    return out


def daily_activity(samples: DataFrame, days: DataFrame, fs: float, wear: DataFrame | None = None, asleep: DataFrame | None = None, cutpoints: str | dict = "migueles_wrist_adult", seconds: float = 5.0, least_wear: float = 10.0) -> DataFrame:
    """One row a day: hours, wear hours, and endpoints of waking wear (and, with sleep, wake_hours and endpoints of sleep as sleep_...).

    Days with less than least_wear hours of wear have no endpoints; without wear
    the whole recording counts.
    """
    worn = segments(days, [wear] if wear is not None else [], [])
    awake = segments(days, [wear] if wear is not None else [], [asleep]) if asleep is not None else worn
    out = days.select(*DAY, F.round((F.col("stop_idx") - F.col("start_idx")) / (3600 * fs), 1).alias("hours")).join(_hours(worn, fs, "wear_hours"), DAY, "left")
    out = out.withColumn("wear_hours", F.coalesce("wear_hours", F.lit(0.0)))
    enough = out.filter(F.col("wear_hours") >= least_wear).select(*DAY)

    def endpoints(parts):
        some = parts.join(enough, DAY, "left_semi").filter((F.col("stop_idx") - F.col("start_idx")) > int(60 * fs))
        return activity_endpoints(segment_metric(samples, some, fs, seconds, cutpoints), segment_metric(samples, some, fs, 60, cutpoints), seconds, cutpoints)

    if asleep is not None:
        out = out.join(_hours(awake, fs, "wake_hours"), DAY, "left")
    out = out.join(endpoints(awake), DAY, "left")
    if asleep is not None:
        night = endpoints(segments(days, [asleep, *([wear] if wear is not None else [])], []))
        out = out.join(night.select(*DAY, *[F.col(c).alias(f"sleep_{c}") for c in night.columns if c not in DAY]), DAY, "left")
    return out


def sleep_windows(samples: DataFrame, days: DataFrame, fs: float, wear: DataFrame | None = None, cold: float = 0.0, still: float = 0.0, **rest) -> DataFrame:
    """recording_id, day_n, start_idx, stop_idx (samples from the day's start): the longest rest of each day.

    Angles are means over five seconds of the medians of five seconds.  Rest needs
    wear; cold: not where the temperature's median is lower; still: not where any
    axis deviates less over half an hour.
    """
    n = int(5 * fs)
    columns = ["ax", "ay", "az", *(["temperature"] if cold > 0 and "temperature" in samples.columns else [])]
    rows = within(samples.select(KEY, "sample_idx", *columns), days.select(*DAY, "start_idx", "stop_idx")).withColumn("sample_idx", F.col("sample_idx") - F.col("start_idx"))
    rows = _keyed(rows, "day_n").select(KEY, "sample_idx", *columns)
    ahead = ordered(rows).rowsBetween(0, n - 1)
    medians = rows.select(KEY, "sample_idx", *[F.expr(f"percentile({c}, 0.5D)").over(ahead).alias(c) for c in columns], F.count("ax").over(ahead).alias("_n")).filter(F.col("_n") == n)
    angles = epochs(medians, n, F.avg(axes.z_angle()).alias("angle"), *[F.avg(c).alias(c) for c in columns]).withColumnRenamed("epoch", "sample_idx")
    allowed = angles.select(KEY, "sample_idx")
    if wear is not None:
        first = _keyed(days, "day_n").select(KEY, F.col("start_idx").alias("_first"))
        worn = clipped(days, wear).join(first, KEY).select(KEY, F.floor((F.col("start_idx") - F.col("_first")) / n).alias("a"), F.floor((F.col("stop_idx") - F.col("_first")) / n).alias("b")).filter("b > a")
        allowed = allowed.join(worn.select(KEY, F.explode(F.sequence("a", F.col("b") - 1)).alias("sample_idx")).distinct(), [KEY, "sample_idx"])
    if "temperature" in columns:
        low = moving(angles, "temperature", 60, 1, ["median"]).filter(F.col("median") < cold)
        allowed = allowed.join(low, [KEY, "sample_idx"], "left_anti")
    if still > 0:
        for c in ("ax", "ay", "az"):
            calm = moving(angles, c, 360, 1, ["sd"]).filter(F.col("sd") < still).select(KEY, (F.col("sample_idx") + 150).alias("sample_idx"))
            allowed = allowed.join(calm, [KEY, "sample_idx"], "left_anti")
    found = sleep.sleep_opportunity(angles.select(KEY, "sample_idx", "angle"), allowed=allowed, **rest)
    return _flat(found.select(KEY, (F.col("start_idx") * n).alias("start_idx"), (F.col("stop_idx") * n).alias("stop_idx")), "day_n")


def daily_sleep(samples: DataFrame, days: DataFrame, fs: float, wear: DataFrame | None = None, least_hours: float = 6.0, least_wear: float = 0.0, **opportunity) -> DataFrame:
    """One row a day of least_hours or more: start_idx, stop_idx of the sleep opportunity (samples of the recording), its minutes, and endpoints of the minutes within.

    Days with less than least_wear hours of wear, and without rest, have nulls.
    """
    some = days.filter((F.col("stop_idx") - F.col("start_idx")) >= least_hours * 3600 * fs)
    asked = some
    if wear is not None and least_wear > 0:
        asked = some.join(_hours(segments(some, [wear], []), fs, "_wear").filter(F.col("_wear") >= least_wear), DAY, "left_semi")
    rest = sleep_windows(samples, asked, fs, wear, **opportunity)
    rows = within(samples, asked.select(*DAY, "start_idx", "stop_idx")).withColumn("sample_idx", F.col("sample_idx") - F.col("start_idx"))
    minute = int(60 * fs)
    index = kernels.activity_index(_keyed(rows, "day_n"), fs, minute).withColumnRenamed("epoch", "sample_idx")
    scored = kernels.rescored_sleep(sleep.sleep_scores(index, "metric"))
    bounds = _keyed(rest, "day_n").select(KEY, F.floor(F.col("start_idx") / minute).alias("_a"), F.floor(F.col("stop_idx") / minute).alias("_b"))
    night = scored.join(bounds, KEY).filter((F.col("sample_idx") >= F.col("_a")) & (F.col("sample_idx") < F.col("_b"))).withColumn("sample_idx", F.col("sample_idx") - F.col("_a"))
    ends = _flat(sleep.night_endpoints(night.select(KEY, "sample_idx", "sleep")), "day_n")
    placed = rest.join(days.select(*DAY, F.col("start_idx").alias("_first")), DAY)
    minutes = ((F.col("stop_idx") - F.col("start_idx")) / minute).alias("opportunity_minutes")
    placed = placed.select(*DAY, (F.col("start_idx") + F.col("_first")).alias("start_idx"), (F.col("stop_idx") + F.col("_first")).alias("stop_idx"), minutes)
    return some.select(*DAY).join(placed, DAY, "left").join(ends, DAY, "left")


def daily_bouts(days: DataFrame, bouts: DataFrame | None, fs: float, gap: float = 0.5, least: float = 8.0) -> DataFrame:
    """recording_id, day_n, bout_n, start_idx, stop_idx: bouts of each day under `gap` seconds apart joined, over `least` seconds long."""
    parts = merged_bouts(clipped(days, days if bouts is None else bouts), int(gap * fs), int(least * fs))
    numbered = _flat(parts, "day_n")
    return numbered.withColumn("bout_n", F.row_number().over(Window.partitionBy(*DAY).orderBy("start_idx")).cast("long"))


def daily_gait(samples: DataFrame, days: DataFrame, fs: float, leg: float, bouts: DataFrame | None = None, events: str = "forward", gap: float = 0.5, least: float = 8.0) -> DataFrame:
    """Strides of each day's bouts with times, lengths and speeds; ic, fc and fc_opp count from the bout's first sample.

    Samples should be at 50 or 20 Hz (walking.downsampled); bouts without steps have no rows.
    """
    placed = daily_bouts(days, bouts, fs, gap, least)
    rows = within(samples.select(KEY, "sample_idx", "ax", "ay", "az"), placed).withColumn("sample_idx", F.col("sample_idx") - F.col("start_idx"))
    strides = walking.walking_strides(walking.prepared_bouts(rows.withColumn("day_n", F.col("day_n").cast("int")), fs), fs, events)
    return gait.spatial(gait.temporal(strides, fs), leg)


def daily_transfers(samples: DataFrame, days: DataFrame, fs: float, factor: float = 0.75, **limits) -> DataFrame:
    """Sit-to-stand transfers of each day (start_idx, stop_idx in samples of the recording) without partial ones."""
    rows = within(samples, days.select(*DAY, "start_idx", "stop_idx")).withColumnRenamed("start_idx", "_first")
    rows = _keyed(rows.withColumn("sample_idx", F.col("sample_idx") - F.col("_first")), "day_n", "_first")
    found = _flat(detectors.transfers(rows, fs, **limits), "day_n", "_first")
    placed = found.withColumns({c: F.col(c) + F.col("_first") for c in ("start_idx", "stop_idx")}).drop("_first")
    return detectors.whole_transfers(placed, factor)
