"""Activity: metrics of epochs and endpoints of days.

Epoch tables have recording_id, epoch (consecutive numbers within a segment) and
metric.  Endpoint functions aggregate them by the given keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import axes
from kinelake.functions.cutpoints import level_range
from kinelake.operators.windows import KEY, epochs


def metric_en(df: DataFrame, length: int) -> DataFrame:
    return epochs(df, length, F.avg(axes.magnitude()).alias("metric"))


def metric_angle(df: DataFrame, length: int) -> DataFrame:
    return epochs(df, length, F.avg(axes.z_angle()).alias("metric"))


def metric_enmo(df: DataFrame, length: int, take_abs: bool = False, trim_zero: bool = True) -> DataFrame:
    return epochs(df, length, F.avg(axes.enmo(take_abs, trim_zero)).alias("metric"))


def metric_mad(df: DataFrame, length: int) -> DataFrame:
    """Mean absolute deviation of the magnitude from its epoch's mean."""
    m = df.select(KEY, "sample_idx", axes.magnitude().alias("m"))
    whole = Window.partitionBy(KEY, F.floor(F.col("sample_idx") / length))
    m = m.withColumn("d", F.abs(F.col("m") - F.avg("m").over(whole)))
    return epochs(m, length, F.avg("d").alias("metric"))


def metric_enmo_met(df: DataFrame, fs: int, seconds: int = 60) -> DataFrame:
    """Metabolic equivalents: ENMO of each second, its largest in `seconds`, energy by a fixed polynomial."""
    second = metric_enmo(df, fs).withColumnRenamed("epoch", "sample_idx").withColumn("e", F.col("metric") * 1000)
    top = epochs(second, seconds, F.max("e").alias("e"))
    energy = -10.58 + 1.1176 * F.col("e") + 2.9418 * F.sqrt("e") - 0.00059277 * F.col("e") * F.col("e")
    return top.select(KEY, "epoch", (energy / 71.255).alias("metric"))


def in_level(level: str, cutpoints: str | dict):
    lo, hi = level_range(level, cutpoints)
    return (F.col("metric") >= lo) & (F.col("metric") < hi)


def intensity_minutes(table: DataFrame, keys: list[str], per_minute: float, cutpoints: str | dict, levels=("sed", "light", "mod", "vig", "mvpa")) -> DataFrame:
    """Minutes in each level."""
    return table.groupBy(*keys).agg(*[(F.sum(F.when(in_level(v, cutpoints), 1).otherwise(0)) / per_minute).alias(f"{v}_minutes") for v in levels])


#: Upper ends of the histogram's bins in g: steps of 25 mg to 4 g, and one open bin.
GRADIENT_STEP, GRADIENT_BINS = 0.025, 160


def intensity_gradient(table: DataFrame, keys: list[str], per_minute: float) -> DataFrame:
    """Slope, intercept and r squared of log minutes against log bin centre (mg)."""
    bin_ = F.least(F.floor(F.col("metric") / GRADIENT_STEP), F.lit(GRADIENT_BINS))
    h = table.filter((F.col("metric") >= 0) & (F.col("metric") <= 8)).groupBy(*keys, bin_.alias("bin")).agg((F.count(F.lit(1)) / per_minute).alias("minutes"))
    centre = F.when(F.col("bin") == GRADIENT_BINS, F.lit(6000.0)).otherwise((F.col("bin") + 0.5) * (GRADIENT_STEP * 1000))
    lx, ly = F.log(centre), F.log("minutes")
    out = h.groupBy(*keys).agg(F.regr_slope(ly, lx).alias("gradient"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r_squared"), F.count(F.lit(1)).alias("_n"))
    return out.select(*keys, *[F.when(F.col("_n") > 1, F.col(c)).alias(c) for c in ("gradient", "intercept", "r_squared")])


def extreme_means(table: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Largest and smallest mean of `window` consecutive epochs."""
    frame = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(0, window - 1)
    means = table.select(*keys, F.avg("metric").over(frame).alias("m"), F.count("metric").over(frame).alias("n")).filter(F.col("n") == window)
    return means.groupBy(*keys).agg(F.max("m").alias("max_mean"), F.min("m").alias("min_mean"))


def bout_minutes(table: DataFrame, keys: list[str], level_lo: float, level_hi: float, epoch_seconds: int, bout_minutes_: float, share: float, whole_ends: bool = True) -> DataFrame:
    """Minutes in bouts: windows with more than `share` of epochs in the level, and no break over a minute.

    whole_ends: windows must begin and end within the level (bout metric 4,
    otherwise 3).  Sums of integers are compared, so equal shares stay equal.
    """
    n_bout, n_break = int(bout_minutes_ * 60 // epoch_seconds), 60 // epoch_seconds + 1
    by = Window.partitionBy(*keys).orderBy("epoch")
    left = (n_break + 1) // 2 - 1
    x = table.select(*keys, "epoch", F.when((F.col("metric") >= level_lo) & (F.col("metric") < level_hi), 1).otherwise(0).alias("x"))
    near = by.rowsBetween(-left, n_break - 1 - left)
    x = x.withColumns({"near": F.sum("x").over(near), "near_n": F.count("x").over(near)})
    penalty = -(60 // epoch_seconds) * n_bout
    x = x.withColumn("y", F.when((F.col("near_n") < n_break) | (F.col("near") == 0), penalty).otherwise(F.col("x")))
    ahead = by.rowsBetween(0, n_bout - 1)
    x = x.withColumns({"s": F.sum("y").over(ahead), "n": F.count("y").over(ahead), "last": F.lead("x", n_bout - 1).over(by)})
    start = (F.col("n") == n_bout) & (F.col("s") > F.lit(share) * n_bout + 1e-9)
    if whole_ends:
        start = start & (F.col("x") == 1) & (F.col("last") == 1)
    x = x.withColumn("start", F.when(start, 1).otherwise(0))
    covered = F.max("start").over(by.rowsBetween(1 - n_bout, 0))
    return x.select(*keys, covered.alias("in_bout")).groupBy(*keys).agg((F.sum("in_bout") * F.lit(epoch_seconds) / F.lit(60.0)).alias("bout_minutes"))


def equal_average_duration(table: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """The threshold at which mean runs at or below and above it are closest, and the mean run below."""
    by = Window.partitionBy(*keys, "threshold").orderBy("epoch")
    rows = table.select(*keys, "epoch", "metric", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    rows = rows.withColumn("low", F.col("metric") <= F.col("threshold"))
    rows = rows.withColumn("new", F.when(F.col("low") == F.lag("low").over(by), 0).otherwise(1))
    # a mean run is epochs by runs
    sums = rows.groupBy(*keys, "threshold").agg(*[F.sum(F.when(F.col("low") == F.lit(v), c).otherwise(0)).alias(f"{n}{int(v)}") for v in (True, False) for n, c in (("k", F.lit(1)), ("r", F.col("new")))])
    mean = lambda v: F.when(F.col(f"r{v}") > 0, F.col(f"k{v}") / F.col(f"r{v}")).otherwise(0.0)
    sums = sums.select(*keys, "threshold", mean(1).alias("below"), mean(0).alias("above"))
    return sums.groupBy(*keys).agg(F.min_by(F.struct("threshold", "below"), F.struct(F.round(F.abs(F.col("below") - F.col("above")), 9), "threshold")).alias("b")).select(*keys, F.col("b.threshold").alias("threshold"), F.col("b.below").alias("duration"))


def arm_movement_levels(table: DataFrame) -> DataFrame:
    """Levels of 15-second epochs from the sd of the magnitude, the mean arm angle and the share of power in 0.6-2.5 Hz.

    table: recording_id, epoch, sd, angle, share.  Adds sedentary and level.
    """
    sd, angle, share = F.col("sd"), F.col("angle"), F.col("share")
    # Thresholds of the published decision rules.
    limit = F.when(share <= 0.118, 0.148).when(share <= 0.138, 0.098).otherwise(0.062)
    level = F.when((sd <= 0.26) & (angle > -52.0), "light").when((sd <= 0.26) | (sd <= 0.79) & (angle > -53.0), "moderate").otherwise("vigorous")
    return table.withColumns({"sedentary": sd <= limit, "level": level})
