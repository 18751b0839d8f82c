"""Wear detection from block statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.operators.intervals import runs
from kinelake.operators.windows import KEY, epochs, moving


def temperature_wear(df: DataFrame, length: int, warm: float = 26.0, still: float = 0.003) -> DataFrame:
    """State of each block: worn if warm; not worn if cold with two still axes; else by the trend of temperature.

    Equal temperatures take the block before; an undecided first block is null.
    """
    e = epochs(df, length, F.avg("temperature").alias("temp"), *[F.stddev_samp(a).alias(a) for a in ("ax", "ay", "az")])
    by = Window.partitionBy(KEY).orderBy("epoch")
    calm = sum((F.when(F.col(a) < still, 1).otherwise(0) for a in ("ax", "ay", "az")), F.lit(0))
    base = F.when(F.col("temp") >= warm, 1).when(calm >= 2, 0)
    before = F.lag("temp").over(by)
    e = e.withColumns({"base": base, "trend": F.when(F.col("temp") > before, 1).when(F.col("temp") < before, 0)})
    e = e.withColumn("known", F.coalesce("base", "trend"))
    # runs of equal temperature take over the last known state
    return e.select(KEY, "epoch", F.last("known", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("wear"))


def still_blocks(df: DataFrame, length: int, skip: int, sd: float = 0.013, reach: float = 0.067) -> DataFrame:
    """Whether each window is nonwear: two axes with little deviation and range; incomplete last windows repeat the last full one."""
    stats = None
    for a in ("ax", "ay", "az"):
        m = moving(df, a, length, skip, ["sd", "max", "min"], trim=False).select(KEY, "sample_idx", F.when((F.col("sd") < sd) & (F.col("max") - F.col("min") < reach), 1).when(F.col("sd").isNotNull(), 0).alias(a))
        stats = m if stats is None else stats.join(m, [KEY, "sample_idx"])
    by = Window.partitionBy(KEY).orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = stats.withColumn("n", F.when(F.col("ax").isNotNull(), (F.col("ax") + F.col("ay") + F.col("az") >= 2).cast("int")))
    return out.select(KEY, (F.col("sample_idx") / skip).cast("long").alias("sample_idx"), F.coalesce("n", F.last("n", ignorenulls=True).over(by), F.lit(0)).alias("nonwear"))


def adjusted_wear(blocks: DataFrame, per_hour: int, setup: bool = False, shipping: tuple[float, float] = (0.0, 0.0), passes: int = 3) -> DataFrame:
    """Wear intervals (in blocks) after rules on short wear between nonwear, applied in passes.

    Wear of 3 to 6 hours goes if under 30 % of the nonwear on both sides, wear
    of up to 3 hours if under 80 %; wear of up to 3 hours near the ends goes if
    an hour of nonwear follows it (start) or precedes it (end).
    """
    state, whole = blocks.select(KEY, "sample_idx", "nonwear"), Window.partitionBy(KEY)
    for _ in range(passes):
        r = runs(state, "nonwear").withColumn("n", F.max("stop_idx").over(whole))
        by = Window.partitionBy(KEY).orderBy("run")
        before, after = F.coalesce(F.lag("length").over(by), F.lit(0)), F.coalesce(F.lead("length").over(by), F.lit(0))
        hours = F.col("length") / per_hour
        r = r.withColumns({"before": before, "after": after})
        share = F.try_divide(F.col("length"), F.col("before") + F.col("after"))
        drop = (hours <= 6) & (hours > 3) & (share < 0.3) | (hours <= 3) & (share < 0.8)
        drop = drop | (hours <= 3) & (F.col("stop_idx") <= shipping[0] * per_hour) & (F.col("after") >= per_hour)
        drop = drop | (hours <= 3) & (F.col("start_idx") >= F.col("n") - shipping[1] * per_hour) & (F.col("before") >= per_hour)
        r = r.withColumn("nonwear", F.when((F.col("state") == 0) & F.coalesce(drop, F.lit(False)), 1).otherwise(F.col("state")))
        state = r.select(KEY, "nonwear", F.explode(F.sequence("start_idx", F.col("stop_idx") - 1)).alias("sample_idx"))
    out = runs(state, "nonwear").filter("state = 0")
    if setup:
        out = out.filter(~((F.col("start_idx") == 0) & (F.col("stop_idx") <= 3 * per_hour)))
    return out.select(KEY, "start_idx", "stop_idx")


def count_wear(counts: DataFrame, window: int = 90, interrupt: int = 2, flank: int = 30) -> DataFrame:
    """Nonwear from minute counts: zero runs over `window` minutes, short interruptions with long zero flanks ignored."""
    r = runs(counts.withColumn("zero", F.when(F.col("counts") > 0, 0).otherwise(1)), "zero")
    by = Window.partitionBy(KEY).orderBy("run")
    brief = (F.col("state") == 0) & (F.col("length") <= interrupt) & (F.lag("length").over(by) >= flank) & (F.lead("length").over(by) >= flank)
    r = r.withColumn("zero", F.when(brief, 1).otherwise(F.col("state")))
    smooth = r.select(KEY, "zero", F.explode(F.sequence("start_idx", F.col("stop_idx") - 1)).alias("sample_idx"))
    long = runs(smooth, "zero").withColumn("worn", F.when((F.col("state") == 1) & (F.col("length") > window), 0).otherwise(1))
    return long.select(KEY, "worn", F.explode(F.sequence("start_idx", F.col("stop_idx") - 1)).alias("sample_idx"))
