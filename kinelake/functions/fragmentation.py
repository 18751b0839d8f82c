"""Fragmentation endpoints of run lengths: aggregates over rows of (keys, length)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fragmentation(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Average duration, transition probability, Gini index, average hazard and power-law exponent by keys.

    lengths has the keys and `length`, one row a run; all runs of a key are
    pooled.  Everything is summed by distinct length first.
    """
    counts = lengths.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(*keys).orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    total = F.sum("c").over(all_)
    before = F.sum("c").over(up) - F.col("c")
    mass_before = F.sum(F.col("c") * F.col("length")).over(up) - F.col("c") * F.col("length")
    rows = counts.select(*keys, "length", "c", total.alias("n"), before.alias("before"), mass_before.alias("mass"), F.min("length").over(all_).alias("least"))
    # cumulative sums of c equal lengths: c * mass + length * c (c + 1) / 2
    area = F.sum(F.col("c") * F.col("mass") + F.col("length") * F.col("c") * (F.col("c") + 1) / 2)
    sums = rows.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.sum(F.col("c") * F.col("length")).alias("s"),
        area.alias("area"),
        F.avg(F.col("c") / (F.col("n") - F.col("before"))).alias("average_hazard"),
        F.sum(F.col("c") * F.log(F.col("length") / (F.col("least") - 0.5))).alias("logs"),
    )
    n, s = F.col("n"), F.col("s").cast("double")
    plain = (n + 1 - 2 * F.col("area") / s) / n
    return sums.select(
        *keys,
        (s / n).alias("average_duration"),
        (n / s).alias("transition_probability"),
        F.when(n == 1, F.lit(1.0)).otherwise(F.least(F.try_divide(plain * n, n - 1), F.lit(1.0))).alias("gini_index"),
        "average_hazard",
        (1 + n / F.col("logs")).alias("power_law"),
    )
