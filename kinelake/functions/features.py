"""Features of one-dimensional windows as aggregates.

A bank takes rows (keys, i, x), i the place within the window, and gives one row
a window.  Neighbours come from one sort by (keys, i); all features share it and
a single aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, keys: list[str], lag: int = 1) -> DataFrame:
    """df with window statistics (_n, _mean, _sd) and neighbours (_next, _next2, _lead)."""
    by, whole = Window.partitionBy(*keys).orderBy("i"), Window.partitionBy(*keys)
    return df.select(
        "*",
        F.count("x").over(whole).alias("_n"), F.avg("x").over(whole).alias("_mean"), F.stddev_samp("x").over(whole).alias("_sd"),
        F.lead("x").over(by).alias("_next"), F.lead("x", 2).over(by).alias("_next2"), F.lead("x", lag).over(by).alias("_lead"),
    )


def _n() -> Column:
    return F.count("x").cast("double")


def _percentile(p: float) -> Column:
    return F.expr(f"percentile(x, {p}D)")


def mean() -> Column:
    return F.avg("x")


def mean_cross_rate() -> Column:
    """Changes of the sign of x - mean, by the number of samples; zero is a sign of its own."""
    return F.sum(F.when(F.signum(F.col("x") - F.col("_mean")) != F.signum(F.col("_next") - F.col("_mean")), 1.0).otherwise(0.0)) / _n()


def std_dev() -> Column:
    return F.stddev_samp("x")


def skewness() -> Column:
    """Bias-corrected; Spark's own is not."""
    return F.skewness("x") * F.sqrt(_n() * (_n() - 1)) / (_n() - 2)


def kurtosis() -> Column:
    """Bias-corrected excess."""
    return ((_n() + 1) * F.kurtosis("x") + 6) * (_n() - 1) / ((_n() - 2) * (_n() - 3))


def value_range() -> Column:
    return F.max("x") - F.min("x")


def iqr() -> Column:
    return _percentile(0.75) - _percentile(0.25)


def rms() -> Column:
    """Of the signal less its mean, by n - 1: the same as std_dev."""
    return F.stddev_samp("x")


def autocorrelation() -> Column:
    """Pearson's r with the signal `lag` samples on (see neighbours)."""
    return F.corr("x", "_lead")


def autocorrelation_raw() -> Column:
    """Sum of lagged products by the two standard deviations."""
    both = F.col("_lead").isNotNull()
    return F.sum(F.col("x") * F.col("_lead")) / (F.stddev_samp(F.when(both, F.col("x"))) * F.stddev_samp("_lead"))


def linear_slope(fs: float) -> Column:
    return F.regr_slope(F.col("x"), F.col("i") / F.lit(fs))


def complexity_invariant_distance() -> Column:
    return F.sqrt(F.sum(F.pow(F.col("_next") - F.col("x"), F.lit(2)))) / F.stddev_samp("x")


def range_count_percentage(lo: float, hi: float) -> Column:
    return F.avg(F.when((F.col("x") >= lo) & (F.col("x") < hi), 1.0).otherwise(0.0))


def ratio_beyond_sigma(r: float) -> Column:
    return F.avg(F.when(F.abs(F.col("x") - F.col("_mean")) > r * F.col("_sd"), 1.0).otherwise(0.0))


def jerk_metric(fs: float) -> Column:
    return F.sum(F.pow(F.col("_next") - F.col("x"), F.lit(2))) * fs / (720.0 * F.pow(F.max(F.abs("x")), F.lit(2)))


def dimensionless_jerk(kind: str = "acceleration", log: bool = False) -> Column:
    """kind: what the signal is: velocity, acceleration or jerk."""
    peak = F.pow(F.max(F.abs("x")), F.lit(2))
    if kind == "velocity":
        out = -F.pow(_n(), F.lit(3)) * F.sum(F.pow(F.col("_next2") - 2 * F.col("_next") + F.col("x"), F.lit(2))) / peak
    elif kind == "acceleration":
        out = -_n() * F.sum(F.pow(F.col("_next") - F.col("x"), F.lit(2))) / peak
    elif kind == "jerk":
        out = -F.sum(F.pow("x", F.lit(2))) / (_n() * peak)
    else:
        raise ValueError(f"unknown kind of signal: {kind}")
    return -F.log(F.abs(out)) if log else out


class Bank:
    """Named aggregates that are computed together."""

    def __init__(self, **features: Column):
        self.features = dict(features)

    def add(self, name: str, feature: Column) -> Bank:
        if name in self.features:
            raise ValueError(f"the bank has a feature {name}")
        self.features[name] = feature
        return self

    def __contains__(self, name: str) -> bool:
        return name in self.features

    def compute(self, windows: DataFrame, keys: list[str], lag: int = 1) -> DataFrame:
        return neighbours(windows, keys, lag).groupBy(*keys).agg(*[f.alias(n) for n, f in self.features.items()])


#: Features without parameters that need nothing but the window, by name.
PLAIN: dict[str, Callable[[], Column]] = {f.__name__: f for f in (mean, mean_cross_rate, std_dev, skewness, kurtosis, value_range, iqr, rms, autocorrelation, autocorrelation_raw, complexity_invariant_distance)}


def permutation_entropy(windows: DataFrame, keys: list[str], order: int = 3, delay: int = 1, normalize: bool = False) -> DataFrame:
    """Shannon entropy (bits) of ordinal patterns; normalised by log2(order!) if asked."""
    import math

    by = Window.partitionBy(*keys).orderBy("i")
    points = [F.lead("x", k * delay).over(by) for k in range(order)]
    named = windows.select(*keys, *[p.alias(f"_p{k}") for k, p in enumerate(points)]).filter(F.col(f"_p{order - 1}").isNotNull())
    # ties keep their order in time
    pattern = F.transform(F.array_sort(F.array(*[F.struct(F.col(f"_p{k}").alias("v"), F.lit(k).alias("k")) for k in range(order)])), lambda s: s["k"])
    counts = named.groupBy(*keys, pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    out = counts.select(*keys, share.alias("p")).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("permutation_entropy"))
    return out.withColumn("permutation_entropy", F.col("permutation_entropy") / math.log2(math.factorial(order))) if normalize else out


def signal_entropy(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy of a histogram of ceil(sqrt n) bins between the extremes, as exp(H^2) - 2.

    The range that enters H reaches half a step (range / (n - 1)) beyond the extremes and is scaled by the sd.
    """
    whole = Window.partitionBy(*keys)
    s = windows.select(*keys, "x", F.count("x").over(whole).alias("n"), F.min("x").over(whole).alias("lo"), F.max("x").over(whole).alias("hi"), F.stddev_samp("x").over(whole).alias("sd"))
    s = s.withColumns({"k": F.ceil(F.sqrt(F.col("n").cast("double"))), "delta": (F.col("hi") - F.col("lo")) / (F.col("n") - 1)})
    width = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / F.col("k"))
    s = s.withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / width), F.col("k") - 1))
    h = s.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"), *[F.first(c).alias(c) for c in ("n", "lo", "hi", "sd", "k", "delta")])
    g = h.groupBy(*keys).agg(F.sum(F.col("c") * F.log("c")).alias("clogc"), *[F.first(c).alias(c) for c in ("n", "lo", "hi", "sd", "k", "delta")])
    spread = (F.col("hi") - F.col("lo") + F.col("delta")) / F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd"))
    estimate = -F.col("clogc") / F.col("n") + F.log("n") + F.log(F.nullif(spread, F.lit(0.0)) / F.col("k")) + (F.col("k") - 1) / (2.0 * F.col("n"))
    return g.select(*keys, F.coalesce(F.exp(estimate * estimate) - 2, F.lit(0.0)).alias("signal_entropy"))
