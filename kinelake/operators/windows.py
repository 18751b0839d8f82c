"""Windows and moving statistics over ordered samples.

Samples are rows (recording_id, sample_idx, ...); window i of length w and step
s holds the samples [i s, i s + w).  All statistics are left-justified: the row
at i s carries window i.  Steps of at least the window's length group rows;
overlapping windows use frames, over partial aggregates of the largest common
block where the statistic allows, so that long windows do not cost w rows each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"


def window_samples(fs: float, length: float, step: float) -> tuple[int, int]:
    """Samples in a window of `length` seconds, and in its step.

    An integer step counts samples; a float in (0, 1] is a share of the window.
    """
    n = int(round(fs * length))
    if isinstance(step, int):
        if step <= 0:
            raise ValueError("step must be positive")
        return n, step
    if not 0.0 < step <= 1.0:
        raise ValueError("a step that is a share must lie in (0, 1]")
    return n, max(1, min(n, int(round(n * step))))


def ordered(df: DataFrame, key: str = KEY) -> Window:
    return Window.partitionBy(key).orderBy("sample_idx")


#: Aggregate of a window, by name.
STATISTICS = {
    "mean": F.avg,
    "sd": F.stddev_samp,
    "skewness": F.skewness,
    "kurtosis": F.kurtosis,
    "median": lambda c: F.expr(f"percentile({c}, 0.5)"),
    "max": F.max,
    "min": F.min,
}


def moving(df: DataFrame, value: str, length: int, skip: int, statistics: list[str], trim: bool = True, required: int | None = None) -> DataFrame:
    """recording_id, sample_idx (of the window's first sample), and one column a statistic.

    trim drops incomplete windows; otherwise they are null, or hold what the
    samples give if there are `required` of them.
    """
    if length <= 0 or skip <= 0:
        raise ValueError("window length and skip must be positive")
    least = length if required is None else required
    if skip >= length:
        rows = df.filter(F.col("sample_idx") % skip < length).groupBy(KEY, (F.floor(F.col("sample_idx") / skip) * skip).cast("long").alias("sample_idx"))
        out = rows.agg(F.count(value).alias("_n"), *[STATISTICS[s](value).alias(s) for s in statistics])
    else:
        block = math.gcd(length, skip)
        if block > 1 and set(statistics) <= {"mean", "max", "min"}:
            part = df.groupBy(KEY, (F.floor(F.col("sample_idx") / block)).cast("long").alias("_block"))
            part = part.agg(F.count(value).alias("_n"), F.sum(value).alias("_sum"), F.max(value).alias("_max"), F.min(value).alias("_min"))
            frame = Window.partitionBy(KEY).orderBy("_block").rowsBetween(0, length // block - 1)
            made = {"mean": F.sum("_sum").over(frame) / F.sum("_n").over(frame), "max": F.max("_max").over(frame), "min": F.min("_min").over(frame)}
            out = part.select(KEY, (F.col("_block") * block).alias("sample_idx"), F.sum("_n").over(frame).alias("_n"), *[made[s].alias(s) for s in statistics])
        else:
            frame = ordered(df).rowsBetween(0, length - 1)
            out = df.select(KEY, "sample_idx", F.count(value).over(frame).alias("_n"), *[STATISTICS[s](value).over(frame).alias(s) for s in statistics])
        out = out.filter(F.col("sample_idx") % skip == 0)
    if trim and required is None:
        return out.filter(F.col("_n") >= length).drop("_n")
    return out.withColumns({s: F.when(F.col("_n") >= least, F.col(s)) for s in statistics}).drop("_n")


def centred_sd(df: DataFrame, value: str, length: int) -> DataFrame:
    """Moving mean and sd placed ceil(length / 2) rows later, with the first and last values repeated at the ends."""
    length = max(length, 2)
    pad = math.ceil(length / 2)
    by = ordered(df)
    frame = by.rowsBetween(-pad, length - 1 - pad)
    whole = Window.partitionBy(KEY)
    at = df.select("*", F.avg(value).over(frame).alias("_m"), F.stddev_samp(value).over(frame).alias("_s"), F.max("sample_idx").over(whole).alias("_last"))
    inside = (F.col("sample_idx") >= pad) & (F.col("sample_idx") + length - 1 - pad <= F.col("_last"))
    at = at.withColumns({"mean": F.when(inside, F.col("_m")), "sd": F.when(inside, F.col("_s"))})
    before, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    # the first rows take the first full window, the last rows the one that lies `pad` from the end
    end = F.max(F.when(F.col("sample_idx") == F.col("_last") + 1 - pad, F.col("_m"))).over(whole), F.max(F.when(F.col("sample_idx") == F.col("_last") + 1 - pad, F.col("_s"))).over(whole)
    first = {c: F.first(c, ignorenulls=True).over(after) for c in ("mean", "sd")}
    last = {c: F.last(c, ignorenulls=True).over(before) for c in ("mean", "sd")}
    edge = {"mean": end[0], "sd": end[1]}
    return at.select(KEY, "sample_idx", *[F.coalesce(c, F.when(F.col("sample_idx") < pad, first[c]).otherwise(F.coalesce(edge[c], last[c]))).alias(c) for c in ("mean", "sd")])


def epochs(df: DataFrame, length: int, *aggregates: Column, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Aggregates of consecutive windows of `length` samples from index 0; partial ones are dropped."""
    out = df.groupBy(*keys, F.floor(F.col("sample_idx") / length).cast("long").alias("epoch")).agg(F.count(F.lit(1)).alias("_n"), *aggregates)
    return out.filter(F.col("_n") == length).drop("_n")


def autocovariance(df: DataFrame, value: str, lags: int, biased: bool = True) -> DataFrame:
    """Autocorrelation at lags 0 to lags - 1: recording_id, lag, value; biased by (n - k) / n if asked.

    Lagged pairs come from one array a recording, so no row meets itself in a join.
    """
    whole = Window.partitionBy(KEY)
    z = df.select(KEY, "sample_idx", (F.col(value) - F.avg(value).over(whole)).alias("_d"), F.count(value).over(whole).alias("_n"))
    by = Window.partitionBy(KEY).orderBy("sample_idx")
    lagged = [F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(lags)]
    sums = z.select("*", *[F.lead("_d", k).over(by).alias(f"_l{k}") for k in range(lags)]).groupBy(KEY).agg(F.first("_n").alias("_n"), *lagged)
    scale = lambda k: F.lit(1.0) if biased else F.col("_n") / (F.col("_n") - k)
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.try_divide(F.col(f"_s{k}"), F.col("_s0")) * scale(k)).alias("value")) for k in range(lags)])
    return sums.select(KEY, F.explode(pairs).alias("p")).select(KEY, "p.lag", "p.value").filter("value is not null")


def detrended_fluctuation(df: DataFrame, value: str, sizes: list[int]) -> DataFrame:
    """recording_id, alpha and activity balance index of box sizes that fit a recording."""
    whole, by = Window.partitionBy(KEY), ordered(df)
    y = df.select(KEY, "sample_idx", F.count(value).over(whole).alias("_n"), (F.col(value) - F.avg(value).over(whole)).alias("_d"))
    y = y.withColumn("_y", F.sum("_d").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    boxes = y.select(KEY, "sample_idx", "_n", "_y", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("box")).filter(F.col("box") <= F.col("_n"))
    place = (F.col("sample_idx") % F.col("box")).cast("double")
    fits = boxes.groupBy(KEY, "box", F.floor(F.col("sample_idx") / F.col("box")).alias("_b")).agg(F.count("_y").alias("_k"), F.regr_syy("_y", place).alias("_yy"), F.regr_sxy("_y", place).alias("_xy"), F.regr_sxx("_y", place).alias("_xx"))
    each = fits.filter("_k = box").withColumn("_rss", F.greatest(F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx"), F.lit(0.0)))
    f = each.groupBy(KEY, "box").agg(F.sqrt(F.sum("_rss") / F.sum("_k")).alias("dfa")).filter("dfa > 0")
    alpha = f.groupBy(KEY).agg(F.regr_slope(F.log("dfa"), F.log(F.col("box").cast("double"))).alias("alpha")).filter("alpha is not null")
    return alpha.withColumn("abi", F.exp(-F.abs(F.col("alpha") - 1) / F.exp(F.lit(-2.0))))
