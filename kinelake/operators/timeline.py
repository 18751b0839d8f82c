"""Time: gaps, grids, resampling, trimming, block time stamps, day windows and local clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.operators.windows import KEY, ordered


def estimated_fs(df: DataFrame, lo: int = 0, hi: int = 5000, how: str = "mean") -> DataFrame:
    """recording_id, fs from time steps of samples lo to hi."""
    d = df.filter(F.col("sample_idx").between(lo, hi)).select(KEY, (F.col("t") - F.lag("t").over(ordered(df))).alias("dt")).filter("dt is not null")
    step = F.avg("dt") if how == "mean" else F.expr("percentile(dt, 0.5)")
    return d.groupBy(KEY).agg((1 / step).alias("fs"))


def gaps(df: DataFrame, longest: float) -> DataFrame:
    """Pairs of neighbouring samples more than `longest` seconds apart."""
    by = ordered(df)
    return df.select(KEY, F.lag("sample_idx").over(by).alias("before_idx"), F.col("sample_idx").alias("after_idx"), (F.col("t") - F.lag("t").over(by)).alias("gap")).filter(F.col("gap") > longest)


def segments(df: DataFrame, longest: float) -> DataFrame:
    """df with segment: a number that goes up after every gap."""
    by = ordered(df)
    new = F.when(F.col("t") - F.lag("t").over(by) > longest, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("segment", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def filled(df: DataFrame, step: float, fills: dict[str, float]) -> DataFrame:
    """Samples on the grid t0 + k step; a grid point takes the sample of its contiguous run, or the fill values.

    Within a run samples keep their spacing: they follow the run's first grid
    point one by one.
    """
    by, whole = ordered(df), Window.partitionBy(KEY)
    s = segments(df, 1.5 * step).withColumns({"_t0": F.min("t").over(whole), "_first": F.min("sample_idx").over(Window.partitionBy(KEY, "segment")), "_start": F.min("t").over(Window.partitionBy(KEY, "segment"))})
    s = s.withColumn("grid", (F.floor((F.col("_start") - F.col("_t0")) / step + 1e-6) + F.col("sample_idx") - F.col("_first")).cast("long"))
    s = s.groupBy(KEY, "grid").agg(*[F.min_by(c, "sample_idx").alias(c) for c in fills])
    ends = df.groupBy(KEY).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    grid = ends.select(KEY, "t0", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / step + 0.5).cast("long"))).alias("grid"))
    out = grid.join(s, [KEY, "grid"], "left")
    return out.select(KEY, F.col("grid").alias("sample_idx"), (F.col("t0") + F.col("grid") * step).alias("t"), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fills.items()])


def decimated(df: DataFrame, factor: int) -> DataFrame:
    """Every factor-th sample, numbered anew."""
    return df.filter(F.col("sample_idx") % factor == 0).withColumn("sample_idx", (F.col("sample_idx") / factor).cast("long"))


def interpolated(df: DataFrame, values: list[str], step: float) -> DataFrame:
    """Linear interpolation on the grid t0 + k step."""
    ends = df.groupBy(KEY).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    grid = ends.select(KEY, F.col("t0"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / step + 1e-9).cast("long"))).alias("k"))
    return interpolated_at(df, values, grid.select(KEY, F.col("k").alias("sample_idx"), (F.col("t0") + F.col("k") * step).alias("t")))


def interpolated_at(df: DataFrame, values: list[str], times: DataFrame) -> DataFrame:
    """Linear interpolation at times (recording_id, sample_idx, t), by one sort of samples and times together.

    Before the first and after the last sample their values hold.
    """
    points = times.select(KEY, "t", F.col("sample_idx").alias("k"), *[F.lit(None).cast("double").alias(v) for v in values], F.lit(None).cast("double").alias("_ts"))
    both = df.select(KEY, "t", F.lit(None).cast("long").alias("k"), *values, F.col("t").alias("_ts")).unionByName(points)
    by = Window.partitionBy(KEY).orderBy("t", F.col("k").asc_nulls_first())
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    near = {f"_{side}_{v}": f(v, ignorenulls=True).over(w) for v in [*values, "_ts"] for side, f, w in (("a", F.last, back), ("b", F.first, ahead))}
    out = both.withColumns(near).filter("k is not null")
    share = F.coalesce(F.try_divide(F.col("t") - F.col("_a__ts"), F.col("_b__ts") - F.col("_a__ts")), F.lit(0.0))
    between = lambda a, b: F.coalesce(a, b) + share * (F.coalesce(b, a) - F.coalesce(a, b))
    return out.select(KEY, F.col("k").alias("sample_idx"), "t", *[between(F.col(f"_a_{v}"), F.col(f"_b_{v}")).alias(v) for v in values])


def resampled(df: DataFrame, values: list[str], fs: float, goal: float, low_pass: bool = True) -> DataFrame:
    """Samples at `goal` Hz: every k-th where fs is a multiple, otherwise interpolated.

    Unless the rate goes up, a low-pass goes before, so that nothing above half
    the new rate folds back.
    """
    factor = fs / goal
    whole = float(factor).is_integer()
    if low_pass and factor >= 1:
        from kinelake.operators.kernels import low_passed

        df = low_passed(df, values, 0.8 / factor if whole else 1 / factor)
    return decimated(df, int(factor)).select(KEY, "sample_idx", "t", *values) if whole and factor > 1 else interpolated(df, values, 1 / goal)


def mapped_index(start_t: Column, t0: Column, fs: float) -> Column:
    """The place of a time on a resampled grid."""
    return F.rint((start_t - t0) * fs).cast("long")


def trimmed(df: DataFrame, start: Column, stop: Column) -> DataFrame:
    """From the last sample at or before start (else the first) to before the first at or after stop."""
    whole = Window.partitionBy(KEY)
    a = F.max(F.when(F.col("t") <= start, F.col("sample_idx"))).over(whole)
    b = F.min(F.when(F.col("t") >= stop, F.col("sample_idx"))).over(whole)
    cut = df.withColumns({"_a": a, "_b": b})
    return cut.filter((F.col("_a").isNull() | (F.col("sample_idx") >= F.col("_a"))) & (F.col("_b").isNull() | (F.col("sample_idx") < F.col("_b")))).drop("_a", "_b")


def trimmed_to_factor(df: DataFrame, seconds: int, within: int = 50_000) -> DataFrame:
    """Without the rows before the first whose whole second is a multiple of `seconds`."""
    hit = (F.floor("t") % seconds == 0) & (F.col("sample_idx") < within)
    first = F.min(F.when(hit, F.col("sample_idx"))).over(Window.partitionBy(KEY))
    return df.withColumn("_a", first).filter(F.col("_a").isNull() | (F.col("sample_idx") >= F.col("_a"))).drop("_a")


def without_repeated_times(df: DataFrame) -> DataFrame:
    """The first sample of each time, numbered anew."""
    by = Window.partitionBy(KEY, "t").orderBy("sample_idx")
    kept = df.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")
    return kept.withColumn("sample_idx", (F.row_number().over(Window.partitionBy(KEY).orderBy("t")) - 1).cast("long"))


def spread_blocks(df: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Samples that share a time stamp spread evenly over `seconds`."""
    same = Window.partitionBy(KEY, "t")
    place = F.row_number().over(same.orderBy("sample_idx")) - 1
    return df.withColumn("t", F.col("t") + place * seconds / F.count(F.lit(1)).over(same))


def concatenated(first: DataFrame, second: DataFrame, require_all: bool = False) -> DataFrame:
    """Successive recordings in order of time, numbered anew."""
    both = first.unionByName(second, allowMissingColumns=not require_all)
    return both.withColumn("sample_idx", (F.row_number().over(Window.partitionBy(KEY).orderBy("t")) - 1).cast("long"))


def combined(first: DataFrame, second: DataFrame, step: float, one: list[str], two: list[str], rates: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Streams of one period on a common grid, cut at the earlier end.

    A stream whose rate (Hz) is given is low-passed before it is thinned out.
    """

    def on_grid(df, values, fs):
        return interpolated(df, values, step) if fs is None else resampled(df, values, fs, 1 / step)

    return on_grid(first, one, rates[0]).join(on_grid(second, two, rates[1]).drop("t"), [KEY, "sample_idx"])


def local_date(t: Column, tz: str, base_hour: int = 0) -> Column:
    """Date in a time zone of seconds since 1970, days beginning at base_hour."""
    local = F.from_utc_timestamp(F.timestamp_seconds(t), tz)
    return F.to_date(local - F.make_dt_interval(hours=F.lit(base_hour)))


def day_windows(df: DataFrame, base: int = 0, period: int = 24, tz: str = "UTC") -> DataFrame:
    """recording_id, day_n, date, start_idx, stop_idx of wall-clock windows that begin at `base` and last `period` hours.

    Ends are the samples nearest to the window's ends; days of 23 and 25 hours
    come out as the clock has them.
    """
    if not (0 <= base <= 23 and 1 <= period <= 24):
        raise ValueError("base must lie in 0-23 and period in 1-24")
    ends = df.groupBy(KEY).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    days = ends.select(KEY, "t0", "t1", F.explode(F.sequence(local_date(F.col("t0"), tz, base), local_date(F.col("t1"), tz, base))).alias("date"))
    clock = lambda date, hour: F.unix_micros(F.to_utc_timestamp(date.cast("timestamp") + F.make_dt_interval(hours=F.lit(hour)), tz)) / 1e6
    lo = clock(F.col("date"), base)
    hi = clock(F.date_add("date", 1), base) if period == 24 else clock(F.col("date"), base + period) if base + period < 24 else clock(F.date_add("date", 1), base + period - 24)
    days = days.select(KEY, "date", F.greatest(lo, F.col("t0")).alias("lo"), F.least(hi, F.col("t1")).alias("hi")).filter("hi > lo")
    # nearest samples: ends and samples in one order, each end looks both ways
    points = days.select(KEY, "date", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lo").alias("t")), F.struct(F.lit(1).alias("end"), F.col("hi").alias("t")))).alias("p")).select(KEY, "date", "p.end", "p.t", F.lit(None).cast("long").alias("sample_idx"))
    both = df.select(KEY, F.lit(None).cast("date").alias("date"), F.lit(None).cast("int").alias("end"), "t", "sample_idx").unionByName(points)
    by = Window.partitionBy(KEY).orderBy("t", F.col("sample_idx").asc_nulls_last())
    pick = F.when(F.col("sample_idx").isNotNull(), F.struct("t", "sample_idx"))
    near = both.withColumns({"a": F.last(pick, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(pick, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))}).filter("date is not null")
    nearest = F.when(F.col("b").isNull() | (F.col("t") - F.col("a.t") <= F.col("b.t") - F.col("t")), F.col("a.sample_idx")).otherwise(F.col("b.sample_idx"))
    out = near.select(KEY, "date", "end", nearest.alias("at")).groupBy(KEY, "date").agg(F.max(F.when(F.col("end") == 0, F.col("at"))).alias("start_idx"), F.max(F.when(F.col("end") == 1, F.col("at"))).alias("stop_idx"))
    return out.withColumn("day_n", F.row_number().over(Window.partitionBy(KEY).orderBy("date")))
