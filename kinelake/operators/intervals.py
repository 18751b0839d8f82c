"""Runs, intervals and their algebra, all as window expressions.

Intervals are rows (recording_id, start_idx, stop_idx), half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.operators.windows import KEY, ordered


def _by_start():
    return Window.partitionBy(KEY).orderBy("start_idx", "stop_idx")


def runs(df: DataFrame, state: str) -> DataFrame:
    """Run lengths: recording_id, run, state, start_idx, stop_idx, length."""
    by = ordered(df)
    new = F.when(F.col(state).eqNullSafe(F.lag(state).over(by)) & F.lag(F.lit(1)).over(by).isNotNull(), 0).otherwise(1)
    marked = df.select(KEY, "sample_idx", F.col(state).alias("state"), new.alias("_new"))
    marked = marked.withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(KEY, "run").agg(F.first("state").alias("state"), F.min("sample_idx").alias("start_idx"), (F.max("sample_idx") + 1).alias("stop_idx"))
    return out.withColumn("length", F.col("stop_idx") - F.col("start_idx"))


def united(df: DataFrame, gap: int = 0) -> DataFrame:
    """Overlapping intervals, and those at most `gap` apart, as one."""
    reach = F.max("stop_idx").over(_by_start().rowsBetween(Window.unboundedPreceding, -1))
    marked = df.filter("stop_idx > start_idx").withColumn("_new", F.when(F.col("start_idx") <= reach + gap, 0).otherwise(1))
    marked = marked.withColumn("_g", F.sum("_new").over(_by_start().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(KEY, "_g").agg(F.min("start_idx").alias("start_idx"), F.max("stop_idx").alias("stop_idx")).drop("_g")


def inverted(df: DataFrame, spans: DataFrame) -> DataFrame:
    """What of spans (recording_id, lo, hi) no interval covers."""
    cut = united(df).join(spans, KEY).select(KEY, F.greatest("start_idx", "lo").alias("start_idx"), F.least("stop_idx", "hi").alias("stop_idx")).filter("stop_idx > start_idx")
    edges = spans.select(KEY, F.col("lo").alias("start_idx"), F.col("lo").alias("stop_idx")).union(spans.select(KEY, F.col("hi").alias("start_idx"), F.col("hi").alias("stop_idx")))
    rows = cut.union(edges).withColumn("_next", F.lead("start_idx").over(_by_start()))
    return rows.filter("_next > stop_idx").select(KEY, F.col("stop_idx").alias("start_idx"), F.col("_next").alias("stop_idx"))


def intersection(spans: DataFrame, included: list[DataFrame], excluded: list[DataFrame]) -> DataFrame:
    """Within each span, what every one of `included` covers and none of `excluded` does.

    Complements of the included sets and the excluded sets are united; what they
    leave of the span is the answer.
    """
    blocks = [inverted(i, spans) for i in included] + [e.select(KEY, "start_idx", "stop_idx") for e in excluded]
    if not blocks:
        return spans.select(KEY, F.col("lo").alias("start_idx"), F.col("hi").alias("stop_idx"))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return inverted(out, spans)


def merged_bouts(df: DataFrame, gap: int, least: int) -> DataFrame:
    """Bouts less than `gap` apart joined; those longer than `least` stay."""
    return united(df, gap - 1).filter(F.col("stop_idx") - F.col("start_idx") > least)


def drop_short(df: DataFrame, state: str, least: int, value, replacement, keep_ends: bool = True) -> DataFrame:
    """The state series with runs of `value` shorter than `least` replaced; runs at the ends stay if asked."""
    whole = Window.partitionBy(KEY)
    r = runs(df, state).withColumn("_last", F.max("run").over(whole))
    short = (F.col("state") == F.lit(value)) & (F.col("length") < least)
    if keep_ends:
        short = short & (F.col("run") > 1) & (F.col("run") < F.col("_last"))
    r = r.withColumn("new_state", F.when(short, F.lit(replacement)).otherwise(F.col("state")))
    return r.select(KEY, F.explode(F.sequence("start_idx", F.col("stop_idx") - 1)).alias("sample_idx"), "new_state")


def longest(df: DataFrame, state: str, value) -> DataFrame:
    """The longest run of `value`, the first of equals."""
    best = F.max_by(F.struct("start_idx", "stop_idx", "length"), F.struct("length", -F.col("start_idx")))
    return runs(df, state).filter(F.col("state") == F.lit(value)).groupBy(KEY).agg(best.alias("b")).select(KEY, "b.*")


def overlaps(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    return (a_start < b_stop) & (b_start < a_stop)
