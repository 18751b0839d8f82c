"""Signals that the registered queries run over, made from the shared test tables.

series: events of a user in time order.  triax: line items of a supplier as
three axes.  windows: the components of an embedding.  strides: events as
contacts of a walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), (F.row_number().over(by) - 1).cast("long").alias("sample_idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("x"))


def triax(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("recording_id"), (F.row_number().over(by) - 1).cast("long").alias("sample_idx"),
        ((F.col("l_quantity") - 25) / 25).alias("ax"), ((F.col("l_discount") - 0.05) * 20).alias("ay"), ((F.col("l_tax") - 0.04) * 20).alias("az"),
        (20 + F.col("l_quantity") / 5).alias("temperature"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.col("x").cast("double").alias("x"))


def states(spark: SparkSession, sf_dir: str, threshold: float = 50.0) -> DataFrame:
    return series(spark, sf_dir).select("recording_id", "sample_idx", F.when(F.col("x") > threshold, 1).otherwise(0).alias("state"))


def strides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts at 50 Hz: steps of 25 to 34 samples, walks of up to ten contacts."""
    n, place = F.col("sample_idx"), F.col("sample_idx") % 10
    whole = Window.partitionBy("recording_id")
    s = series(spark, sf_dir).withColumn("k", F.pmod(F.floor(F.col("x") * 100), F.lit(10)).cast("long")).withColumn("last", F.max("sample_idx").over(whole))
    ends = F.least(F.lit(9) - place, F.col("last") - n)
    return s.select(
        "recording_id", F.lit(1).alias("day_n"), (F.floor(n / 10) + 1).cast("long").alias("bout_n"), n.alias("stride_idx"),
        (n * 30 + F.col("k") % 5).alias("ic"), (n * 30 + 37 + F.col("k") % 4).alias("fc"), (n * 30 + 7 + F.col("k") % 3).alias("fc_opp"),
        F.least(ends, F.lit(2)).cast("long").alias("forward_cycles"),
        (0.02 + F.col("k") / 1000).alias("h1"), (0.018 + F.col("k") / 1000).alias("h2"), F.lit(0.004).alias("h2b"),
        (0.5 + F.col("k") / 30).alias("step_regularity"), (0.6 + F.col("k") / 40).alias("stride_regularity"),
    )


SERIES = "series AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, epoch(ts) AS t, value AS x FROM events)"
TRIAX = """triax AS (SELECT l_suppkey AS recording_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS sample_idx,
    (l_quantity - 25) / 25 AS ax, (l_discount - 0.05) * 20 AS ay, (l_tax - 0.04) * 20 AS az, 20 + l_quantity / 5 AS temperature FROM lineitem)"""
WINDOWS = "windows AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
STATES = SERIES + ", states AS (SELECT recording_id, sample_idx, CASE WHEN x > 50 THEN 1 ELSE 0 END AS state FROM series)"
RUNS = STATES + """, marked AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY recording_id ORDER BY sample_idx) THEN 0 ELSE 1 END AS new FROM states),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marked),
    runs AS (SELECT recording_id, run, min(state) AS state, min(sample_idx) AS start_idx, max(sample_idx) + 1 AS stop_idx, count(*) AS length FROM numbered GROUP BY recording_id, run)"""
STRIDES = SERIES + """, s0 AS (SELECT *, CAST(floor(x * 100) AS BIGINT) % 10 AS k, max(sample_idx) OVER (PARTITION BY recording_id) AS last FROM series),
    strides AS (SELECT recording_id, 1 AS day_n, sample_idx // 10 + 1 AS bout_n, sample_idx AS stride_idx, sample_idx * 30 + k % 5 AS ic, sample_idx * 30 + 37 + k % 4 AS fc, sample_idx * 30 + 7 + k % 3 AS fc_opp,
        least(9 - sample_idx % 10, last - sample_idx, 2) AS forward_cycles, 0.02 + k / 1000.0 AS h1, 0.018 + k / 1000.0 AS h2, 0.004 AS h2b, 0.5 + k / 30.0 AS step_regularity, 0.6 + k / 40.0 AS stride_regularity FROM s0)"""
