"""Epochs and bouts over streams of samples (recording_id, ts, ax, ay, az)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions.axes import enmo, magnitude


def epoch_stream(samples: DataFrame, length: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Mean magnitude and ENMO of tumbling windows; samples later than `late` are left out."""
    out = samples.withWatermark("ts", late).groupBy("recording_id", F.window("ts", length).alias("w"))
    out = out.agg(F.avg(magnitude()).alias("en"), F.avg(enmo()).alias("enmo"), F.count(F.lit(1)).alias("samples"))
    return out.select("recording_id", F.col("w.start").alias("start"), "en", "enmo", "samples")


def moving_stream(samples: DataFrame, length: str, step: str, late: str = "1 minute") -> DataFrame:
    """Statistics of sliding windows of the magnitude."""
    out = samples.withWatermark("ts", late).groupBy("recording_id", F.window("ts", length, step).alias("w"))
    return out.agg(F.avg(magnitude()).alias("mean"), F.max(magnitude()).alias("max"), F.min(magnitude()).alias("min")).select("recording_id", F.col("w.start").alias("start"), "mean", "max", "min")


def bout_stream(samples: DataFrame, gap: str = "10 seconds", threshold: float = 0.1, late: str = "1 minute") -> DataFrame:
    """Bouts of samples over the threshold, joined over gaps shorter than `gap`."""
    active = samples.withWatermark("ts", late).filter(enmo() > threshold)
    out = active.groupBy("recording_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("samples"))
    return out.select("recording_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "samples")
