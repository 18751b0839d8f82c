"""Connected components over DataFrames: smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """Columns v, label (smallest vertex reachable) for all vertices of links (a, b).

    Each sweep gives a vertex the smallest label among its own and its
    neighbours', then that label's label; sweeps end when none changes.  Long
    chains shrink by halves.  Sums are combined before they are shuffled, so a
    vertex with very many links is no single task's work.
    """
    ends = links.select(F.col("a").alias("v"), F.col("b").alias("w"))
    both = checkpointed(ends.union(ends.select("w", "v")).distinct())
    labels = checkpointed(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("near"))
        least = labels.join(near, "v").select("v", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("far"))
        moved = checkpointed(least.join(jump, "next").select("v", F.least("next", "far").alias("label"), "old"))
        done = moved.filter("label <> old").limit(1).count() == 0
        labels = moved.select("v", "label")
        if done:
            return labels
