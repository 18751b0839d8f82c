"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt to lanes by a hash of their identifier.  The number of rows that
each lane sends to each shard is drawn exactly as a uniform permutation of all
rows would have it: lane after lane, multivariate hypergeometric from what the
shards have left.  Each lane permutes its rows by a keyed hash and deals them
out by its row of the matrix; after the exchange each shard permutes again, in
blocks of bounded size, and numbers its rows.

The driver holds lanes x shards counts, never rows.

Defined results: row counts of shards differ by at most one (the first shards
are larger).  Null text has size 1 and checksum 0.  Rows with null or repeated
identifiers take part like all others; fully equal rows are interchangeable.
Equal texts are not kept together.  An empty table gives an empty result.
Extra columns pass through; `shard` and `slot` replace columns of those names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm.common import table

SHARDS, SEED = 16, 7


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """Good ones among `draws` without replacement; exact for counts of any size.

    Inverts the distribution around its mode, over a range whose complement has
    a probability under 1e-25.
    """
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo >= hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = 60 + int(12 * math.sqrt(max(draws * share * (1 - share) * (total - draws) / max(total - 1, 1), 1)))
    first, last = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return first + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows that each lane sends to each shard; row and column sums are as given."""
    rng, left = np.random.default_rng(seed), list(shards)
    out = np.zeros((len(rows), len(shards)), np.int64)
    for p, n in enumerate(rows):
        pool, want = sum(left), n
        for s, room in enumerate(left):
            take = hypergeometric(room, pool - room, want, rng)
            out[p, s], left[s] = take, room - take
            pool, want = pool - room, want - take
    return out


def _key(seed: int, salt: str) -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit(f"{salt}{seed}"))


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with shard (from 0) and slot (place within the shard, gapless from 0)."""
    spark = docs.sparkSession
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(lanes / shards))
    rows = docs.drop("shard", "slot").withColumn("_lane", F.pmod(_key(seed, "lane"), F.lit(lanes)).cast("int"))
    found = dict(rows.groupBy("_lane").count().collect())
    counts = [found.get(p, 0) for p in range(lanes)]
    total = sum(counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    sent = np.cumsum(communication_matrix(counts, sizes, seed), axis=1)
    bounds = spark.createDataFrame([(p, [int(x) for x in sent[p]]) for p in range(lanes)], "_lane int, _sent array<bigint>")
    local = Window.partitionBy("_lane").orderBy(_key(seed, "first"), "doc_id")
    dealt = (
        rows.withColumn("_rank", F.row_number().over(local))
        .join(F.broadcast(bounds), "_lane")
        .withColumn("shard", F.expr("size(filter(_sent, x -> x < _rank))").cast("int"))
        .withColumn("_second", _key(seed, "second"))
        .withColumn("_block", F.pmod("_second", F.lit(blocks)).cast("int"))
        .drop("_lane", "_rank", "_sent")
    )
    filled = dealt.groupBy("shard", "_block").count()
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_block").orderBy("_second", "doc_id")
    # shards x blocks offsets, about one for each partition
    return (
        dealt.withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "_block"])
        .withColumn("slot", F.col("_offset") + F.col("_rank") - 1)
        .drop("_block", "_second", "_offset", "_rank")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_into_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
