"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt to *lanes* by a hash.  A lane's run is its distinct digests in
order, each with the identifier that stays and its count.  In each round the
lanes that differ in one digit of their number exchange runs: every entry moves
to the lane whose digit is that of its digest, and the lane merges the `fan`
runs it receives.  A round of fan 4 is two binomial steps taken at once.
After log_fan(lanes) rounds each lane holds a share of the digests, fully
merged; no lane ever holds more than its share of distinct digests, and a text
that is everywhere is one entry of each run.  Verdicts return by lane and
digest, so a common text's rows are spread over all lanes there too.

An entry is identified by SHA-256, length in bytes and a second hash of the
normalised text; entries merge only where all three agree.

Defined results: null text is empty.  Texts are equal when identical after
lower-casing A-Z.  A null identifier never stays while the group has another;
a group of null identifiers only has keep_id null and all its rows stay.  Rows
repeated with the identifier that stays are all marked as staying.  An empty
table gives an empty result.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm.common import LOWER, UPPER, checkpointed, folded, table

FAN = 4
_ENTRY = ("sha", "n_bytes", "check")


def _rounds(spark: SparkSession, fan: int) -> int:
    return max(1, int(math.log(int(spark.conf.get("spark.sql.shuffle.partitions")), fan)))


def exact_duplicates(docs: DataFrame, keep: str = "max", fan: int = FAN) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "max" or "min", which identifier of equal texts stays.
    """
    spark, best = docs.sparkSession, {"max": F.max, "min": F.min}[keep]
    rounds = _rounds(spark, fan)
    lanes = fan**rounds
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), folded(F.coalesce("text", F.lit(""))).alias("t"))
    rows = text.select("doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("check"))
    # texts are read and hashed once; what follows moves digests only
    rows = checkpointed(rows.withColumn("lane", F.pmod(F.xxhash64("doc_id", "check"), F.lit(lanes)).cast("int")))
    runs = rows.groupBy("lane", *_ENTRY).agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged, target = runs.withColumnRenamed("lane", "slot"), F.pmod("check", F.lit(lanes)).cast("int")
    for r in range(rounds):
        unit = fan**r
        digit = lambda c: F.pmod(F.floor(c / F.lit(unit)), F.lit(fan)).cast("int")  # noqa: B023, E731
        moved = merged.withColumn("slot", F.col("slot") + (digit(target) - digit(F.col("slot"))) * F.lit(unit))
        run = moved.repartition(lanes, "slot").sortWithinPartitions("slot", *_ENTRY)
        merged = run.groupBy("slot", *_ENTRY).agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    verdicts = merged.select(*_ENTRY, "keep_id", F.col("n").alias("group_size"))
    by_lane = runs.select("lane", *_ENTRY).join(verdicts, list(_ENTRY))
    out = rows.join(by_lane, ["lane", *_ENTRY])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_exact_duplicates(docs: DataFrame, keep: str = "max", fan: int = FAN) -> DataFrame:
    """One row of docs for each text, columns as they are; of rows repeated with the identifier that stays, any one."""
    stay = exact_duplicates(docs, keep, fan).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.withColumn("_own", F.sha2(folded(F.coalesce("text", F.lit(""))), 256))
    kept = rows.join(stay, F.col("_own").eqNullSafe(F.col("_sha")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    first = Window.partitionBy("_own", "doc_id").orderBy(F.lit(0))
    return kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
), g AS (
    SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
