"""Joining documents with labels, and splitting by the checksum of the identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import in_small_batches

#: Label rows that may be broadcast (about 20 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the identifier as text, modulo divisor; null for a null identifier."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % F.lit(divisor)).cast("int")


def with_label(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """doc_id, text, n_chars and y (0 or 1) of the documents whose labels satisfy keep.

    A document labelled more than once takes its largest label.
    """
    known = labels.filter(keep & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    columns = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    return in_small_batches(docs).select(*columns).join(known, "doc_id")
