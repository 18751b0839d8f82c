"""A corpus pipeline: toxicity, exact copies, near copies, mixing of sources, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  Nulls, empty texts, repeated rows and empty
tables are treated as the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import byte_bpe, exact_dedup, minhash_dedup, mixing, toxicity
from kinelake.llm.common import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from all labelled ones, is under one half."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest identifier."""
    return exact_dedup.without_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the smallest identifier."""
    return minhash_dedup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have tempered shares."""
    return mixing.mix(docs).filter("sampled").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs, byte_bpe.default_vocabulary())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix_sources), ("byte_bpe", encode)]

#: SQL can't express the toxicity stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
