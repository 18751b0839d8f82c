"""Approximate nearest neighbours by a forest of hash prefixes (LSH forest).

Vectors are dealt by a hash of their identifier into blocks of bounded size.
In a block each of TREES trees is the sorted array of the vectors' hash strings:
DEPTH bits, each telling on which side of a hyperplane through the block's
median a vector lies.  A query descends every tree to its longest matching
prefix by binary search, then all trees ascend together, one bit at a time,
until they offer SHARE times the block's vectors as candidates (with
repetitions), and one tree offers twice the neighbours asked for; these are scored exactly and the best of all blocks are merged.

The number of candidates follows the block at every size.  On vectors that lie
almost evenly in all directions, as in the test tables, prefixes tell little, so
SHARE is high; tests hold the result against brute force.

Queries are a stated set and meet the vectors block by block, never as a join of
all pairs.  Defined results: vectors that are null, zero or hold null or
non-finite components take no part; only vectors of equal length are compared;
candidates with the query's own identifier are left out; rows repeated are
candidates each; a null identifier is never a query and comes last among ties.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm.common import NO_ID, gathered, ids, table

TREES, DEPTH, SHARE, SEED = 192, 24, 1.0, 11
#: Vectors and queries in a block; a forest is built once for all queries of its block of queries.
BLOCK, QUERIES = 8192, 8192


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Single precision for hashing, every component within 1 by one factor for each row."""
    return (vectors / np.abs(vectors).max(axis=1, keepdims=True)).astype(np.float32)


class Forest:
    """Sorted hash strings of the rows of a matrix, for each tree."""

    def __init__(self, vectors: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng([seed, vectors.shape[1]])
        self.planes = rng.standard_normal((trees, vectors.shape[1], depth), np.float32)
        vectors = _scaled(vectors)
        self.depth, self.weights = depth, np.int64(1) << np.arange(depth - 1, -1, -1, dtype=np.int64)
        self.middle, self.order, self.codes = [], [], []
        for plane in self.planes:
            side = vectors @ plane
            middle = np.median(side, axis=0)
            code = (side > middle) @ self.weights
            order = np.argsort(code, kind="stable")
            self.middle.append(middle)
            self.order.append(order)
            self.codes.append(code[order])
        self.all = np.concatenate(self.order)
        self.size = len(vectors)

    def candidates(self, queries: np.ndarray, share: float, least: int):
        """For each query, the rows that the trees offer once they have ascended far enough."""
        trees, wanted, queries = len(self.codes), share * self.size, _scaled(queries)
        code = np.stack([(queries @ p > m) @ self.weights for p, m in zip(self.planes, self.middle, strict=True)])
        begin, end = np.zeros((trees, len(queries)), np.int64), np.full((trees, len(queries)), self.size)
        open_ = np.arange(len(queries))
        for length in range(self.depth, -1, -1):
            rest = (np.int64(1) << np.int64(self.depth - length)) - 1
            low = code[:, open_] & ~rest
            for t in range(trees):
                begin[t, open_] = np.searchsorted(self.codes[t], low[t])
                end[t, open_] = np.searchsorted(self.codes[t], low[t] | rest, "right")
            offered = (end - begin)[:, open_]
            open_ = open_[(offered.sum(axis=0) < wanted) | (offered.max(axis=0) < min(least, self.size))]
            if not len(open_):
                break
        base = np.arange(trees) * self.size
        for i in range(len(queries)):
            spans = np.stack([begin[:, i] + base, end[:, i] + base], 1).ravel()
            rows, _ = gathered(self.all, spans, 2 * np.arange(trees))
            met = np.zeros(self.size, bool)
            met[rows] = True
            yield np.flatnonzero(met)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, trees: int = TREES, depth: int = DEPTH, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by inner product.

    vectors and queries: vec_id, embedding.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding")))
    data, asked = clean(vectors), clean(queries)
    blocks, parts = max(1, math.ceil(data.count() / BLOCK)), max(1, math.ceil(asked.count() / QUERIES))
    own = F.pmod(F.xxhash64(F.coalesce("vec_id", F.lit(NO_ID)), "embedding"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = data.select("vec_id", "embedding", F.size("embedding").alias("dim"), own.alias("block")).withColumn("part", each(parts))
    asked = asked.select("vec_id", "embedding", F.size("embedding").alias("dim"), part.alias("part")).withColumn("block", each(blocks))

    def search(key, left, right):
        if not left.num_rows or not right.num_rows:
            return _RESULT.empty_table()
        dim = key[0].as_py()
        names, x = ids(left["vec_id"]), _matrix(left["embedding"], dim)
        by = np.argsort(names, kind="stable")
        names, x = names[by], x[by]
        who, q = ids(right["vec_id"]), _matrix(right["embedding"], dim)
        out_q, out_v, out_s = [], [], []
        for i, rows in enumerate(Forest(x, trees, depth, seed).candidates(q, share, 2 * k)):
            rows = rows[names[rows] != who[i]]
            score = x[rows] @ q[i]
            best = np.lexsort((rows, -score))[:k] if len(rows) <= 4 * k else _best(rows, score, k)
            out_q.append(np.full(len(best), who[i]))
            out_v.append(names[rows[best]])
            out_s.append(score[best])
        v = np.concatenate(out_v)
        return pa.Table.from_arrays([pa.array(np.concatenate(out_q)), pa.array(v, mask=v == NO_ID), pa.array(np.concatenate(out_s))], schema=_RESULT)

    on = ["dim", "block", "part"]
    found = data.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k best by score, ties to the earlier row."""
    edge = np.partition(score, len(score) - k)[len(score) - k]
    kept = np.flatnonzero(score >= edge)
    return kept[np.lexsort((rows[kept], -score[kept]))][:k]


def brute_force(names: np.ndarray, x: np.ndarray, query_id: int, query: np.ndarray, k: int) -> list[int]:
    other = names != query_id
    score = x[other] @ query
    return names[other][np.lexsort((names[other], -score))[:k]].tolist()


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)
