"""Document quality by a factorisation machine.

A document's features are its words, hashed into WORD_BINS bins with a damped
and normalised count; statistics of its structure; and its metadata (n_chars).
The model has a bias, a weight for each feature and a vector of FACTORS numbers
for each feature, whose inner products weigh pairs of features.  All pairs are
scored in linear time, since
    sum over i < j of <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.

It is fitted by minibatches with adaptive steps on at most TRAIN_ROWS labelled
documents, taken by a hash of the identifier; scoring covers all rows and whole
texts.  Parameters have a fixed size and are broadcast.

Labels, language, source and identifier are no inputs of a score.  Defined
results: null text is empty; null or missing n_chars counts as absent; documents
labelled twice take the larger label; with labels of one class only (or none)
every score is their share (0.5); null identifiers are scored, not learned from;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm.common import in_small_batches, packed, pieces, table
from kinelake.llm.labelled import remainder, with_label
from kinelake.llm.textkernels import mix, word_hashes

WORD_BINS, FACTORS = 1 << 16, 8
TRAIN_ROWS, EPOCHS, BATCH, RATE, RIDGE, SEED = 12_000, 8, 128, 0.05, 1e-4, 5
STEP = 1 << 20

_KINDS = np.zeros(256, np.int64)  # 0 letter or other, 1 space, 2 digit, 3 upper case, 4 sentence mark, 5 other mark, 6 beyond ASCII
for _c in range(256):
    _KINDS[_c] = 1 if _c in (32, *range(9, 14)) else 2 if 48 <= _c < 58 else 3 if 65 <= _c < 91 else 4 if chr(_c) in ".,;:!?'\"-" else 5 if 33 <= _c < 127 and not chr(_c).isalnum() else 6 if _c > 126 else 0
#: Statistics of structure, and of metadata.
STATS = ("bytes", "words", "word_length", "space", "digit", "upper", "sentence_mark", "other_mark", "beyond_ascii", "lines", "line_length", "repeated_lines", "distinct_words", "longest_word", "short_words", "marked_words", "last_mark", "has_chars", "chars")


def features(body: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word features (row, bin, value, ordered by row) and the matrix of statistics.

    n_chars: NaN where absent.
    """
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    of_byte = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(of_byte * 7 + _KINDS[body], minlength=7 * n).reshape(n, 7)
    row, h, begin, end = word_hashes(body, offsets)
    words = np.bincount(row, minlength=n).astype(float)
    length = (end - begin).astype(float)
    some = np.maximum(words, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    mark = _KINDS[body[end - 1]] == 5 if len(end) else np.zeros(0, bool)
    inside = np.zeros(len(body) + 1, np.int64)
    np.cumsum(_KINDS[body] == 5, out=inside[1:])
    marked = (inside[end] - inside[begin] > 0) if len(end) else np.zeros(0, bool)
    # lines: words' hashes added up between line ends
    breaks = np.concatenate([[0], np.cumsum(body == 10)])
    line = breaks[begin] if len(begin) else np.zeros(0, np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    heads = np.flatnonzero(new)
    lines = np.bincount(row[heads], minlength=n).astype(float)
    whole = np.add.reduceat(mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(0)), heads) if len(heads) else np.zeros(0, np.uint64)
    by = np.lexsort((whole, row[heads]))
    same = (whole[by][1:] == whole[by][:-1]) & (row[heads][by][1:] == row[heads][by][:-1])
    repeated = np.bincount(row[heads][by][1:][same], minlength=n) if len(heads) > 1 else np.zeros(n)
    bin_of = (h >> np.uint64(48)).astype(np.int64)
    key, count = np.unique(row * np.int64(WORD_BINS) + bin_of, return_counts=True)
    rows, bins, value = key // WORD_BINS, key % WORD_BINS, np.log1p(count)
    norm = np.sqrt(np.bincount(rows, value**2, n))
    value = value / np.maximum(norm[rows], 1e-12)
    distinct = np.bincount(rows, minlength=n)
    share = lambda x: x / np.maximum(size, 1)
    chars = np.where(np.isnan(n_chars), 0, n_chars)
    stats = np.stack([
        np.log1p(size), np.log1p(words), np.bincount(row, length, n) / some, share(kinds[:, 1]), share(kinds[:, 2]), share(kinds[:, 3]), share(kinds[:, 4]), share(kinds[:, 5]), share(kinds[:, 6]),
        np.log1p(lines), np.log1p(words / np.maximum(lines, 1)), repeated / np.maximum(lines, 1), distinct / some, np.log1p(longest), np.bincount(row, length <= 2, n) / some,
        np.bincount(row, marked, n) / some, np.bincount(row, mark, n) / some, (~np.isnan(n_chars)).astype(float), np.log1p(np.maximum(chars, 0)),
    ], axis=1)
    return rows, bins, value, stats


@dataclass
class Machine:
    """Features 0 to WORD_BINS - 1 are words, the rest standardised statistics."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    fallback: float | None = None

    def inputs(self, rows, bins, value, stats):
        """The features of documents as (row, feature, value), ordered by row, and their begins."""
        n, k = stats.shape
        z = np.clip((stats - self.middle) / self.spread, -5, 5) / np.sqrt(k)
        row = np.concatenate([rows, np.repeat(np.arange(n), k)])
        feature = np.concatenate([bins, np.tile(WORD_BINS + np.arange(k), n)])
        x = np.concatenate([value, z.ravel()])
        by = np.argsort(row, kind="stable")
        row = row[by]
        return row, feature[by], x[by], np.searchsorted(row, np.arange(n))

    def margin(self, row, feature, x, begins):
        """Log-odds, and the sums of vectors that gradients need."""
        if not len(begins):
            return np.zeros(0), np.zeros((0, FACTORS))
        vx = self.vectors[feature] * x[:, None]
        sums = np.add.reduceat(vx, begins, axis=0)
        pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), begins))
        return self.bias + np.add.reduceat(self.weights[feature] * x, begins) + pairs, sums

    def score(self, rows, bins, value, stats) -> np.ndarray:
        if self.fallback is not None:
            return np.full(len(stats), self.fallback)
        z, _ = self.margin(*self.inputs(rows, bins, value, stats))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_machine(words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """words: bins and values of each document."""
    rng = np.random.default_rng(seed)
    size = WORD_BINS + stats.shape[1]
    middle = stats.mean(axis=0) if len(stats) else np.zeros(stats.shape[1])
    machine = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), middle, np.maximum(stats.std(axis=0), 1e-6) if len(stats) else np.ones(stats.shape[1]))
    if not len(y) or y.min() == y.max():
        machine.fallback = float(y.mean()) if len(y) else 0.5
        return machine
    machine.bias = float(np.log(y.mean() / (1 - y.mean())))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            rows = np.repeat(np.arange(len(pick)), [len(words[i][0]) for i in pick])
            row, feature, x, begins = machine.inputs(rows, np.concatenate([words[i][0] for i in pick]), np.concatenate([words[i][1] for i in pick]), stats[pick])
            z, sums = machine.margin(row, feature, x, begins)
            slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) / len(pick)
            used, which = np.unique(feature, return_inverse=True)
            gx = slope[row] * x
            gw = np.bincount(which, gx, len(used)) + RIDGE / len(pick) * machine.weights[used]
            each = gx[:, None] * (sums[row] - machine.vectors[feature] * x[:, None])
            gv = np.stack([np.bincount(which, each[:, f], len(used)) for f in range(FACTORS)], axis=1) + RIDGE / len(pick) * machine.vectors[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_b += slope.sum() ** 2
            machine.weights[used] -= 2 * RATE * gw / np.sqrt(seen_w[used])
            machine.vectors[used] -= RATE * gv / np.sqrt(seen_v[used])
            machine.bias -= RATE * slope.sum() / np.sqrt(seen_b)
    return machine


def _steps(batch):
    body, offsets = packed(batch.column("text"))
    chars = batch.column("n_chars").cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    for lo, hi in pieces(offsets, STEP):
        yield lo, hi, features(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], chars[lo:hi])


def _with_chars(docs: DataFrame) -> DataFrame:
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, train_rows: int = TRAIN_ROWS) -> Machine:
    """Learns from at most train_rows labelled rows that satisfy train (on doc_id of labels)."""

    def run(batches):
        for batch in batches:
            y = batch.column("y").to_numpy()
            for lo, hi, (rows, bins, value, stats) in _steps(batch):
                cuts = np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.record_batch({
                    "y": pa.array(y[lo:hi].astype(np.int32)),
                    "bins": pa.ListArray.from_arrays(pa.array(cuts), pa.array(bins.astype(np.int32))),
                    "vals": pa.ListArray.from_arrays(pa.array(cuts), pa.array(value)),
                    "stats": pa.array(stats.tolist(), pa.list_(pa.float64())),
                })

    chosen = labels.filter(train & F.col("quality").isin(0, 1)).orderBy(F.xxhash64("doc_id")).limit(train_rows)
    rows = with_label(_with_chars(docs), chosen, "quality", F.lit(True))
    # no more than a few times train_rows, were identifiers repeated
    got = rows.select("text", "n_chars", "y").mapInArrow(run, "y int, bins array<int>, vals array<double>, stats array<double>").limit(2 * train_rows).toArrow()
    y = got["y"].to_numpy().astype(float)
    stats = np.array(got["stats"].to_pylist(), float).reshape(len(y), len(STATS))
    order = np.lexsort((*stats.T, y))  # rows come in any order
    words = [(np.asarray(b.values, np.int64), np.asarray(v.values)) for b, v in zip(got["bins"], got["vals"], strict=True)]
    return fit_machine([words[i] for i in order], stats[order], y[order])


def quality_scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1, higher: better)."""
    known = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            for lo, hi, found in _steps(batch):
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "score": pa.array(known.value.score(*found))})

    rows = in_small_batches(_with_chars(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("double").alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_scores(docs, fit(docs, labels, remainder(F.col("doc_id"), 4) != 2))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
