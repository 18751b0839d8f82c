"""Toxic passages by maximum-scoring segments, with extreme-value calibration.

1. Counts.  Of labelled training documents (equal texts once), each distinct
   word counts once for toxic or clean in a table of SLOTS hashed slots, and its
   prefix in another.  Both tables have a fixed size; counts of all tasks are
   added in a tree.
2. Log-odds with Dirichlet priors.  A prefix's toxic share is drawn to the share
   of all words, a word's to its prefix's, with PRIOR pseudo-counts each; a
   token scores the log-odds of its share against that of all words, less DRIFT.
   Inflected and unseen words so inherit what their stem tells.
3. Segments.  One pass over a document's tokens finds all maximal-scoring
   segments; only positive tokens cost a step.
4. Extreme values.  The best score of clean text of n tokens follows a Gumbel
   law, P(S >= x) ~ K n exp(-lambda x); lambda and K are fitted on clean
   documents that were not counted before.  A segment is significant if its expected
   number in clean text is under SIGNIFICANT.  A logistic fit on documents that
   were not counted turns the excess of the best segment and the number of
   significant ones into a probability.  At most CALIBRATION_ROWS of them, taken
   by a hash of the identifier, are used for both fits.  Then all labelled
   training documents are counted anew, and these counts score.

Labels, language, source and identifier are no inputs of a score.  Defined
results: null text is empty and scores what no evidence scores; documents
labelled twice take the larger label; without labels of both classes nothing
tells documents apart and every score is 0; null identifiers are scored, not
learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm.common import BRIEF, expand, in_small_batches, packed, pieces, squeeze, table, tidied
from kinelake.llm.labelled import remainder, with_label
from kinelake.llm.textkernels import _FOLD, mix, word_hashes

SLOTS, PREFIX_SLOTS, PREFIX = 1 << 20, 1 << 18, 5
PRIOR, DRIFT, SIGNIFICANT = 4.0, 1.5, 0.01
CALIBRATION_ROWS = 50_000
#: Parts of the count tables that are added apart, and partial sums of each.
PARTS, PARTIAL = 16, 64
STEP = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in string.punctuation]] = True


def tokens(body: np.ndarray, offsets: np.ndarray):
    """Row, word slot, prefix slot, first byte and end of all tokens."""
    row, h, begin, end = word_hashes(body, offsets, _BLANK)
    prefix = np.zeros(len(row), np.uint64)
    padded = np.concatenate([_FOLD[body], np.zeros(PREFIX, np.uint8)])
    for k in range(PREFIX):
        prefix = (prefix << np.uint64(8)) | np.where(begin + k < end, padded[begin + k], 0).astype(np.uint64)
    slot = lambda x, n: (x >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)
    return row, slot(h, SLOTS), slot(mix(prefix + np.uint64(1)), PREFIX_SLOTS), begin, end


def _steps(batch):
    body, offsets = packed(batch.column("text"))
    for lo, hi in pieces(offsets, STEP):
        yield lo, hi, body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def count_tables(rows: DataFrame) -> np.ndarray:
    """Documents with each slot (words, then prefixes): column 0 clean, 1 toxic; and the documents of each class in the last row."""
    size = SLOTS + PREFIX_SLOTS

    def count(batches):
        total = np.zeros((size, 2), np.int32)
        docs = np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            for lo, hi, body, offsets in _steps(batch):
                row, word, prefix, _, _ = tokens(body, offsets)
                for slot, base in ((word, 0), (prefix, SLOTS)):
                    once = np.unique(row * np.int64(size) + slot)
                    np.add.at(total, (once % size + base, y[lo + once // size]), 1)
            docs += np.bincount(y, minlength=2)
        if docs.sum():
            name = int(total[:: 1 + size // 997].sum()) % PARTIAL
            parts = np.array_split(total, PARTS)
            yield pa.record_batch({"part": pa.array(range(PARTS), pa.int32()), "sub": pa.array([name] * PARTS, pa.int32()), "block": pa.array([squeeze(p.ravel(), docs) for p in parts], pa.binary())})

    def add(key, data):
        total, docs = 0, 0
        for block in data["block"].to_pylist():
            a, d = expand(block)
            total, docs = total + a.astype(np.int64), docs + d
        return pa.table({"part": pa.array([data["part"][0].as_py()], pa.int32()), "sub": pa.array([0], pa.int32()), "block": pa.array([squeeze(total, docs)], pa.binary())})

    schema = "part int, sub int, block binary"
    got = rows.select("text", "y").mapInArrow(tidied(count), schema).groupBy("part", "sub").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    # PARTS blocks of a fixed size
    blocks = {r.part: expand(bytes(r.block)) for r in got.collect()}
    if not blocks:
        return np.zeros((size + 1, 2))
    body = np.concatenate([blocks[p][0].view(np.int64) for p in range(PARTS)]).reshape(-1, 2)
    return np.concatenate([body, blocks[0][1].view(np.int64)[None, :]]).astype(float)


@dataclass
class Scores:
    """What a token scores: toxic and all counts of words, and the priors of prefixes."""

    toxic: np.ndarray
    every: np.ndarray
    prior: np.ndarray
    base: float

    @classmethod
    def of(cls, counts: np.ndarray) -> Scores:
        words, prefixes = counts[:SLOTS], counts[SLOTS:-1]
        share = (words[:, 1].sum() + 0.5) / (words.sum() + 1.0)
        prior = (prefixes[:, 1] + PRIOR * share) / (prefixes.sum(axis=1) + PRIOR)
        return cls(words[:, 1].astype(np.float32), words.sum(axis=1).astype(np.float32), prior.astype(np.float32), float(share))

    def __call__(self, word: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        share = (self.toxic[word] + np.float32(PRIOR) * self.prior[prefix]) / (self.every[word] + np.float32(PRIOR))
        share = np.clip(share.astype(float), 1e-9, 1 - 1e-9)
        return np.log(share / (1 - share)) - np.log(self.base / (1 - self.base)) - DRIFT


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, stop, score) of a sequence, in linear time.

    A list of candidates is kept with the sums before and after each.  A new
    positive token joins leftwards to the nearest candidate that began lower,
    unless that one ended at least as high.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    starts: list[int] = []
    stops: list[int] = []
    below: list[float] = []
    above: list[float] = []
    link: list[int] = []  # nearest earlier candidate that began lower
    for i, lo, hi in zip(positive.tolist(), total[positive].tolist(), total[positive + 1].tolist(), strict=True):
        start, stop = i, i + 1
        while True:
            j = len(starts) - 1
            while j >= 0 and below[j] >= lo:
                j = link[j]
            if j < 0 or above[j] >= hi:
                break
            start, lo = starts[j], below[j]
            del starts[j:], stops[j:], below[j:], above[j:], link[j:]
        starts.append(start)
        stops.append(stop)
        below.append(lo)
        above.append(hi)
        link.append(j)
    return [(a, b, h - l) for a, b, l, h in zip(starts, stops, below, above, strict=True)]


@dataclass
class Calibration:
    """Gumbel law of clean text, and the logistic fit of a document's evidence."""

    rate: float
    log_k: float
    weights: np.ndarray
    fallback: float | None = None

    def excess(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Minus the log of the expected number of such segments in clean text of that size."""
        return self.rate * best - self.log_k - np.log(np.maximum(n, 1))

    def score(self, best, n, significant) -> np.ndarray:
        if self.fallback is not None:
            return np.full(len(best), self.fallback)
        z = _evidence(self.excess(best, n), significant) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _evidence(excess: np.ndarray, significant: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(excess)), np.clip(excess, -10, 15), np.log1p(significant)], axis=1)


def fit_gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and log K of clean documents' best scores."""
    if len(best) < 20 or best.std() == 0:
        return 1.0, 0.0
    rate, log_n = np.pi / (np.sqrt(6) * best.std()), np.log(np.maximum(n, 1))
    for _ in range(100):
        rate = 0.5 * rate + 0.5 * np.pi / (np.sqrt(6) * max((best - log_n / rate).std(), 1e-3))
    rate = float(np.clip(rate, 0.2, 5))
    return rate, float(rate * best.mean() - log_n.mean() - np.euler_gamma)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + ridge * np.r_[0, w[1:]]
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _segments(batch, scores: Scores):
    """For each document of a batch: tokens, segments, and first byte and end of its tokens."""
    for lo, hi, body, offsets in _steps(batch):
        row, word, prefix, begin, end = tokens(body, offsets)
        value = scores(word, prefix)
        cuts = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            a, b = cuts[i], cuts[i + 1]
            yield lo + i, b - a, maximal_segments(value[a:b]), begin[a:b] - offsets[i], end[a:b] - offsets[i]


def _evidence_of(batch, scores: Scores, law: Calibration):
    """Of each document: significant segments with first bytes and ends of its tokens; tokens; best score; number of significant segments."""
    found, n, best, significant = [], [], [], []
    for _, size, segments, begin, end in _segments(batch, scores):
        value = np.array([s for _, _, s in segments])
        excess = law.excess(value, np.full(len(value), size))
        hits = np.flatnonzero(excess > -np.log(SIGNIFICANT)).tolist()
        found.append(([(*segments[i], float(excess[i])) for i in hits], begin, end))
        n.append(size)
        best.append(value.max() if len(value) else 0.0)
        significant.append(len(hits))
    return found, np.array(n, np.int64), np.array(best, float), np.array(significant, np.int64)


@dataclass
class Model:
    scores: Scores
    calibration: Calibration


def fit(docs: DataFrame, labels: DataFrame, train: Column, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Learns from the labelled rows that satisfy train (on doc_id of labels)."""
    docs, fold = in_small_batches(docs, BRIEF), remainder(F.col("doc_id"), 20) < 15

    def count(rows: Column) -> Scores:
        counted = with_label(docs, labels, "toxic", rows)
        once = counted.groupBy(F.xxhash64("text").alias("h"), F.octet_length("text").alias("k"), "y").agg(F.min("doc_id").alias("doc_id"))
        single = counted.join(F.broadcast(once.select("doc_id")) if labels.count() <= 2_000_000 else once.select("doc_id"), "doc_id", "left_semi")
        return Scores.of(count_tables(single))

    scores = count(train & fold)
    known = docs.sparkSession.sparkContext.broadcast(scores)

    chosen = labels.filter(train & ~fold & F.col("toxic").isin(0, 1)).orderBy(F.xxhash64("doc_id")).limit(calibration_rows)
    held = with_label(docs, chosen, "toxic", F.lit(True)).select("text", "y")

    def evidence(law: Calibration):
        """Label, tokens, best score and number of significant segments of each of these documents."""

        def run(batches):
            for batch in batches:
                _, n, best, significant = _evidence_of(batch, known.value, law)
                yield pa.record_batch({"y": batch.column("y"), "n": pa.array(n), "best": pa.array(best), "significant": pa.array(significant)})

        rows = held.mapInArrow(tidied(run), "y int, n long, best double, significant long").limit(2 * calibration_rows).toPandas()
        return rows.sort_values(["y", "n", "best", "significant"])

    first = evidence(Calibration(1.0, 0.0, np.zeros(3)))
    if not len(first) or first.y.min() == first.y.max():
        return Model(count(train), Calibration(1.0, 0.0, np.zeros(3), 0.0))
    clean = first[first.y == 0]
    law = Calibration(*fit_gumbel(clean.best.to_numpy(), clean.n.to_numpy(float)), np.zeros(3))
    found = evidence(law)  # which segments are significant is known only now
    law.weights = fit_logistic(_evidence(law.excess(found.best.to_numpy(), found.n.to_numpy(float)), found.significant.to_numpy(float)), found.y.to_numpy(float))
    return Model(count(train), law)


RESULT = "doc_id long, score double, passages array<struct<start:int,stop:int,score:double,expected:double>>"
_PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and passages: the significant segments as bytes [start, stop) with scores and expected numbers."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores, law = known.value.scores, known.value.calibration
        for batch in batches:
            found, n, best, significant = _evidence_of(batch, scores, law)
            passages = [[{"start": int(begin[a]), "stop": int(end[b - 1]), "score": v, "expected": float(np.exp(-x))} for a, b, v, x in hits] for hits, begin, end in found]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(law.score(best, n, significant)), "passages": pa.array(passages, _PASSAGES)})

    return in_small_batches(docs, BRIEF).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), RESULT)


def without_toxic(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """The rows of docs that score under cut, columns as they are."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores, law = known.value.scores, known.value.calibration
        for batch in batches:
            _, n, best, significant = _evidence_of(batch, scores, law)
            score = law.score(best, n, significant)
            yield batch.filter(pa.array(score < cut))

    return in_small_batches(docs, BRIEF).mapInArrow(tidied(run), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxic_passages(docs, fit(docs, labels, remainder(F.col("doc_id"), 5) != 0))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
