import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelake.llm import quality, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = pd.Series(score).rank().to_numpy()
    p, n = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * n)


@pytest.mark.parametrize("query,label,mod,rest,cut,least", [(toxicity.op3_toxicity, "toxic", 5, 0, 0.5, 0.93), (quality.op7_quality, "quality", 4, 2, 0.7, 0.95)])
def test_held_out(spark, query, label, mod, rest, cut, least):
    out = query(spark, SF).toPandas()
    ids = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id"]).doc_id
    assert sorted(out.doc_id) == sorted(ids)
    assert (out.held_out == out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % mod == rest)).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= cut)).all()
    m = out[out.held_out].merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    y = m[label].to_numpy()
    print(label, "auc", auc(m.score, y), "accuracy", (m.predicted == y).mean(), "recall", m.predicted[y == 1].mean(), "specificity", 1 - m.predicted[y == 0].mean(), len(m))
    assert auc(m.score, y) >= least


def brute_segments(x):
    """Ruzzo and Tompa's characterisation: recursively the best segment, then left and right of it."""
    best, at = 0.0, None
    for i in range(len(x)):
        for j in range(i + 1, len(x) + 1):
            s = float(x[i:j].sum())
            if s > best + 1e-9:
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    return brute_segments(x[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(x[j:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -1.5, -0.25, 1.0, 2.125, 4.0]), max_size=25))
def test_maximal_segments(x):
    # distinct scores, so that the best segment is one
    x = np.array(x) + np.arange(len(x)) * 1.0001e-4 + np.sqrt(np.arange(1, len(x) + 1)) * 1e-5
    got = toxicity.maximal_segments(x)
    want = brute_segments(x)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_pairs_in_linear_time():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.WORD_BINS + 2), rng.normal(size=(quality.WORD_BINS + 2, quality.FACTORS)), np.zeros(2), np.ones(2))
    row, feature, x, begins = m.inputs(np.array([0, 0, 1]), np.array([5, 9, 5]), np.array([0.5, 0.2, 1.0]), rng.normal(size=(2, 2)))
    z, _ = m.margin(row, feature, x, begins)
    for r in range(2):
        f, v = feature[row == r], x[row == r]
        pairs = sum(m.vectors[f[i]] @ m.vectors[f[j]] * v[i] * v[j] for i in range(len(f)) for j in range(i))
        assert np.isclose(z[r], 0.3 + m.weights[f] @ v + pairs)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "an idiot speaks", 5, 1.0), (2, None, None, 1.0), (None, "x", 3, 1.0), (3, "word " * 9000, 9, 1.0), (3, "", 0, 1.0), (4, "é\x00\n\n| | |", 2, 1.0)], "doc_id long, text string, n_chars long, score double")
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (3, 1, 0), (2, None, None), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        for fit, apply in ((toxicity.fit, toxicity.toxic_passages), (quality.fit, quality.quality_scores)):
            out = apply(docs, fit(docs, some, F.lit(True))).collect()
            assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
            assert apply(docs.limit(0), fit(docs, some, F.lit(True))).count() == 0


def test_passages(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    rows, marks = [], []
    for d in range(800):
        words = list(rng.choice(vocab, 60))
        bad = d % 4 == 0
        if bad:
            at = int(rng.integers(5, 50))
            words[at : at + 3] = ["vile", "nasty", "vile"]
        rows.append((d, " ".join(words)))
        marks.append((d, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = toxicity.toxic_passages(docs, toxicity.fit(docs, labels, F.col("doc_id") < 600)).filter("doc_id >= 600").collect()
    text = dict(rows)
    for r in out:
        bad = r.doc_id % 4 == 0
        assert (r.score >= 0.5) == bad and bool(r.passages) == bad
        if bad:
            assert any("vile nasty vile" in text[r.doc_id][p.start : p.stop] for p in r.passages)


def test_scores_count_all_labelled(spark):
    counted = [d for d in range(1, 900) if zlib.crc32(str(d).encode()) % 20 < 15][:200]
    held = [d for d in range(1, 900) if zlib.crc32(str(d).encode()) % 20 >= 15][:60]
    rows = [(d, f"plain words number{d} " + ("vile" if d % 2 else "fair"), d % 2) for d in counted]
    rows += [(d, f"plain words number{d} " + ("gruesome" if d % 2 else "fair"), d % 2) for d in held]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    everything = toxicity.Scores.of(toxicity.count_tables(toxicity.with_label(docs, labels, "toxic", F.lit(True))))
    assert np.array_equal(model.scores.every, everything.every) and np.array_equal(model.scores.toxic, everything.toxic)
