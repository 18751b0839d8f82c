import collections
import math
import types
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from kinelake.llm import gru
from kinelake.llm import language_model as lm
from kinelake.llm.byte_bpe import words_of
from kinelake.llm.common import NO_ID, expand
from kinelake.llm.gru import Gru


def exact(rows):
    split = lambda t: [*(t or "").encode().lower().split(), None]
    trains = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 != 1
    c = collections.Counter(w for d, t in rows if trains(d) for w in split(t))
    n, v = sum(c.values()), len(c)
    return {(d, t): (len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t))) for d, t in rows}


def test_small_data(spark):
    t = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm.op2_lm_scoring(spark, "/root/testdata/sf0.01").toPandas()
    want = exact(list(zip(t.doc_id.tolist(), t.text.tolist())))
    text = dict(zip(t.doc_id, t.text))
    for r in out.itertuples():
        n, known, tokens, base = want[r.doc_id, text[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens) and math.isclose(r.base_score, base, rel_tol=1e-9)
    held = out[out.held_out]
    print("per token", held.score.sum() / held.n_tokens.sum(), "unigram", held.base_score.sum() / held.n_tokens.sum(), "better on", (held.score > held.base_score).mean())
    assert held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.9


def test_gradients():
    m = Gru(5, 3, 4, np.array([0, 2, 5]), seed=2)
    m.load([p.astype(np.float64) for p in m.parameters()])
    rng = np.random.default_rng(0)
    tokens, first = rng.integers(0, 5, (4, 2)), np.array([[1, 1], [0, 0], [0, 1], [0, 0]], bool)
    cls = np.array([[0, 1], [2, 3], [1, 0], [0, 1]])
    member = np.array([[1, 4], [0, 0], [2, 0], [0, 3]])
    h = np.zeros((2, 3), np.float32)
    value, _, grads = m.gradients(h, tokens, first, cls, member)
    for p, g in zip(m.parameters(), grads):
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in p.shape)
            old, e = p[i], 1e-2
            p[i] = old + e
            up = m.gradients(h, tokens, first, cls, member)[0]
            p[i] = old - e
            down = m.gradients(h, tokens, first, cls, member)[0]
            p[i] = old
            assert abs(-(up - down) / (2 * e) - g[i]) < 2e-3


def test_one_distribution():
    corpus = lm.Corpus(100, 9, [(b"a", 40), (b"b", 30), (lm.END, 10)], np.full(lm.TAILS, 0.0))
    words = [b"a", b"b", lm.END, b"xx", b"yx", b"new"]
    counts = np.array([40, 30, 10, 3, 5, 0])
    sizes, body = np.array([len(w) for w in words], np.uint32), np.frombuffer(b"".join(words), np.uint8)
    tail = lm.tail_class(counts, sizes, body)
    corpus.tails = np.bincount(tail[3:5], counts[3:5] + 0.5, lm.TAILS)
    cls, member, _, share = corpus.describe(counts, sizes, body, words)
    m = corpus.model()
    h = np.random.default_rng(1).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    p = np.exp([float(m.outputs(h, cls[[i]], member[[i]])[0]) + share[i] for i in range(len(words))])
    used = {*cls.tolist()}
    empty = [c for c in range(corpus.unseen + 1) if c not in used]
    rest = sum(math.exp(float(m.outputs(h, np.array([c]), np.array([0]))[0])) for c in empty)
    assert abs(p.sum() + rest - 1) < 1e-5


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 3)
    rows = [(1, "a b a"), (2, None), (3, ""), (None, "a c"), (4, "x " * 3000), (4, "dup"), (10, "A\tb\x0bé")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, score int")
    got = lm.score_documents(docs).collect()
    want = exact(rows)
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted((*w[:3], round(w[3], 6)) for w in want.values())
    assert all(np.isfinite(r.score) for r in got)
    assert lm.score_documents(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [r.base_score for r in lm.score_documents(none).collect()] == [0.0]


def test_training_reads_every_document_whole(monkeypatch):
    n = np.array([9000, 3, *[700] * 300], np.uint32)
    doc = np.arange(len(n)) + 1
    begin = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
    each = np.arange(begin[-1])  # every place of the text is a word of its own
    zeros = np.zeros(len(each), np.int64)
    block = types.SimpleNamespace(doc=doc, n=n, seq=each, begin=begin, cls=zeros, given=zeros, counts=zeros + 2, member=each, end=0)
    read = []
    monkeypatch.setattr(Gru, "gradients", lambda self, h, tokens, first, cls, member: (read.append(member.copy()), h, [np.zeros_like(p) for p in self.parameters()]))
    corpus = lm.Corpus(1, 1, [(b"a", 1)], np.ones(lm.TAILS))
    lm._train(block, corpus, corpus.model().parameters(), 1, 0)
    lanes = np.concatenate(read)
    trains = np.repeat(lm._trains(doc, 1), n)
    seen = np.bincount(lanes.ravel(), minlength=len(each)) > 0
    assert seen[trains].all() and not seen[~trains].any()
    follows = (lanes[1:] == lanes[:-1] + 1).mean()
    assert follows > 0.99  # in their order


def test_rounds_cover_all_blocks(spark):
    for low, high in ((-50, 50), (-3, -1), (7, 8)):
        blocks = spark.range(low, high).withColumnRenamed("id", "g")
        used = {g % lm.ROUNDS for g in range(low, high)}
        turns = [[r.g for r in blocks.filter(lm.taking(k, used, low)).collect()] for k in range(lm.ROUNDS)]
        assert set().union(*turns) == set(range(low, high)) and all(turns)
        assert sum(len(t) for k, t in enumerate(turns) if k in used) == high - low


def test_blocks_hold_words_as_split():
    texts = ["A\tb\x0bé  ", "", "  ", "x y X", "end", "", "é\xa0É"]
    batch = pa.record_batch({"doc_id": pa.array([1, 2, None, 4, 5, 6, 7], pa.int64()), "text": pa.array(texts)})

    def read(blocks):
        for b in blocks:
            doc, n, seq, sizes, body = expand(b.column("block")[0].as_py())
            words, at = words_of(sizes, body), iter(seq.tolist())
            yield from [(d, [words[next(at)] for _ in range(k)]) for d, k in zip(doc.tolist(), n.tolist())]

    want = [(d if d is not None else NO_ID, [*t.encode().lower().split(), lm.END]) for d, t in zip(batch.column("doc_id").to_pylist(), texts)]
    assert list(read(lm.blocks_of(iter([batch])))) == want
    assert list(read(lm.blocks_of(iter([batch.slice(0, 3), batch.slice(3)])))) == want
    assert list(read(lm.blocks_of(iter([batch.slice(0, 0)])))) == []


def test_kernels_by_pieces(monkeypatch):
    monkeypatch.setattr(gru, "ROWS", 3)  # the output layer works on pieces of so many rows
    rng, k = np.random.default_rng(3), 4
    m = Gru(6, k, 5, np.array([0, 2, 6]), seed=4)
    for scale in (1, 3000):  # gates that are shut altogether
        m.load([m.x * scale, m.u, m.c * scale, m.w])
        tokens, first = rng.integers(0, 6, (5, 3)), rng.random((5, 3)) < 0.3
        h = np.zeros((3, k), np.float32)
        with np.errstate(all="raise", under="ignore"):
            states, last, _ = m.window(h, tokens, first)
            again = m.window(h, tokens, first, keep=True)[0]
        x, u = m.x.astype(np.float64), m.u.astype(np.float64)
        for t in range(5):
            h = np.where(first[t][:, None], 0, h)
            g, s = x[tokens[t]], h @ u
            z, r = (0.5 + 0.5 * np.tanh((g[:, i : i + k] + s[:, i : i + k]) / 2) for i in (0, k))
            n = np.tanh(g[:, 2 * k :] + r * s[:, 2 * k :])
            h = n + z * (h - n)
            assert np.allclose(states[t], h, atol=1e-5) and np.array_equal(states[t], again[t])
        assert np.array_equal(last, states[-1])
        flat = states.reshape(-1, k)
        cls = rng.integers(0, 5, len(flat))
        member = np.where(cls < 2, np.array([0, 2])[cls % 2] + rng.integers(0, 2, len(flat)), 0)
        one = np.concatenate([flat, np.ones((len(flat), 1))], axis=1)
        log_softmax = lambda a: a - a.max() - np.log(np.exp(a - a.max()).sum())
        want = [log_softmax(o @ m.c)[c] + (log_softmax(m.w[m.bounds[c] : m.bounds[c + 1]] @ o)[w - m.bounds[c]] if c < 2 else 0) for o, c, w in zip(one, cls, member)]
        assert np.allclose(m.outputs(flat, cls, member), want, rtol=1e-4, atol=1e-4)
        assert np.allclose(m.output_gradients(flat, cls, member)[0], want, rtol=1e-4, atol=1e-4)
    sizes = np.array([1, 8, 2, 9, 1, 30, 7])
    rows, begins = rng.normal(size=(sizes.sum(), 2)), np.cumsum(sizes) - sizes
    assert np.allclose(gru.segment_sums(rows, begins), np.add.reduceat(rows, begins))
