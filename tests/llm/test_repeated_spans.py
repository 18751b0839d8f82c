import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelake.llm import repeated_spans as rs


def brute(rows, length=50):
    """By the definition, on (doc_id or None, text or None)."""
    key = lambda d: float("inf") if d is None else d
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            least[s] = min(least.get(s, key(d)), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < key(d):
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rs.remove_repeated_spans(docs).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut:], word()]
        rows.append((d, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "a" * 500), (103, "a" * 120 + "b"), (104, ""), (105, None), (None, rows[5][1]), (7, rows[8][1]), (7, rows[9][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(rs, "GROUP_MB", 0.004)
    monkeypatch.setattr(rs, "BUCKET_KEYS", 100)
    monkeypatch.setattr(rs, "STEP", 200)
    monkeypatch.setattr(rs, "SORT_BYTES", 500)
    monkeypatch.setattr(rs, "COMMON", 4 if seed == 1 else 1 << 14)
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_small_data(spark):
    import pandas as pd

    t = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = list(zip(t.doc_id.tolist(), t.text.tolist()))
    assert got(spark, rows) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 3 + 1 for x in b)), min_size=1, max_size=8))
def test_two_stage_order(segments):
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    order = rs.two_stage_suffix_array(text, 500)
    raw = text.tobytes()
    assert sorted(order.tolist()) == list(range(len(raw)))
    suffix = [raw[i : raw.index(0, i) + 1] for i in order]
    assert suffix == sorted(suffix)
    lcp = rs.common_prefixes(text, order, 20)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        if len(a) > 20 and len(b) > 20:
            assert lcp[k] == min(n, 20)
