import random
import re

import numpy as np
import pytest

from kinelake.llm import minhash_dedup as mh
from kinelake.llm.textkernels import shingle_sets


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[i][0] == rows[j][0] or both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        c = min((g for g in group if g is not None), default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, v int, label string")
    return sorted((tuple(r) for r in mh.near_duplicates(docs).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Über", "É"]
    word = lambda: rng.choice(vocab)
    rows, d = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 12, 60, 200, 400]))]
        for _ in range(rng.choice([1, 2, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 50))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((d, " ".join(copy)))
            d += 1
            if rng.random() < 0.5:
                base = copy  # chains
    rows += [(d, ""), (d + 1, None), (d + 2, " \n\t"), (d + 3, rows[0][1].upper().replace("É", "é")), (d + 4, rows[5][1] + "\n")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(mh, "BLOCK_ITEMS", 300)
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(3000))
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "q r s"), (9, long), (9, long), (10, long + " y"), (11, None)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_shingles_and_sketches():
    texts = ["a b c d e f a b c d e", "", "A  b\tc", "é", "one two three four five"]
    raw = [t.encode() for t in texts]
    body, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    values, at = shingle_sets(body, offsets, 5)
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
    rng = np.random.default_rng(5)
    for j in (0.5, 0.85):
        both, each = int(400 * j), int(400 * (1 - j) / 2)
        error = []
        for _ in range(40):
            v = rng.integers(0, 1 << 63, both + 2 * each, dtype=np.uint64)
            one, two = v[: both + each], np.concatenate([v[:both], v[both + each :]])
            s = mh.sketches(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]))
            error.append((s[0] == s[1]).mean() - j)
        assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.06
    few = mh.sketches(np.array([7], np.uint64), np.array([0, 1, 1]))
    assert (few[1] == 0).all() and len(set(few[0].tolist())) > 100
