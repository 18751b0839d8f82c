import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinelake.llm import exact_dedup, mixing, sharding

ROWS = [(1, "Abc", "s", "en"), (2, "aBC", "s", "en"), (3, None, "s", None), (4, "", None, "en"), (None, "abc", "s", "de"), (5, "É", "t", "de"), (6, "é", "t", "de"), (7, "x " * 5000, "t", "en"), (7, "x " * 5000, "t", "en")]
SCHEMA = "doc_id long, text string, source string, lang string, slot int, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA)


def test_exact_duplicates(spark):
    fold = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
    norm = [(d, (t or "").translate(fold)) for d, t, *_ in ROWS]
    want = []
    for d, t in norm:
        group = [e for e, u in norm if u == t]
        keep = max((e for e in group if e is not None), default=None)
        want.append((d, keep, len(group), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs(spark, ROWS)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_smallest_stays(spark):
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs(spark, ROWS), keep="min").collect()}
    assert got[2] == 1 and got[4] == 3


def test_shards_are_exact_and_uniform(spark):
    rows = [(i if i % 50 else None, f"t{i % 9}", "s", "en") for i in range(1003)] + ROWS
    out = sharding.shuffle_into_shards(docs(spark, rows)).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == len(rows) and len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    again = sharding.shuffle_into_shards(docs(spark, rows).repartition(3)).toPandas()
    key = ["doc_id", "text", "shard", "slot"]
    one, two = (x[x.doc_id > 7][key].sort_values(key).values.tolist() for x in (out, again))
    assert one == two
    # neighbours by identifier are not neighbours afterwards
    assert abs(np.corrcoef(out.doc_id.fillna(0), out.shard * 1000 + out.slot)[0, 1]) < 0.15
    assert sharding.shuffle_into_shards(docs(spark, [])).count() == 0


def test_communication_matrix():
    m = sharding.communication_matrix([5, 0, 100, 7], [38, 37, 37], 3)
    assert m.sum(1).tolist() == [5, 0, 100, 7] and m.sum(0).tolist() == [38, 37, 37] and (m >= 0).all()
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(30, 70, 20, rng) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    big = sharding.hypergeometric(2 * 10**9, 30 * 10**9, 10**7, rng)
    assert abs(big - 625_000) < 8_000


def test_query_columns(spark):
    spark.createDataFrame([(1, "aé"), (2, None)], "doc_id long, text string").write.mode("overwrite").parquet("/tmp/kinelake_test/documents.parquet")
    out = {r.doc_id: r for r in sharding.op6_sharding(spark, "/tmp/kinelake_test").collect()}
    assert out[1]["size"] == 4 and out[2]["size"] == 1 and out[1].text_crc32 == zlib.crc32("aé".encode()) and out[2].text_crc32 == 0


def test_mixing(spark):
    rows = [(i, "a " * (i % 7), "hot" if i % 3 else f"s{i % 4}", ["en", "de", None][i % 3] if i % 3 < 2 else "fr") for i in range(600)] + [r for r in ROWS]
    table = docs(spark, rows)
    out = mixing.mix(table).toPandas()
    assert len(out) == len(rows)
    tokens = out.n_tokens.sum()
    assert abs((out.n_tokens * out.probability).sum() - mixing.BUDGET * tokens) < 1e-3 * tokens
    for d in ("source", "lang"):
        g = out.assign(v=out.n_tokens * out.weight, k=out[d].fillna("-")).groupby("k")[["v", "n_tokens"]].sum()
        g = g[g.n_tokens > 0]
        want = g.n_tokens**0.5 / (g.n_tokens**0.5).sum()
        assert np.allclose(g.v / g.v.sum(), want, atol=2e-2)
    slow = mixing.mix(table, cells_on_driver=2).toPandas()
    key = ["doc_id", "n_tokens"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (out, slow))
    assert np.allclose(a.weight, b.weight) and np.allclose(a.probability, b.probability) and (a.sampled == b.sampled).all()
    given = mixing.mix(table, shares={"source": {"hot": 1.0}}).toPandas()
    assert (given[given.source == "s1"].weight == 0).all()
    assert mixing.mix(docs(spark, [])).count() == 0
