import hashlib

import pandas as pd
import pytest

import corpus_pipeline
from kinelake.llm import byte_bpe, exact_dedup, mixing, toxicity
from kinelake.llm.common import table
from pyspark.sql import functions as F
from test_minhash import brute

SF = "/root/testdata/sf0.001"


def staged(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs.toPandas())
    return out


def test_stages_equal_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    before = docs.toPandas()
    stages = staged(spark)
    for s in stages[:-1]:
        assert list(s.columns) == docs.columns
    scores = toxicity.toxic_passages(docs, toxicity.fit(docs, labels, F.lit(True))).toPandas().set_index("doc_id").score
    assert set(stages[0].doc_id) == {d for d in before.doc_id if scores[d] < 0.5}
    fold = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
    best = stages[0].assign(k=stages[0].text.str.translate(fold)).groupby("k").doc_id.max()
    assert sorted(stages[1].doc_id) == sorted(best)
    near = brute(list(zip(stages[1].doc_id.tolist(), stages[1].text.tolist())), 80)
    assert sorted(stages[2].doc_id) == sorted(d for d, _, c, _ in near if d == c)
    chosen = mixing.mix(spark.createDataFrame(stages[2], docs.schema)).filter("sampled").toPandas()
    assert sorted(stages[3].doc_id) == sorted(chosen.doc_id) and 0 < len(chosen) < len(stages[2])
    text = dict(zip(stages[3].doc_id, stages[3].text))
    assert sorted(stages[4].doc_id) == sorted(text)
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.default_vocabulary().ranks(), special_tokens={})
    for r in stages[4].itertuples():
        ids = enc.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, whole.values)) == sorted(map(tuple, stages[4].values))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (9001, "A b", "en", None, 3), (9001, "A b", "en", None, 3), (9002, "a B", None, "s", None), (9005, "word " * 5000, "en", "s", 1)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        n = docs.count()
        if name == "exact_dedup":
            assert n == (3 if rows else 0)


def test_near_copies_without_identifier(spark):
    words = [f"w{i}" for i in range(200)]
    text, other = " ".join(words), " ".join(reversed(words))
    named = spark.createDataFrame([(None, text), (None, text + " end"), (None, text.replace(" ", "  ")), (7, other), (None, other + " end"), (None, None), (None, "")], "doc_id long, text string")
    kept = [(r.doc_id, r.text.split()[0] if r.text else r.text) for r in corpus_pipeline.drop_near(spark, named, SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, "w0"), (7, "w199"), (None, None), (None, "")]))
