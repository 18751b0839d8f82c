import numpy as np
import pytest

from kinelake.llm import byte_bpe as bpe

ROWS = [(1, "Hello  world's 12345\n\n  end"), (2, ""), (3, None), (None, "naïve café"), (4, "<|endoftext|> x"), (5, "\x00é" * 50), (5, "a" * 3000), (6, "Hello  world's 12345\n\n  end"), (7, "日本語 テスト  x\t\r\n")]


def check(spark, rows):
    import public_tokenizers
    import tiktoken

    v = bpe.default_vocabulary()
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks(), special_tokens={})
    want = sorted(((d, enc.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows), key=str)
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, ids string, decoded string")
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in bpe.decode(bpe.encode(docs, v), v).collect()), key=str)
    assert got == want


def test_equals_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 60)
    monkeypatch.setattr(bpe, "BUCKET_WORDS", 1)
    check(spark, ROWS)


def test_small_data(spark):
    import pandas as pd

    t = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, list(zip(t.doc_id.tolist(), t.text.tolist())))


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_no_text(spark, rows):
    check(spark, rows)


def test_decoded_and_assembled_agree(spark, monkeypatch):
    v = bpe.default_vocabulary()
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    key = lambda r: (str(r.doc_id), r.ids, bytes(r.decoded))
    assert sorted(map(key, bpe.encode(docs, v, decoded=True).collect())) == sorted(map(key, bpe.decode(bpe.encode(docs, v), v).collect()))
    values, begins = v.token_bytes
    ids, ends = np.arange(300, dtype=np.uint32), np.array([0, 5, 5, 300])
    whole = values[: begins[300]].tobytes()
    monkeypatch.setattr(bpe, "TOKENS", 7)
    assert bpe._decoded(v, ids, ends).to_pylist() == [whole[: begins[5]], b"", whole[begins[5] :]]
    assert bpe._decoded(v, ids[:0], np.array([0, 0])).to_pylist() == [b""]
