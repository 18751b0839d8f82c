"""Byte-level BPE encoding and decoding over a shuffle of the distinct words.

Encoding takes no text through a shuffle:

1. Each partition splits its texts into pre-tokens and packs them, a few
   megabytes of text at a time, into a block: the distinct words, and for each
   document the numbers of its words in order of position.
2. Blocks send their distinct words to buckets of a word hash.  A bucket encodes
   each distinct word once, however many blocks hold it, and answers every block
   with the ids of its words in the order they came.
3. A block joins the ids back by word number and reassembles each document by
   position.

Decoding joins ids with the table of token bytes, which the vocabulary bounds.

A word that is everywhere is one entry of each block, so no bucket receives more
than its share.  A block is named by its content: evaluated again, it bears the
same name.  Vocabulary ranks are read once on the driver and broadcast (their
size is that of the vocabulary, whatever the data).

Defined results: null text is empty and has no tokens; special tokens are
ordinary text; rows with null or repeated identifiers are encoded like all
others; an empty table gives an empty result.  Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm.common import NO_ID, binaries, expand, gathered, group_count, ids, in_small_batches, packed, pieces, squeeze, table, text_bytes, tidied

#: Bytes of text in a block; distinct words in a bucket, about.
BLOCK_BYTES, BUCKET_WORDS = 8 << 20, 150_000
#: Documents and tokens that are put together in one step, about.
ROWS, TOKENS = 512, 1 << 17


class Vocabulary:
    """Ranks of a byte-level BPE and the pattern that splits text before its merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.lines, self.pattern = f.read(), pattern

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines()) if a}

    def encoder(self):
        """A function from the bytes of one word to its ids."""
        import tiktoken

        return tiktoken.Encoding("words", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})._core_bpe.encode_single_piece

    @functools.cached_property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens one after the other, and where each id begins."""
        by_id = sorted((i, b) for b, i in self.ranks().items())
        sizes = np.zeros(by_id[-1][0] + 1 if by_id else 0, np.int64)
        for i, b in by_id:
            sizes[i] = len(b)
        return np.frombuffer(b"".join(b for _, b in by_id), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def words_of(sizes: np.ndarray, body: np.ndarray) -> list[bytes]:
    raw, ends = body.tobytes(), np.cumsum(sizes.astype(np.int64)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def pattern_split(pattern: str):
    import regex

    found = regex.compile(pattern).findall
    return lambda raw: found(raw.decode("utf-8", "replace"))


def pack(batches, split):
    """Blocks of documents: identifiers, word counts, word numbers by position, sizes and bytes of the distinct words."""
    for batch in batches:
        doc = ids(batch.column("doc_id"))
        body, offsets = packed(batch.column("text"))
        raw = body.tobytes()
        for lo, hi in pieces(offsets, BLOCK_BYTES):
            number, counts, seqs = _Numbers(), [], []
            for i in range(lo, hi):
                found = split(raw[offsets[i] : offsets[i + 1]])
                seqs.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
                counts.append(len(found))
            words = [w if isinstance(w, bytes) else w.encode() for w in number]
            yield block_of(doc[lo:hi], np.array(counts), np.concatenate(seqs), words)


def block_of(doc: np.ndarray, counts: np.ndarray, seq: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
    """A block, named by its content, of documents with these word counts and word numbers by position."""
    # frequent words get small numbers; ties by the words, which makes a block independent of hashing
    rank = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
    place = np.empty(len(words), np.uint32)
    place[rank] = np.arange(len(words))
    words = [words[i] for i in rank.tolist()]
    blob = squeeze(doc, counts.astype(np.uint32), place[seq] if len(words) else seq.astype(np.uint32), np.array([len(w) for w in words], np.uint32), np.frombuffer(b"".join(words), np.uint8))
    name = int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little", signed=True)
    return pa.record_batch({"g": pa.array([name], pa.int64()), "block": pa.array([blob], pa.binary())})


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), sorted within partitions so that blocks come out the same again."""
    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).sortWithinPartitions("doc_id", "text")


def dealt(words: list[bytes], buckets: int, ordered: bool = True) -> list[tuple[int, list[int]]]:
    """Word numbers by bucket; in the order of the words, which compresses better, or of their numbers."""
    by = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64) if ordered else np.arange(len(words))
    bucket = (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets))[by]
    place = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[place], return_index=True)
    return [(b, mine.tolist()) for b, mine in zip(names.tolist(), np.split(by[place], first[1:]), strict=True)] if len(words) else []


_REQUEST = pa.schema([("bucket", pa.int32()), ("g", pa.int64()), ("block", pa.binary())])
REQUEST = "bucket int, g long, block binary"


def _decoded(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ids one after the other, for each document; ends: where the ids of each begin, and their number."""
    values, begins = vocabulary.token_bytes
    parts = [gathered(values, begins, ids[a : a + TOKENS].astype(np.int64)) for a in range(0, len(ids), TOKENS)]
    body = np.concatenate([np.zeros(0, np.uint8), *(b for b, _ in parts)])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)]))])[ends]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())


def encode(docs: DataFrame, vocabulary: Vocabulary, decoded: bool = False) -> DataFrame:
    """One row a document: doc_id and ids, the token ids of its whole text; and decoded, their bytes, if asked."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    blocks = group_count(text_bytes(docs), BLOCK_BYTES / 1e6)
    # each block of text brings some tens of thousands of words
    buckets = max(1, round(blocks * BLOCK_BYTES / 200 / BUCKET_WORDS))
    packs = in_order(docs).mapInArrow(tidied(lambda it: pack(it, pattern_split(known.value.pattern))), "g long, block binary").repartition(blocks, "g")

    def ask(batches):
        for batch in batches:
            for g, block in zip(batch.column("g").to_pylist(), batch.column("block").to_pylist(), strict=True):
                _, _, _, sizes, body = expand(block)
                words = words_of(sizes, body)
                for b, mine in dealt(words, buckets):
                    blob = squeeze(np.array([len(words[i]) for i in mine], np.uint32), np.frombuffer(b"".join([words[i] for i in mine]), np.uint8))
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([g], pa.int64()), pa.array([blob], pa.binary())], schema=_REQUEST)

    def answer(key, data):
        parts = [expand(blob) for blob in data["block"].to_pylist()]
        sizes, body = (np.concatenate(x) for x in zip(*parts, strict=True))
        coded = binaries(sizes, body).dictionary_encode()  # each distinct word once
        merge, ids_of, counts = known.value.encoder(), array.array("I"), []
        for word in coded.dictionary:
            got = merge(word.as_py())
            ids_of.extend(got)
            counts.append(len(got))
        n = np.array(counts, np.uint32)
        begins, values = np.concatenate([[0], np.cumsum(n.astype(np.int64))]), np.frombuffer(ids_of, np.uint32)
        place = coded.indices.to_numpy(zero_copy_only=False)
        out = [squeeze(n[p], gathered(values, begins, p)[0]) for p in np.split(place, np.cumsum([len(x[0]) for x in parts])[:-1])]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(out), pa.int32()), data["g"].combine_chunks(), pa.array(out, pa.binary())], schema=_REQUEST)

    result = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), *([("decoded", pa.binary())] if decoded else [])])

    def assemble(key, data, answers):
        parts = []
        replies = {b: x for b, x in zip(answers["bucket"].to_pylist(), answers["block"].to_pylist(), strict=True)}
        for block in data["block"].to_pylist():
            doc, counts, seq, sizes, body = expand(block)
            order, got_sizes, got = [], [], []
            for b, mine in dealt(words_of(sizes, body), buckets):
                n, flat = expand(replies[b])
                order += mine
                got_sizes.append(n)
                got.append(flat)
            begins = np.concatenate([[0], np.cumsum(np.concatenate(got_sizes).astype(np.int64))]) if got else np.zeros(1, np.int64)
            values = np.concatenate(got) if got else np.zeros(0, np.uint32)
            place = np.empty(len(sizes), np.int64)
            place[order] = np.arange(len(sizes))
            first = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
            for lo, hi in pieces(first, TOKENS):
                flat, n = gathered(values, begins, place[seq[first[lo] : first[hi]]])
                ends = np.concatenate([[0], np.cumsum(n)])[first[lo : hi + 1] - first[lo]]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
                back = [_decoded(known.value, flat, ends)] if decoded else []
                parts.append(pa.record_batch([pa.array(doc[lo:hi], pa.int64(), mask=doc[lo:hi] == NO_ID), lists, *back], schema=result))
        return pa.Table.from_batches(parts, result)

    replies = packs.mapInArrow(tidied(ask), REQUEST).groupBy("bucket").applyInArrow(tidied(answer), REQUEST)
    return packs.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(tidied(assemble), "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded (doc_id, ids) with decoded, the bytes of its ids one after the other."""
    known = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def look_up(batches):
        for batch in batches:
            column, doc = batch.column("ids"), batch.column("doc_id")
            first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for lo, hi in pieces(first, TOKENS):
                for a in range(lo, hi, ROWS):
                    b = min(a + ROWS, hi)
                    flat = column.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                    yield pa.record_batch({"doc_id": doc.slice(a, b - a), "ids": column.slice(a, b - a), "decoded": _decoded(known.value, flat, first[a : b + 1] - first[a])})

    return in_small_batches(encoded).select("doc_id", "ids").mapInArrow(tidied(look_up), "doc_id long, ids array<int>, decoded binary")


def default_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids (decimal, joined by commas) and of the decoded bytes."""
    out = encode(docs, vocabulary, decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_vocabulary())
