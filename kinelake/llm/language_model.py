"""Document log-likelihood under a gated recurrent language model.

1. Documents are packed into blocks of word numbers (see blocks_of).  Blocks send
   their distinct words with counts in training documents to buckets; buckets
   answer with the counts over the whole corpus.  So every document's unigram
   score is exact and the vocabulary is never held in one place.
2. The most frequent HEAD tokens become words of the softmax, in classes of
   about equal numbers by frequency.  All others fall into tail classes by
   frequency and last two bytes, within which a word has its share of
   count + 1/2; words not seen in training are one further type, a class of its
   own.  This is a distribution over the same V + 1 types as the unigram model.
3. Training is truncated backpropagation in numpy, spread over blocks: every
   block trains in one of ROUNDS rounds (a round left empty takes the first).
   It trains a copy until all of its training documents were read to their end,
   and for STEPS windows at least; the copies of a round are averaged.  So that
   lanes end together, a document longer than a lane is read as pieces side by
   side, each from a fresh state.  Words counted once stand for unseen ones half
   of the time.
4. Scoring reads every whole document once; the state is carried across windows
   and set back where a document begins.  The result is mixed with the unigram
   model at the weight UNIGRAM.

Defined results: null text is empty, one end token; null identifiers are scored
and not learned from; without training documents every known count is 0, and
both scores are those of a single unseen type; an empty table gives an empty
result.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm.byte_bpe import BUCKET_WORDS, block_of, dealt, in_order, words_of
from kinelake.llm.common import NO_ID, binaries, checkpointed, expand, gathered, group_count, ids, packed, pieces, reused_memory, squeeze, table, text_bytes
from kinelake.llm.gru import Adam, Gru, lanes_of
from kinelake.llm.labelled import remainder

HEAD, HIDDEN, SUFFIXES = 2048, 32, 16
#: A block is read in LANES lanes, or in fewer (FEWEST at least) where that gives STEPS windows.
ROUNDS, STEPS, LANES, FEWEST, WINDOW, RATE = 4, 150, 256, 32, 32, 0.01
SCORE_LANES, SCORE_WINDOW, UNIGRAM = 256, 64, 0.05
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: The end of a document as a word; no word has a space.
END = b" "

_BANDS = np.array([2, 10])  # counts from which the second and third frequency band begin
TAILS = SUFFIXES * (len(_BANDS) + 1)


def tail_class(count: np.ndarray, sizes: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Tail class, from 0, of words with these counts."""
    ends = np.cumsum(sizes.astype(np.int64))
    last = body[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(sizes > 1, body[np.maximum(ends - 2, 0)], 0).astype(np.uint64) if len(ends) else last
    suffix = ((last * np.uint64(256) + before + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)
    return np.searchsorted(_BANDS, count, "right") * SUFFIXES + (suffix % np.uint64(SUFFIXES)).astype(np.int64)


@dataclass
class Corpus:
    """Statistics of the training documents: tokens, types, head tokens and weights of tail classes."""

    tokens: int
    types: int
    head: list[tuple[bytes, int]]
    tails: np.ndarray
    index: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.index = {w: i for i, (w, _) in enumerate(self.head)}
        classes = max(1, round(len(self.head) ** 0.5))
        self.bounds = np.linspace(0, len(self.head), classes + 1).astype(np.int64)

    @property
    def unseen(self) -> int:
        return len(self.bounds) - 1 + TAILS

    def model(self) -> Gru:
        return Gru(len(self.head) + TAILS + 1, HIDDEN, self.unseen + 1, self.bounds)

    def describe(self, counts: np.ndarray, sizes: np.ndarray, body: np.ndarray, words: list[bytes]):
        """Of each word: class, member of a head class, input, log share within a tail class."""
        head_classes = len(self.bounds) - 1
        tail = tail_class(counts, sizes, body)
        share = np.log((counts + 0.5) / np.maximum(self.tails[tail], counts + 0.5))
        cls, member, given = head_classes + tail, np.zeros(len(words), np.int64), len(self.head) + tail
        for i, w in enumerate(words):
            h = self.index.get(w)
            if h is not None:
                member[i], given[i], share[i] = h, h, 0.0
                cls[i] = np.searchsorted(self.bounds, h, "right") - 1
        new = counts == 0
        cls[new], given[new], share[new] = self.unseen, len(self.head) + TAILS, 0.0
        return cls, member, given, share


def _trains(doc: np.ndarray, rest: int) -> np.ndarray:
    return np.array([d != NO_ID and zlib.crc32(str(d).encode()) % 5 != rest for d in doc.tolist()], bool)


#: Whether a byte parts words, and its lower-case form.
_PARTS = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _batches(batches):
    """Identifiers, bytes of all texts and their offsets; a batch of under half a block goes with the one before."""

    def opened(held):
        texts = pa.chunked_array([b.column("text") for b in held])
        return ids(pa.chunked_array([b.column("doc_id") for b in held])), *packed(texts)

    held = []
    for batch in batches:
        if held and (len(held) > 1 or batch.nbytes >= BLOCK_BYTES // 2):
            yield opened(held)
            held = []
        held.append(batch)
    if held:
        yield opened(held)


def blocks_of(batches):
    """Blocks of whole documents, as byte_bpe.pack makes them, of lower-cased words and an end after each document."""
    for doc, body, offsets in _batches(batches):
        for lo, hi in pieces(offsets, BLOCK_BYTES * 3 // 2):
            text, at = body[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo]
            inside = ~_PARTS[text]
            edge = np.empty(len(text), bool)
            if len(text):
                edge[0], edge[1:] = True, inside[1:] != inside[:-1]
            edge[at[at < len(text)]] = True  # words end where documents do
            begins = np.flatnonzero(edge)
            ends = np.append(begins[1:], len(text))
            word = inside[begins]
            begins, sizes = begins[word], (ends - begins)[word]
            counts = np.diff(np.append(np.searchsorted(begins, at), len(begins)))
            coded = binaries(sizes, _LOWER[text[inside]]).dictionary_encode()
            words = [*coded.dictionary.to_pylist(), END]
            seq = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(counts), len(words) - 1)
            yield block_of(doc[lo:hi], counts + 1, seq, words)


REPLY = "g long, bucket int, block binary"
_REPLY = pa.schema([("g", pa.int64()), ("bucket", pa.int32()), ("block", pa.binary())])
#: Name of a bucket's own row of statistics.
_OWN = -(1 << 63)


def _counts(packs: DataFrame, buckets: int, rest: int) -> DataFrame:
    """Answers to blocks: counts of their words in the order of `dealt`; and a row of statistics of each bucket."""

    def ask(batches):
        for batch in batches:
            for g, block in zip(batch.column("g").to_pylist(), batch.column("block").to_pylist(), strict=True):
                doc, n, seq, sizes, body = expand(block)
                own = np.bincount(seq[np.repeat(_trains(doc, rest), n)], minlength=len(sizes)).astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                for b, mine in dealt(words_of(sizes, body), buckets, ordered=False):
                    blob = squeeze(sizes[mine], gathered(body, begin, np.array(mine))[0], own[mine])
                    yield pa.record_batch([pa.array([g], pa.int64()), pa.array([b], pa.int32()), pa.array([blob], pa.binary())], schema=_REPLY)

    def answer(key, data):
        asked = [expand(x) for x in data["block"].to_pylist()]
        sizes, body, counts = (np.concatenate(x) for x in zip(*asked, strict=True))
        coded = binaries(sizes, body).dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(place, counts, len(coded.dictionary)).astype(np.int64)  # exact under 2^53
        out = [squeeze(x) for x in np.split(total[place], np.cumsum([len(x[0]) for x in asked])[:-1])]
        known = coded.dictionary.filter(pa.array(total > 0))
        counts, (body, begin) = total[total > 0], packed(known)
        sizes = np.diff(begin).astype(np.uint32)
        tails = np.bincount(tail_class(counts, sizes, body), counts + 0.5, TAILS)
        least = np.partition(counts, -HEAD)[-HEAD] if len(counts) > HEAD else 0
        words = {i: known[i].as_py() for i in np.flatnonzero(counts >= max(least, 1)).tolist()}
        top = sorted(words, key=lambda i: (-counts[i], words[i]))[:HEAD]
        own = squeeze(np.array([counts.sum(), len(counts)], np.int64), np.round(tails * 2).astype(np.int64), counts[top].astype(np.int64), sizes[top], np.frombuffer(b"".join(words[i] for i in top), np.uint8))
        names = [*data["g"].to_pylist(), _OWN]
        return pa.Table.from_arrays([pa.array(names, pa.int64()), pa.array([key[0].as_py()] * len(names), pa.int32()), pa.array([*out, own], pa.binary())], schema=_REPLY)

    return packs.mapInArrow(ask, REPLY).groupBy("bucket").applyInArrow(answer, REPLY)


def _corpus(replies: DataFrame) -> Corpus:
    def open_(batches):
        for batch in batches:
            for block in batch.column("block").to_pylist():
                sums, tails, count, sizes, body = expand(block)
                words = words_of(sizes, body)
                key = [*[f"{i}" for i in range(2 + TAILS)], *[None] * len(words)]
                yield pa.record_batch({"key": pa.array(key, pa.string()), "word": pa.array([*[None] * (2 + TAILS), *words], pa.binary()), "n": pa.array([*sums.tolist(), *tails.tolist(), *count.tolist()], pa.int64())})

    rows = replies.filter(F.col("g") == _OWN).select("block").mapInArrow(open_, "key string, word binary, n long")
    sums = {int(r.key): r.n for r in rows.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    # HEAD rows at most
    head = [(bytes(r.word), r.n) for r in rows.filter("word is not null").orderBy(F.desc("n"), "word").limit(HEAD).collect()]
    tails = np.array([sums.get(2 + i, 0) / 2 for i in range(TAILS)])
    if head:
        counts, sizes = np.array([n for _, n in head]), np.array([len(w) for w, _ in head], np.uint32)
        tails -= np.bincount(tail_class(counts, sizes, np.frombuffer(b"".join(w for w, _ in head), np.uint8)), counts + 0.5, TAILS)
    return Corpus(sums.get(0, 0), sums.get(1, 0), head, tails)


class _Block:
    """A block with the counts of its words over the corpus."""

    def __init__(self, data: pa.Table, replies: pa.Table, buckets: int, corpus: Corpus):
        self.doc, self.n, seq, sizes, body = expand(data["block"][0].as_py())
        self.seq = seq.astype(np.int64)
        self.words = words_of(sizes, body)
        got = dict(zip(replies["bucket"].to_pylist(), replies["block"].to_pylist(), strict=True))
        self.counts = np.zeros(len(self.words), np.int64)
        for b, mine in dealt(self.words, buckets, ordered=False):
            self.counts[mine] = expand(got[b])[0]
        self.cls, self.member, self.given, self.share = corpus.describe(self.counts, sizes, body, self.words)
        self.begin = np.concatenate([[0], np.cumsum(self.n.astype(np.int64))])
        self.end = corpus.index.get(END, len(corpus.head) + TAILS)


def taking(turn: int, used: set[int], least: int) -> Column:
    """Whether a block trains in this round: every block does in one; a round that would have none takes the block of the least name."""
    return F.pmod(F.col("g"), F.lit(ROUNDS)) == turn if turn in used else F.col("g") == least


def _lanes(block: _Block, pick: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text as read, time by lane, and whether the state is fresh there.

    Every document of pick is read to its end; lanes that end before the longest
    go on with any of the pieces.
    """
    total = int(block.n[pick].sum())
    count = int(np.clip(total // (WINDOW * STEPS), FEWEST, LANES))
    most = max(1, -(-total // count))
    pieces = [(a, min(a + most, e)) for b, e in zip(block.begin[pick].tolist(), block.begin[pick + 1].tolist(), strict=True) for a in range(b, e, most)]
    size = np.array([e - a for a, e in pieces])
    own = lanes_of(size, count)
    own += [[] for _ in range(count - len(own))]
    length = -(-max(STEPS * WINDOW, int(max(size[x].sum() for x in own))) // WINDOW) * WINDOW
    place, fresh = np.empty((length, count), np.int64), np.zeros((length, count), bool)
    for i, mine in enumerate(own):
        order, t = rng.permutation(mine).astype(np.int64).tolist(), 0
        while t < length:
            a, e = pieces[order.pop() if order else rng.integers(len(pieces))]
            e = min(e, a + length - t)
            place[t : t + e - a, i] = np.arange(a, e)
            fresh[t, i] = True
            t += e - a
    return place, fresh


@reused_memory()
def _train(block: _Block, corpus: Corpus, parameters: list[np.ndarray], rest: int, seed: int) -> Gru | None:
    pick = np.flatnonzero(_trains(block.doc, rest))
    if not len(pick):
        return None
    rng = np.random.default_rng(seed)
    model = corpus.model()
    model.load([p.copy() for p in parameters])
    optimizer = Adam(model.parameters(), RATE)
    # words that only this corpus place has stand for unseen ones every second time
    cls, given = block.cls.copy(), block.given.copy()
    once = np.flatnonzero(block.counts == 1)[::2]
    cls[once], given[once] = corpus.unseen, len(corpus.head) + TAILS
    place, opens = _lanes(block, pick, rng)
    begins = np.zeros(len(block.seq), bool)
    begins[block.begin[:-1]] = True
    opening, h = np.full((1, place.shape[1]), block.end), np.zeros((place.shape[1], HIDDEN), np.float32)
    for t in range(0, len(place), WINDOW):
        at, first = place[t : t + WINDOW], opens[t : t + WINDOW]
        word = block.seq[at]
        tokens = np.concatenate([opening, given[word]])
        opening, tokens = tokens[-1:], tokens[:-1]
        tokens[first] = block.end
        # pieces that go on with a document see the word before them
        inner = first & ~begins[at]
        tokens[inner] = given[block.seq[at[inner] - 1]]
        _, h, grads = model.gradients(h, tokens, first, cls[word], block.member[word])
        optimizer.update(model.parameters(), grads)
    return model


@reused_memory()
def _score(block: _Block, corpus: Corpus, model: Gru) -> np.ndarray:
    """Natural log-probability of every document."""
    out = np.zeros(len(block.doc))
    sizes = block.n.astype(np.int64)
    lanes = lanes_of(sizes, SCORE_LANES)
    whole = corpus.tokens + 0.5 * (corpus.types + 1)
    unigram = np.log((block.counts + 0.5) / whole)
    place = [np.concatenate([np.arange(block.begin[d], block.begin[d + 1]) for d in docs]) if docs else np.zeros(0, np.int64) for docs in lanes]
    length = np.array([len(p) for p in place])
    where = np.zeros((len(lanes), length.max() if len(length) else 0), np.int64)
    for i, p in enumerate(place):
        where[i, : len(p)] = p
    where = np.ascontiguousarray(where.T)
    opening = np.zeros(len(block.seq), bool)
    opening[block.begin[:-1]] = True
    before = np.empty(len(block.seq), np.int64)
    before[1:] = block.given[block.seq[:-1]]
    before[opening] = block.end
    logp = np.zeros(len(block.seq))
    h = np.zeros((len(lanes), HIDDEN), np.float32)
    for t in range(0, len(where), SCORE_WINDOW):
        live = int((length > t).sum())  # lanes are ordered by length
        at = where[t : t + SCORE_WINDOW, :live]
        inside = t + np.arange(len(at))[:, None] < length[None, :live]
        states, h, _ = model.window(h[:live], before[at], opening[at])
        at, states = at[inside], states[inside]
        word = block.seq[at]
        logp[at] = model.outputs(states, block.cls[word], block.member[word]) + block.share[word]
    logp = np.logaddexp(np.log(1 - UNIGRAM) + logp, np.log(UNIGRAM) + unigram[block.seq])
    np.add.at(out, np.repeat(np.arange(len(sizes)), sizes), logp)
    return out


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, rest: int = 1) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (base-10 logs).

    rest: remainder by 5 of the identifier's checksum that is held out.
    """
    spark = docs.sparkSession
    blocks = group_count(text_bytes(docs), BLOCK_BYTES / 1e6)
    buckets = max(1, round(blocks * BLOCK_BYTES / 200 / BUCKET_WORDS))
    packs = checkpointed(in_order(docs).mapInArrow(blocks_of, "g long, block binary").repartition(blocks, "g"))
    replies = checkpointed(_counts(packs, buckets, rest))
    corpus = _corpus(replies)
    known = spark.sparkContext.broadcast(corpus)
    answers = replies.filter(F.col("g") != _OWN)
    model = corpus.model()
    least = packs.agg(F.min("g")).first()[0]
    used = {r[0] for r in packs.select(F.pmod(F.col("g"), F.lit(ROUNDS))).distinct().collect()}  # ROUNDS at most
    merged = "sub int, n long, block binary"

    def add(key, data):
        total, n = None, 0
        for k, block in zip(data["n"].to_pylist(), data["block"].to_pylist(), strict=True):
            p = np.frombuffer(block, np.float32).astype(np.float64)
            total, n = p if total is None else total + p, n + k
        return pa.table({"sub": pa.array([0], pa.int32()), "n": pa.array([n], pa.int64()), "block": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    copy = pa.schema([("sub", pa.int32()), ("n", pa.int64()), ("block", pa.binary())])

    def trainer(given, seed):
        def train(key, data, got):
            trained = _train(_Block(data, got, buckets, known.value), known.value, given.value, rest, seed) if data.num_rows else None
            if trained is None:
                return copy.empty_table()
            flat = np.concatenate([p.ravel() for p in trained.parameters()])
            return pa.Table.from_arrays([pa.array([key[0].as_py() % 64], pa.int32()), pa.array([1], pa.int64()), pa.array([flat.tobytes()], pa.binary())], schema=copy)

        return train

    for r in range(ROUNDS if corpus.tokens else 0):
        given = spark.sparkContext.broadcast(model.parameters())
        chosen = taking(r, used, least)
        copies = packs.filter(chosen).groupBy("g").cogroup(answers.filter(chosen).groupBy("g")).applyInArrow(trainer(given, r), merged)
        # one row: the sum of all copies, of fixed size
        for row in copies.groupBy("sub").applyInArrow(add, merged).groupBy("sub").applyInArrow(add, merged).collect():
            flat, at, mean = np.frombuffer(bytes(row.block), np.float32) / np.float32(row.n), 0, []
            for p in model.parameters():
                mean.append(flat[at : at + p.size].reshape(p.shape))
                at += p.size
            model.load(mean)
    final = spark.sparkContext.broadcast(model.parameters())

    def score(key, data, got):
        if not data.num_rows:
            return _SCORES.empty_table()
        stats = known.value
        tables = []
        for i in range(data.num_rows):  # equal blocks have one name
            block = _Block(data.slice(i, 1), got, buckets, stats)
            reader = stats.model()
            reader.load(final.value)
            base = np.log10((block.counts + 0.5) / (stats.tokens + 0.5 * (stats.types + 1)))
            n, begin = block.n.astype(np.int64), block.begin[:-1]
            columns = [
                pa.array(block.doc, mask=block.doc == NO_ID),
                pa.array(n),
                pa.array(np.add.reduceat((block.counts > 0)[block.seq].astype(np.int64), begin)),
                pa.array(np.full(len(n), stats.tokens, np.int64)),
                pa.array(np.add.reduceat(base[block.seq], begin)),
                pa.array(_score(block, stats, reader) / np.log(10)),
            ]
            tables.append(pa.Table.from_arrays(columns, schema=_SCORES))
        return pa.concat_tables(tables)

    return packs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(score, SCORES)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
