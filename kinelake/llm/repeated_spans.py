"""Removal of byte spans that repeat across documents, by suffix arrays.

`remove_repeated_spans` takes out of each document every byte that is covered
by a string of `length` bytes which also starts in a document with a smaller
identifier.  Every string of that length belongs to one *anchor*: the substring
of `anchor` bytes inside it with the smallest hash.  Equal strings have equal
anchors.  A maximal run of starts with one anchor is a *segment*.

1. Each group of documents sends the hashes of its anchors to buckets, each
   once.  A bucket answers whether a hash occurs in two documents.
2. For such anchors the group sends a hash of each distinct segment and its
   smallest document.  A bucket answers whether that is the smallest of all
   groups, and whether the anchor has other segments too.
3. Segments of anchors that have several are sent as bytes, once in all, by
   the group of their smallest document.  A bucket sorts the suffixes of its
   segments in two stages (`two_stage_suffix_array`), takes the common prefixes
   of neighbours, and so knows the smallest document of every string; it
   answers one bit a string.
4. The group marks the covered bytes and cuts them out.

An anchor with very many segments would fill one bucket: its segments are dealt
by their own hash in step 2 and its strings one by one in step 3.  Segments are
taken as equal when the 64-bit hashes of their anchors and of their bytes both
agree; strings are compared byte by byte.

Defined results: null text is empty; a null identifier orders after all others;
rows with the same identifier do not cover each other; texts shorter than
`length` stay whole; columns other than doc_id and text are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm.common import NO_ID, expand, gathered, group_count, ids, in_groups, packed, pieces, squeeze, table, text_bytes

LENGTH = 50
ANCHOR = 24
#: Bytes of text in a group, in one vectorised step, and in one suffix array.
GROUP_MB, STEP, SORT_BYTES = 6, 1 << 16, 1 << 20
#: Anchors in a bucket, about.  An anchor is common with so many segments in one group, or in so many groups.
BUCKET_KEYS, DENSE, COMMON = 1 << 18, 128, 1 << 14

_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT, _MASK = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


# -- suffix sorting ---------------------------------------------------------


def _words(text: np.ndarray, extra: int) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(extra + 8, np.uint8)])
    out = np.zeros(len(text) + extra, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(out)]
    return out


def _direct_sort(positions: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """positions by the text that follows them, to `depth` bytes at least; only ties are compared further."""
    order = positions[np.argsort(words[positions], kind="stable")]
    same = words[order[1:]] == words[order[:-1]]
    for at in range(8, depth, 8):
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        part = order[where]
        run = np.cumsum(np.concatenate([[False], ~same[where[1:] - 1]])) if len(where) > 1 else np.zeros(1, int)
        key = words[part + at]
        rank = np.lexsort((key, run))
        order[where] = part[rank]
        key, run = key[rank], run[rank]
        still = np.zeros(len(order) - 1, bool)
        pairs = (run[1:] == run[:-1]) & (key[1:] == key[:-1])
        still[where[1:][pairs] - 1] = True
        same = still
    return order


def two_stage_suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of text (uint8; 0 ends a segment), in order to `depth` bytes at least.

    Stage one sorts the suffixes that are smaller than their successors.  Stage
    two scans the buckets of first bytes upwards: each suffix found puts its
    predecessor, if that is larger than it, at the head of the predecessor's
    bucket; within a bucket runs of one byte follow in rounds.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    known = np.where(step != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    smaller = step[known] > 0
    words = _words(text, depth + 8)
    stops = np.flatnonzero(text == 0)
    direct = _direct_sort(np.flatnonzero(smaller & (text > 0)), words, depth)
    first = text[direct]
    edges = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)):
        if c == 0:
            bucket = stops
        else:
            larger = waiting[c]
            front = np.concatenate(larger) if larger else np.zeros(0, np.int64)
            rounds = [front]
            while len(front):
                front = front[front > 0] - 1
                front = front[text[front] == c]
                rounds.append(front)
            bucket = np.concatenate([*rounds, direct[edges[c] : edges[c + 1]]])
            waiting[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            byte = text[before]
            rank = np.argsort(byte, kind="stable")
            before, byte = before[rank], byte[rank]
            cut = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for part in np.split(before, cut):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it (first: 0), counted up to `most`."""
    words = _words(text, most + 8)
    a, b = order[:-1], order[1:]
    got = np.zeros(len(order), np.int64)
    alive = np.arange(len(a))
    for at in range(0, most, 8):
        x = words[a[alive] + at] ^ words[b[alive] + at]
        differ = x != 0
        if differ.any():
            bits = np.frexp(x[differ].astype(np.float64))[1]  # may round up to the next power; corrected below
            high = x[differ]
            bits = np.minimum(bits, 64)
            bits = np.where((high >> np.minimum(bits - 1, 63).astype(np.uint64)) == 0, bits - 1, bits)
            got[alive[differ] + 1] = at + (64 - bits) // 8
        alive = alive[~differ]
        if not len(alive):
            break
    got[alive + 1] = most
    return np.minimum(got, most)


# -- anchors ----------------------------------------------------------------


def _anchors(body: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of all strings of `length` bytes within rows: maximal runs of starts with one anchor.

    Returns the row, the first start (in body), the count of starts, the hash of
    the anchor and that of the segment, for each run.
    """
    if length > 2.5 * anchor:
        raise ValueError("four anchors must cover a segment: length may be 2.5 times anchor at most")
    got = []
    for lo, hi in pieces(offsets, STEP):
        base, end = int(offsets[lo]), int(offsets[hi])
        for at in range(base, end, 8 * STEP):  # very long rows in steps that share length - 1 bytes
            until = min(end, at + 8 * STEP + length - 1)
            if until - at >= length:
                got.append(_anchors_of(body[at:until], at, offsets, lo, hi, length, anchor, min(8 * STEP, end - at)))
    if not got:
        return _NO_RUNS
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


_NO_RUNS = (*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 2)


def _anchors_of(x, base, offsets, lo, hi, length, anchor, most):
    h, width, total = _TABLE[x], 1, None
    power, used = int(_MULT), 0
    left = anchor
    while left:  # hashes of 1, 2, 4 ... bytes, combined by the bits of the anchor's length
        if left & 1:
            total = h if total is None else total[: len(total) - width] * np.uint64(power) + h[used : used + len(total) - width]
            used += width
        left >>= 1
        if left:
            h = h[:-width] * np.uint64(power) + h[width:]
            power, width = (power * power) & _MASK, width * 2
    h = total[: len(x) - anchor + 1]
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - anchor + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    spot = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = offsets[lo + 1 : hi + 1] - base
    begins = offsets[lo:hi] - base
    n = min(len(spot), most)
    # starts whose string crosses the end of its row are no strings
    flags = np.zeros(len(x) + 2, np.int32)
    good = ends - begins >= length
    b, e = np.clip(begins[good], 0, len(x)), np.clip(ends[good] - length + 1, 0, len(x))
    np.add.at(flags, b, 1)
    np.add.at(flags, np.maximum(e, b), -1)
    valid = np.flatnonzero(np.cumsum(flags)[:n] > 0)
    if not len(valid):
        return _NO_RUNS
    spot = spot[valid]
    row = np.searchsorted(ends, valid, "right")
    new = np.concatenate([[True], (spot[1:] != spot[:-1]) | (valid[1:] != valid[:-1] + 1) | (row[1:] != row[:-1])])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(valid)))
    first = valid[heads]
    last = first + count + length - 1 - anchor
    segment = np.zeros(len(heads), np.uint64)
    for at in (first, np.minimum(first + anchor, last), np.maximum(last - anchor, first), last):
        segment = (segment ^ h[at]) * _MULT
        segment ^= segment >> np.uint64(31)
    return row[heads] + lo, first + base, count, h[spot[heads]], segment ^ count.astype(np.uint64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where any of the (sorted) columns changes, the first row included."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class _Group:
    """A group of documents with its anchors and segments; the same whenever it is made from the same rows."""

    def __init__(self, data: pa.Table, length: int, anchor: int, buckets: int):
        doc = ids(data["doc_id"])
        body, offsets = packed(data["text"])
        order = np.argsort(doc, kind="stable")
        if len(order) > 1 and (doc[order][1:] == doc[order][:-1]).any():
            # rows of one identifier in the order of their texts, so that any arrival order gives one result
            raw = body.tobytes()
            order = np.array(sorted(range(len(doc)), key=lambda i: (doc[i], raw[offsets[i] : offsets[i + 1]])))
        self.body, sizes = gathered(body, offsets, order)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.doc, self.length, self.buckets = doc[order], length, buckets
        row, self.start, self.count, key, segment = _anchors(self.body, self.offsets, length, anchor)
        self.run_doc = self.doc[row]
        by = np.lexsort((self.run_doc, segment, key))
        key, segment, owner = key[by], segment[by], self.run_doc[by]
        heads = _heads(key, segment)
        self.of_run = np.empty(len(by), np.int64)
        self.of_run[by] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(by))))
        # of each distinct segment: anchor, hash, least document, place, count of starts
        self.key, self.segment, self.least, self.at, self.starts = key[heads], segment[heads], owner[heads], self.start[by][heads], self.count[by][heads]
        first = _heads(self.key)
        self.keys = self.key[first]
        self.key_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(self.key))))
        runs = _heads(key)
        self.several = np.minimum.reduceat(owner, runs) < np.maximum.reduceat(owner, runs) if len(runs) else np.zeros(0, bool)
        self.dense = np.bincount(self.key_of, minlength=len(self.keys)) >= DENSE
        self.cuts = np.searchsorted(_bucket(self.keys, buckets), np.arange(buckets + 1))

    def anchor_blocks(self):
        """For each bucket: five bytes an anchor, of which two bits tell that two documents have it and that it is dense."""
        coded = (self.keys & np.uint64((1 << 38) - 1)) << np.uint64(2) | self.several.astype(np.uint64) << np.uint64(1) | self.dense.astype(np.uint64)
        for b in range(self.buckets):
            if self.cuts[b] < self.cuts[b + 1]:
                yield b, _five(coded[self.cuts[b] : self.cuts[b + 1]])

    def read_anchors(self, answers: dict[int, bytes]):
        shared, common = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        for b, blob in answers.items():
            n = self.cuts[b + 1] - self.cuts[b]
            bits = np.unpackbits(np.frombuffer(blob, np.uint8))
            shared[self.cuts[b] : self.cuts[b + 1]], common[self.cuts[b] : self.cuts[b + 1]] = bits[:n], bits[n : 2 * n]
        self.common = common[self.key_of]
        self.asked = np.flatnonzero(shared[self.key_of])
        # a common anchor's segments are dealt by their own hash
        name = np.where(self.common, self.segment, self.key)[self.asked]
        bucket = _bucket(name, self.buckets)
        by = np.argsort(bucket, kind="stable")
        self.asked, self.name, bucket = self.asked[by], name[by], bucket[by]
        self.ask_cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))

    def segment_blocks(self):
        for b in range(self.buckets):
            part = slice(self.ask_cuts[b], self.ask_cuts[b + 1])
            mine = self.asked[part]
            if len(mine):
                name = (self.name[part] & np.uint64((1 << 39) - 1)) << np.uint64(1) | self.common[mine].astype(np.uint64)
                yield b, squeeze(name, self.segment[mine], self.least[mine])

    def read_segments(self, answers: dict[int, bytes]):
        self.owned, self.sought = np.zeros(len(self.key), bool), np.zeros(len(self.key), bool)
        for b, blob in answers.items():
            mine = self.asked[self.ask_cuts[b] : self.ask_cuts[b + 1]]
            bits = np.unpackbits(np.frombuffer(blob, np.uint8))
            self.owned[mine], self.sought[mine] = bits[: len(mine)], bits[len(mine) : 2 * len(mine)]
        sent = np.flatnonzero(self.owned & self.sought)
        parts = np.where(self.common[sent], self.starts[sent], 1)
        # units: whole segments, or the strings of a common anchor one by one
        self.unit = np.repeat(sent, parts)
        inner = np.arange(len(self.unit)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.unit_at = self.at[self.unit] + inner
        self.unit_starts = np.where(self.common[self.unit], 1, self.starts[self.unit])
        name = self.key[self.unit].copy()
        raw = self.body
        for i in np.flatnonzero(self.common[self.unit]).tolist():
            at = self.unit_at[i]
            name[i] = int.from_bytes(hashlib.blake2b(raw[at : at + self.length].tobytes(), digest_size=8).digest(), "little")
        bucket = _bucket(name, self.buckets)
        self.unit_by = np.argsort(bucket, kind="stable")
        self.unit_name, self.unit_cuts = name, np.searchsorted(bucket[self.unit_by], np.arange(self.buckets + 1))

    def unit_blocks(self):
        for b in range(self.buckets):
            mine = self.unit_by[self.unit_cuts[b] : self.unit_cuts[b + 1]]
            if len(mine):
                sizes = self.unit_starts[mine] + self.length - 1
                begins = np.stack([self.unit_at[mine], self.unit_at[mine] + sizes], 1).ravel()
                text, _ = gathered(self.body, begins, 2 * np.arange(len(mine)))
                yield b, squeeze(sizes.astype(np.uint32), self.unit_name[mine], self.least[self.unit[mine]], text)

    def covered(self, answers: dict[int, bytes]) -> np.ndarray:
        """A flag for each byte."""
        begins = np.concatenate([[0], np.cumsum(self.unit_starts)]).astype(np.int64)
        hit = np.zeros(begins[-1], bool)
        for b, blob in answers.items():
            mine = self.unit_by[self.unit_cuts[b] : self.unit_cuts[b + 1]]
            where, _ = gathered(np.arange(begins[-1]), begins, mine)
            hit[where] = np.unpackbits(np.frombuffer(blob, np.uint8))[: len(where)]
        asked = np.zeros(len(self.key), bool)
        asked[self.asked] = True
        cover = np.zeros(len(self.body) + 1, np.int32)
        first = self.run_doc == self.least[self.of_run]
        whole = np.flatnonzero(asked[self.of_run] & ~(first & self.owned[self.of_run]))
        np.add.at(cover, self.start[whole], 1)
        np.add.at(cover, self.start[whole] + self.count[whole] + self.length - 1, -1)
        some = np.flatnonzero(first & (self.owned & self.sought)[self.of_run])
        if len(some):
            # the strings of a segment lie one after the other, whether they travelled together or not
            heads = _heads(self.unit)
            begin = np.zeros(len(self.key), np.int64)
            begin[self.unit[heads]] = begins[heads]
            spot = begin[self.of_run[some]]
            span = np.stack([spot, spot + self.count[some]], 1).ravel()
            flags, sizes = gathered(hit, span, 2 * np.arange(len(some)))
            at = np.arange(len(flags)) + np.repeat(self.start[some] - (np.cumsum(sizes) - sizes), sizes)
            np.add.at(cover, at[flags], 1)
            np.add.at(cover, at[flags] + self.length, -1)
        return np.cumsum(cover)[:-1] > 0


def _five(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _cut(parts: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([len(p) for p in parts])[:-1]


def _share_anchors(blobs: list[bytes]) -> list[bytes]:
    """A bit an anchor for: two documents have it; then a bit for: it is common."""
    parts = [_from_five(b) for b in blobs]
    every = np.concatenate(parts)
    _, which, groups = np.unique(every >> np.uint64(2), return_inverse=True, return_counts=True)
    shared, common = groups > 1, groups > COMMON
    shared[which[(every & np.uint64(2)) > 0]] = True
    common[which[(every & np.uint64(1)) > 0]] = True
    return [np.packbits(np.concatenate([shared[w], common[w]])).tobytes() for w in np.split(which, _cut(parts))]


def _share_segments(blobs: list[bytes]) -> list[bytes]:
    """A bit a segment for: no group has a smaller document with it; then a bit for: its anchor has others."""
    parts = [expand(b) for b in blobs]
    name, segment, least = (np.concatenate([p[k] for p in parts]) for k in range(3))
    name, segment = name.view(np.uint64), segment.view(np.uint64)
    by = np.lexsort((least, segment, name))
    heads = _heads(name[by], segment[by])
    sizes = np.diff(np.append(heads, len(by)))
    owned, sought = np.zeros(len(by), bool), np.zeros(len(by), bool)
    owned[by] = least[by] == np.repeat(least[by][heads], sizes)
    _, of, kinds = np.unique(name[by][heads], return_inverse=True, return_counts=True)
    sought[by] = np.repeat((kinds > 1)[of], sizes) | ((name[by] & np.uint64(1)) > 0)
    cuts = _cut([p[0] for p in parts])
    return [np.packbits(np.concatenate([o, s])).tobytes() for o, s in zip(np.split(owned, cuts), np.split(sought, cuts), strict=True)]


def _least_documents(text: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For the segments in text one after the other: the least document of every string, in order."""
    begins = np.cumsum(sizes + 1) - sizes - 1
    marked = np.zeros(int(sizes.sum()) + len(sizes), np.uint8)
    at = np.arange(len(text)) + np.repeat(np.arange(len(sizes)), sizes)
    marked[at] = text + 1  # UTF-8 has no byte above 0xF4, so 0 is free to end segments
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    begin = np.zeros(len(marked), bool)
    begin[at] = np.arange(len(text)) <= np.repeat(np.cumsum(sizes) - length, sizes)
    order = two_stage_suffix_array(marked, length)
    order = order[begin[order]]
    heads = np.flatnonzero(common_prefixes(marked, order, length) < length)
    best = np.minimum.reduceat(least[owner[order]], heads)
    of = np.zeros(len(marked), np.int64)
    of[order] = np.repeat(best, np.diff(np.append(heads, len(order))))
    return of[begin]


def _judge(blobs: list[bytes], length: int) -> list[bytes]:
    """A bit for each string of the units of one bucket: a smaller document has it."""
    parts = [expand(b) for b in blobs]
    sizes, name, least, text = (np.concatenate([p[k] for p in parts]) for k in range(4))
    sizes = sizes.astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out_at = np.concatenate([[0], np.cumsum(sizes - length + 1)])
    out = np.zeros(out_at[-1], bool)
    by = np.argsort(name, kind="stable")
    heads = _heads(name[by])
    runs = np.diff(np.append(heads, len(by)))
    by = by[np.repeat(runs > 1, runs)]  # a name alone has no equal
    if len(by):
        heads = np.append(_heads(name[by]), len(by))
        filled = np.concatenate([[0], np.cumsum(sizes[by])])[heads]
        lo = 0
        while lo < len(heads) - 1:
            hi = max(lo + 1, int(np.searchsorted(filled, filled[lo] + SORT_BYTES, "right")) - 1)
            mine = by[heads[lo] : heads[hi]]
            best = _least_documents(gathered(text, at, mine)[0], sizes[mine], least[mine], length)
            where, n = gathered(np.arange(len(out)), out_at, mine)
            out[where] = best < np.repeat(least[mine], n)
            lo = hi
    cuts = out_at[np.cumsum([0] + [len(p[0]) for p in parts])]
    return [np.packbits(out[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_REQUEST = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("block", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))])
REQUEST, RESULT = "bucket int, g int, block binary", "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>"


def _requests(g: int, blocks) -> pa.Table:
    listed = list(blocks)
    return pa.Table.from_arrays([pa.array([b for b, _ in listed], pa.int32()), pa.array([g] * len(listed), pa.int32()), pa.array([x for _, x in listed], pa.binary())], schema=_REQUEST)


def _replies(bucket: int, data: pa.Table, answer) -> pa.Table:
    blobs = answer(data["block"].to_pylist())
    return pa.Table.from_arrays([pa.array([bucket] * len(blobs), pa.int32()), data["g"].combine_chunks(), pa.array(blobs, pa.binary())], schema=_REQUEST)


def _by_step(answers: pa.Table) -> dict[str, dict[int, bytes]]:
    out: dict = {"anchors": {}, "segments": {}, "strings": {}}
    for step, bucket, block in zip(answers["step"].to_pylist(), answers["bucket"].to_pylist(), answers["block"].to_pylist(), strict=True):
        out[step][bucket] = block
    return out


def _cut_out(group: _Group, gone: np.ndarray) -> pa.Table:
    columns: list[list] = [[], [], [], [], [], []]
    for doc, a, b in zip(group.doc.tolist(), group.offsets[:-1], group.offsets[1:], strict=True):
        mask = gone[a:b]
        edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
        spans = np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)], 1)
        for column, x in zip(columns, (None if doc == NO_ID else doc, b - a, int(mask.sum()), len(spans), group.body[a:b][~mask].tobytes(), spans.tolist()), strict=True):
            column.append(x)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)


def remove_repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay), spans.

    spans lists [start, stop) of the removed runs.  See the module's text.
    """
    total = text_bytes(docs)
    groups = group_count(total, GROUP_MB)
    buckets = max(1, round(total * 2 / (length - anchor + 2) / BUCKET_KEYS))
    rows = in_groups(docs, groups)

    def ask_anchors(key, data):
        return _requests(key[0].as_py(), _Group(data, length, anchor, buckets).anchor_blocks())

    def ask_segments(key, data, answers):
        if not data.num_rows:
            return _REQUEST.empty_table()
        group = _Group(data, length, anchor, buckets)
        group.read_anchors(_by_step(answers)["anchors"])
        return _requests(key[0].as_py(), group.segment_blocks())

    def ask_strings(key, data, answers):
        if not data.num_rows:
            return _REQUEST.empty_table()
        group, got = _Group(data, length, anchor, buckets), _by_step(answers)
        group.read_anchors(got["anchors"])
        group.read_segments(got["segments"])
        return _requests(key[0].as_py(), group.unit_blocks())

    def cut(key, data, answers):
        if not data.num_rows:
            return _RESULT.empty_table()
        group, got = _Group(data, length, anchor, buckets), _by_step(answers)
        group.read_anchors(got["anchors"])
        group.read_segments(got["segments"])
        return _cut_out(group, group.covered(got["strings"]))

    def answered(asked: DataFrame, step: str, answer) -> DataFrame:
        return asked.groupBy("bucket").applyInArrow(lambda k, t: _replies(k[0].as_py(), t, answer), REQUEST).withColumn("step", F.lit(step))

    def again(replies: DataFrame, f, schema: str) -> DataFrame:
        return rows.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(f, schema)

    replies = answered(rows.groupBy("g").applyInArrow(ask_anchors, REQUEST), "anchors", _share_anchors)
    replies = replies.unionByName(answered(again(replies, ask_segments, REQUEST), "segments", _share_segments))
    replies = replies.unionByName(answered(again(replies, ask_strings, REQUEST), "strings", lambda blobs: _judge(blobs, length)))
    return again(replies, cut, RESULT)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
