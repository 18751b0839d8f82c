"""Vectorised word splitting and hashing over many texts at once.

Words are the runs of bytes other than space and 0x09-0x0D, A-Z lower-cased;
they never cross texts.  All work is done in steps that fit a core's cache.
"""

from __future__ import annotations

import numpy as np

from kinelake.llm.common import pieces

STEP = 1 << 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE[_SPACE] = 0


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(64)


def word_hashes(body: np.ndarray, offsets: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in order: row, hash, first byte and end (in body).

    blank: 256 flags of further bytes that separate words.
    """
    space, value = _SPACE, _BYTE
    if blank is not None:
        space = _SPACE | blank
        value = np.where(space, np.uint64(0), _BYTE)
    out = []
    for lo, hi in pieces(offsets, STEP):
        base, end = int(offsets[lo]), int(offsets[hi])
        if end == base:
            continue
        x = body[base:end]
        gap = space[x]
        first = np.empty(len(x), bool)
        first[0] = True
        first[1:] = gap[:-1]
        at = offsets[lo:hi] - base
        first[at[at < len(x)]] = True
        first &= ~gap
        begin = np.flatnonzero(first)
        if not len(begin):
            continue
        last = np.empty(len(x), bool)
        last[-1] = True
        last[:-1] = gap[1:]
        stop = offsets[lo + 1 : hi + 1] - base
        last[stop[stop > 0] - 1] = True
        last &= ~gap
        finish = np.flatnonzero(last) + 1
        size = finish - begin
        table = _POWERS if size.max() <= len(_POWERS) else powers(int(size.max()))
        place = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x)))) if begin[0] == 0 else np.arange(len(x)) - np.concatenate([np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.append(begin, len(x))))])
        h = np.add.reduceat(value[x] * table[np.where(gap, 0, place)], begin)
        row = np.searchsorted(stop, begin, "right")
        out.append((row + lo, mix(h + size.astype(np.uint64) * _M2), begin + base, finish + base))
    if not out:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def shingle_sets(body: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `words`-word shingles, ascending within each row, and their n + 1 offsets by row.

    A row of fewer words has one shingle, of all its words; one without words has none.
    """
    n = len(offsets) - 1
    row, h, _, _ = word_hashes(body, offsets)
    count = np.bincount(row, minlength=n)
    begin = np.cumsum(count) - count
    weight = powers(words + 1)[1:]
    full = np.maximum(len(h) - words + 1, 0)
    total = np.zeros(full, np.uint64)
    for k in range(words):
        total += h[k : k + full] * weight[k]
    inside = row[:full] == row[words - 1 : words - 1 + full] if full else np.zeros(0, bool)
    rows, values = [row[:full][inside]], [mix(total[inside])]
    for i in np.flatnonzero((count > 0) & (count < words)).tolist():
        part = h[begin[i] : begin[i] + count[i]]
        rows.append(np.array([i]))
        values.append(mix((part * weight[: len(part)]).sum(keepdims=True) + np.full(1, len(part), np.uint64) * _M1))
    row, value = np.concatenate(rows), np.concatenate(values)
    by = np.lexsort((value, row))
    row, value = row[by], value[by]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[keep], value[keep]
    return value, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64)
