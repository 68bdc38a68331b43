"""Words of many texts at once, as 64-bit hashes, by numpy over the UTF-8 bytes.

A word is a run of ASCII letters, digits and bytes from 128 up; ASCII and Latin-1 capitals count as small letters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def lower(data: np.ndarray) -> np.ndarray:
    """Small letters for ASCII and Latin-1 capitals in UTF-8."""
    out = _LOWER[data]
    if len(out) > 1:
        lead = data[:-1] == 0xC3
        if lead.any():
            tail = out[1:]
            tail[lead & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 32
    return out


def hash_runs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes, eight bytes at a time."""
    eights = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]).view(np.uint8), (len(data) + 1, 8), (1, 1)).view("<u8")[:, 0]
    code = mix((eights[start] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * _B)
    more, at = np.flatnonzero(length > 8), 8
    while len(more):
        code[more] = mix(code[more] * _B + (eights[start[more] + at] & _MASK[np.minimum(length[more] - at, 8)]))
        at += 8
        more = more[length[more] > at]
    return code


@dataclass
class Words:
    """start, end: byte places; doc: the text of each word; first: len(texts)+1 places into the words; hash: 64 bits."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    low: np.ndarray


def words(data: np.ndarray, off: np.ndarray) -> Words:
    """The words of texts given as bytes and offsets."""
    low = lower(data)
    n = len(low)
    is_word = _IS_WORD[low]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.zeros(n, bool)
    if n:
        before[1:] = is_word[:-1]
        before &= ~cut[:n]
    start = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, bool)
    if n:
        after[:-1] = is_word[1:]
        after &= ~cut[1:]
    end = np.flatnonzero(is_word & ~after) + 1
    code = hash_runs(low, start, end - start)
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(start, end, doc, first, code, low)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of size words, and the text of each; a text of fewer words (but one at least) has one run of them all."""
    count = np.diff(w.first)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = np.minimum(count, size)[w.doc]
    at = np.arange(n) - w.first[w.doc]
    good = np.flatnonzero(at + width <= count[w.doc])
    total = np.zeros(len(good), np.uint64)
    for k in range(size):
        have = k < width[good]
        factor = np.uint64((int(_B) * (2 * k + 3) + 2 * k) & 0xFFFFFFFFFFFFFFFF | 1)
        total += np.where(have, w.hash[np.minimum(good + k, n - 1)] * factor, np.uint64(k))
    return mix(total), w.doc[good]


def distinct(key: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of each text: keys, how often each occurs, and n_docs+1 places into them."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return key[at], np.diff(np.append(at, len(key))), np.searchsorted(doc[at], np.arange(n_docs + 1))


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over values[first[i]:first[i+1]], 0 where that is empty; values may have two dimensions."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out
