"""Byte-level BPE encoding and decoding by a rank file, in two tiers.

Every pre-token is looked up in a minimal perfect hash of the vocabulary, whole slices at once; those that it holds are done. Any other is
merged by a heap over a linked list of its bytes: the lowest-ranked adjacent pair first, the leftmost of equals, with ranks from the same hash
(those of all pairs of two bytes are looked up once). Equal pre-tokens of a slice are merged once, and a worker may remember the merges of
earlier slices: `memory` is how many (0: none), which changes no result.

Nulls and empty texts have no ids and decode to empty bytes; rows repeat as they come in; no text is cut; columns of the input with the name of a computed
one are replaced, all others are kept, or those in `keep`; an empty table gives no rows."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from binweave.llm._common import attach, texts


class PerfectHash:
    """Keys fall into buckets by their 64-bit hash, and each bucket has the first seed that sends its keys to free places among
    exactly len(keys); a bucket of one key names its place outright. A probe compares the key kept
    at its place, so strangers are refused."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.m = n // 3 + 1
        code = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        assert len(np.unique(code)) == n, "equal keys"
        bucket = (code % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.m + 1))
        size = np.diff(first)
        shift = np.zeros(self.m, np.int64)
        free = np.ones(n, bool)
        place = np.zeros(n, np.int64)
        for b in np.argsort(-size, kind="stable").tolist():
            if size[b] < 2:
                break
            own = order[first[b] : first[b + 1]]
            high = [int(x) >> 32 for x in code[own]]
            assert len(set(high)) == len(high), "keys that no seed parts"
            seed = tries = 0
            while len(set(at := [(h ^ seed) % n for h in high])) < len(high) or not free[at].all():
                tries += 1
                seed = tries * 0x9E3779B1 & 0x7FFFFFFF
            free[at] = False
            shift[b], place[own] = seed, at
        single = np.flatnonzero(size == 1)
        place[order[first[single]]] = rest = np.flatnonzero(free)
        shift[single] = -1 - rest
        self.shift, self._shift = shift.tolist(), shift
        self.keys: list[bytes] = [b""] * n
        self._names: list[str | None] = [None] * n  # the keys as text, where they are text
        self.values = np.zeros(n, np.int64)
        for k, v, at in zip(keys, values, place.tolist(), strict=True):
            self.keys[at], self.values[at] = k, v
            try:
                self._names[at] = k.decode()
            except UnicodeDecodeError:
                pass
        self._values = self.values.tolist()

    def get(self, key: bytes) -> int:
        """The key's value, -1 for a key that isn't there."""
        if not self.n:
            return -1
        x = xxhash.xxh3_64_intdigest(key)
        d = self.shift[x % self.m]
        at = -1 - d if d < 0 else (x >> 32 ^ d) % self.n
        return self._values[at] if self.keys[at] == key else -1

    def find(self, tokens: list[str]) -> np.ndarray:
        """The values of the UTF-8 bytes of texts, -1 for those that aren't there."""
        if not self.n or not tokens:
            return np.full(len(tokens), -1, np.int64)
        x = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        d = self._shift[(x % np.uint64(self.m)).astype(np.int64)]
        at = np.where(d < 0, -1 - d, ((x >> np.uint64(32)).astype(np.int64) ^ d) % self.n)
        same = np.fromiter(map(eq, map(self._names.__getitem__, at.tolist()), tokens), bool, len(tokens))
        return np.where(same, self.values[at], -1)


class Codec:
    """Encoder and decoder for one rank file (lines of base64 bytes and rank) and one pre-token pattern."""

    #: Longest pre-token in bytes that is remembered.
    MEMORY_BYTES = 48

    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line]
        vocabulary = {base64.b64decode(a): int(b) for a, b in pairs}
        self.table = PerfectHash(list(vocabulary), list(vocabulary.values()))
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for k, v in vocabulary.items():
            self.bytes[v] = k
        self.four = [*(i.to_bytes(4, "little") for i in range(len(self.bytes))), b""]  # the last, by -1, for what isn't there
        self.single = [self.table.get(bytes([a])) for a in range(256)]
        self.double = {(a, b): self.table.get(bytes([a, b])) for a in range(256) for b in range(256)}
        self.split = regex.compile(pattern).findall
        self.memory: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token by merges."""
        rank, n = self.table.get, len(word)
        if n == 1:
            return [self.single[word[0]]]
        after, before, id_ = list(range(1, n + 1)), list(range(-1, n - 1)), [self.single[x] for x in word]
        heap = [(r, i, i + 2) for i, r in enumerate(map(self.double.__getitem__, zip(word, word[1:]))) if r >= 0]  # noqa: B905
        heapify(heap)
        while heap:
            r, i, stop = heappop(heap)
            if id_[i] < 0 or (j := after[i]) >= n or after[j] != stop:
                continue  # one of the two parts has changed since
            id_[i], id_[j], after[i] = r, -1, stop
            if stop < n:
                before[stop] = i
                end = after[stop]
                if (r := rank(word[i:end])) >= 0:
                    heappush(heap, (r, i, end))
            if (p := before[i]) >= 0 and (r := rank(word[p:stop])) >= 0:
                heappush(heap, (r, p, stop))
        return [x for x in id_ if x >= 0]

    def encode_all(self, texts_: list[str], memory: dict[str, bytes] | None = None, most: int = 0) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers. memory: merges of earlier calls, to which those of this one are added; it is
        emptied behind a call that leaves more than `most` in it, and pre-tokens of over MEMORY_BYTES bytes do not stay."""
        tokens = list(map(self.split, texts_))
        flat = list(chain.from_iterable(tokens))
        found = self.table.find(flat)
        parts = list(map(self.four.__getitem__, found.tolist()))
        merged, long = {} if memory is None else memory, []
        for i in np.flatnonzero(found < 0).tolist():
            t = flat[i]
            if (ids := merged.get(t)) is None:
                word = t.encode()
                ids = merged[t] = np.array(self.merge(word), "<u4").tobytes()
                if len(word) > self.MEMORY_BYTES:
                    long.append(t)
            parts[i] = ids
        if len(merged) > most:
            merged.clear()
        else:
            for t in long:
                del merged[t]
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        return [b"".join(parts[a:b]) for a, b in zip([0, *ends], ends)]  # noqa: B905

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; an id outside the vocabulary raises IndexError."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    return Codec(ranks, pattern)


#: Merged pre-tokens that a Python worker remembers, from task to task.
MEMORY = 500_000


def _ranks(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


def _encoder(ranks: bytes, pattern: str, memory: int) -> Callable[[pa.Array], list[bytes]]:
    c = codec(ranks, pattern)
    return lambda column: c.encode_all([x.decode() for x in texts(column)], c.memory, memory)


def encode(df: DataFrame, text: str, vocabulary: str, pattern: str, ids: str = "ids", keep: list[str] | None = None, memory: int = MEMORY) -> DataFrame:
    """df with a binary column of ids (little-endian unsigned 32-bit); vocabulary is a rank file that the driver can read."""
    ranks = _ranks(vocabulary)

    def make():
        encoded = _encoder(ranks, pattern, memory)
        return lambda part: [pa.array(encoded(part.column(text)), pa.binary())]

    return attach(df, text, [(ids, T.BinaryType())], make, keep)


def decode(df: DataFrame, ids: str, vocabulary: str, pattern: str, decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df with a binary column of the bytes of a column of ids as encode() makes it."""
    ranks = _ranks(vocabulary)

    def make():
        c = codec(ranks, pattern)
        return lambda part: [pa.array([c.decode(x) for x in texts(part.column(ids))], pa.binary())]

    return attach(df, ids, [(decoded, T.BinaryType())], make, keep)


def round_trip(df: DataFrame, text: str, vocabulary: str, pattern: str, with_ids: bool = False, keep: list[str] | None = None, memory: int = MEMORY) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256, and the ids themselves if with_ids: encodes and decodes in one pass."""
    ranks = _ranks(vocabulary)

    def make():
        c, encoded = codec(ranks, pattern), _encoder(ranks, pattern, memory)

        def work(part):
            ids = encoded(part.column(text))
            return [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
                *([pa.array(ids, pa.binary())] if with_ids else []),
            ]

        return work

    return attach(df, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), *([("ids", T.BinaryType())] if with_ids else [])], make, keep)
