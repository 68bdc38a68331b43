"""Benchmark decontamination by latent semantic retrieval.

Texts become runs of word ids of the benchmark's vocabulary, stored once. Passages of WINDOW words are the rows of a TF-IDF matrix over that
vocabulary (document frequencies over all passages of the corpus; words in more than STOP of them weigh nothing, unless a benchmark item
would have fewer than 3 weighted words). A single-pass randomised SVD (sparse sign test matrix of SKETCH columns, Nystroem's
approximation) of all passages gives the corpus's RANK leading latent dimensions, each divided by its singular value: tasks sum
A'(A Omega), the driver solves the rest. One space serves all items. Windows of each text, overlapping by half, whose cosine with a passage
of an item in that space passes COSINE are candidates, all of them. A candidate whose longest common subsequence of words with all text near the window
is too short cannot be a leak and goes; any other is one if the longest common subsequence with the stretch that best fits the
item covers MOST of the item, or PART of it and ANSWER of its answer (its last sentence). Items of fewer than SHORT words
must occur word for word, are found by exact matching of their ids in a scan of their own, and have a cosine of 1.

The benchmark is read in groups of GROUP items, each with one pass of the corpus, so memory is bounded whatever its size. Texts are told
apart by two 64-bit hashes, so equal texts have equal results, however often and in whatever order docs is read. Every row has a result; null texts
and texts without words are clean; benchmark items that are null or have no words match nothing; repeated items all match under their own
ids (of any type that can be ordered; items of equal id count as one), and repeated rows have a result each. An empty benchmark leaves all rows clean; extra
columns of docs, whatever their names, are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from binweave.llm._common import SLICE_BYTES, bound_batches, delete, row_key, shared_dir, slices, stored, utf8, without
from binweave.llm.words import words

WINDOW, STOP, RANK, SKETCH, GROUP = 48, 0.05, 256, 288, 8000
COSINE, MOST, PART, ANSWER = 0.25, 0.75, 0.55, 0.8
SHORT = 8
#: Non-zero entries of the test matrix for each term; share of the mean squared singular value that keeps small ones from being blown up.
SIGNS, RIDGE = 8, 0.01
#: Word ids of a text handled at once, and the pieces in which term vectors are summed.
IDS, PIECES = 1 << 18, 32
#: Entries of the matrix, terms of windows and candidates handled at once, so that temporary arrays stay near the processor.
ENTRIES, TERMS, CANDIDATES = 1 << 12, 1 << 9, 1 << 12
_HALF = WINDOW // 2


@dataclass
class Vocabulary:
    """Sorted word hashes; id k + 1 is hashes[k], id 0 any other word."""

    hashes: np.ndarray

    def __post_init__(self) -> None:
        self.kind = np.uint16 if len(self.hashes) < 65_535 else np.uint32
        self.table = np.zeros(1 << 18, np.int32)
        slot = (self.hashes >> np.uint64(46)).astype(np.int64)
        self.table[slot[::-1]] = np.arange(len(self.hashes), dtype=np.int32)[::-1]  # the first of a slot
        self.deep = int(np.bincount(slot).max()) if len(slot) else 0

    def ids(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code), self.kind)
        if len(self.hashes):
            at = self.table[(code >> np.uint64(46)).astype(np.int64)]
            for k in range(self.deep):
                there = np.minimum(at + k, len(self.hashes) - 1)
                hit = self.hashes[there] == code
                out[hit] = there[hit] + 1
        return out


@dataclass
class Item:
    """A benchmark item as word ids, and the ids of its answer."""

    id: object
    ids: np.ndarray
    answer: np.ndarray


def benchmark_items(rows: list[tuple]) -> tuple[list[Item], Vocabulary]:
    """Items of (id, text) rows, those without words left out, and their vocabulary."""
    rows = [(k, t.encode()) for k, t in rows if t]
    if not rows:
        return [], Vocabulary(np.zeros(0, np.uint64))
    off = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]).astype(np.int64)
    data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
    w = words(data, off)
    vocabulary = Vocabulary(np.unique(w.hash))
    ids = vocabulary.ids(w.hash)
    ends = np.concatenate([[0], np.cumsum(np.isin(data, [10, 33, 46, 63]))])
    out = []
    for i, (key, _) in enumerate(rows):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if a == b:
            continue
        sentence = ends[w.start[a:b]]
        last = np.flatnonzero(sentence == sentence[-1])[0]
        last = min(int(last), max(0, (b - a) - max(4, (b - a) // 4)))
        out.append(Item(key, ids[a:b], ids[a + last : b]))
    return out, vocabulary


def pieces(items: list[Item]) -> list[tuple[int, np.ndarray]]:
    """(place of the item, ids) of passages of items: one of those of up to WINDOW words, else windows overlapping by half or more, the
    last at the item's end."""
    out = []
    for i, item in enumerate(items):
        last = max(0, len(item.ids) - WINDOW)
        out += [(i, item.ids[s : s + WINDOW]) for s in [*range(0, last, _HALF), last]]
    return out


def passages(ids: np.ndarray, first: np.ndarray, size: int, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, term) with term = id - 1, by passage, and the passages' first place in each text; texts are cut every size
    words. used: by id, whether a term is wanted."""
    n = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(-(-n // size))])
    at = np.flatnonzero(ids if used is None else used[ids])
    doc = np.searchsorted(first, at, side="right") - 1
    passage, term = begin[doc] + (at - first[doc]) // size, ids[at]
    order = np.argsort(term, kind="stable")
    t, p = term[order], passage[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
    kept = np.zeros(len(t), bool)
    kept[order[new]] = True
    return passage[kept], term[kept].astype(np.int64) - 1, begin


def _texts(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in slices(batch, "ids", IDS * np.dtype(kind).itemsize):
        data, off = utf8(part.column("ids"))
        yield part, np.frombuffer(data.tobytes(), kind), off // np.dtype(kind).itemsize


def word_ids(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """(h1, h2, id, ids): the texts as binary runs of ids, with two hashes that tell texts apart."""
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("id", docs.schema[key].dataType), T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                w = words(*utf8(part.column("text")))
                ids = vocabulary.ids(w.hash)
                raw = [ids[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("h1", "h2", "id")], pa.array(raw, pa.binary())], names=schema.names)

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.xxhash64(body).alias("h1"), F.xxhash64(F.lit("second"), body).alias("h2"), F.col(f"`{key}`").alias("id"), body.alias("text")).mapInArrow(run, schema)


def frequencies(table: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many passages each term is, and how many passages there are."""
    size, kind = len(vocabulary.hashes), vocabulary.kind

    def run(batches):
        count = np.zeros(size + 1, np.int64)  # at last the passages themselves
        for batch in batches:
            for _, ids, first in _texts(batch, kind):
                _, term, begin = passages(ids, first, WINDOW)
                count[:-1] += np.bincount(term, minlength=size)
                count[-1] += begin[-1]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some], pa.int64())], names=["term", "n"])

    got = table.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def weights(df: np.ndarray, n: int, items: list[Item]) -> np.ndarray:
    """IDF of each term, 0 for stop words that no item needs."""
    idf = np.log((n + 1) / (df + 1)).clip(0.01)
    stop = df > STOP * n
    for item in items:
        term = np.unique(item.ids).astype(np.int64) - 1
        if (~stop[term]).sum() < 3:
            stop[term] = False
    return np.where(stop, 0, idf)


def sign_matrix(size: int, columns: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Omega as the columns (size x SIGNS) of each row's entries and their signs."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, columns, (size, SIGNS)), np.where(rng.random((size, SIGNS)) < 0.5, -1, 1).astype(np.float32)


def _products(passage: np.ndarray, term: np.ndarray, x: np.ndarray, omega: tuple[np.ndarray, np.ndarray], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their rows of A'(A omega) for the entries of some passages, sorted by passage."""
    at = passage - passage[0]
    n = int(at[-1]) + 1
    y = np.bincount((at[:, None] * columns + omega[0][term]).ravel(), (omega[1][term] * x[:, None]).ravel(), n * columns).reshape(n, columns).astype(np.float32)
    order = np.argsort(term, kind="stable")
    term = term[order]
    rows = y[at[order]]
    rows *= x[order, None]
    new = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    return term[new], np.add.reduceat(rows, new)


def sketch(table: DataFrame, vocabulary: Vocabulary, weight: np.ndarray, columns: int, seed: int = 11) -> np.ndarray:
    """A'(A Omega) over all passages of the corpus; partial sums are as many as 2 for each core."""
    size, kind, used = len(weight), vocabulary.kind, np.append(False, weight > 0)
    cut = np.linspace(0, size, PIECES + 1).astype(int)

    def partial(batches):
        omega = sign_matrix(size, columns, seed)
        z = np.zeros((size, columns), np.float32)
        for batch in batches:
            for _, ids, first in _texts(batch, kind):
                passage, term, _ = passages(ids, first, WINDOW, used)
                x = weight[term]
                x = (x / np.sqrt(np.bincount(passage, x * x))[passage] if len(x) else x).astype(np.float32)  # rows of length 1
                for a in range(0, len(x), ENTRIES):
                    b = min(a + ENTRIES, len(x))
                    a = a if not a else int(np.searchsorted(passage, passage[a]))
                    b = b if b == len(x) else int(np.searchsorted(passage, passage[b]))
                    if a < b:
                        t, rows = _products(passage[a:b], term[a:b], x[a:b], omega, columns)
                        z[t] += rows
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([z[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["piece", "z"])

    def total(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("piece").to_pylist(), batch.column("z").to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(raw, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["piece", "z"])

    spark = table.sparkSession
    parts = table.select("ids").coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(partial, "piece int, z binary")
    z = np.zeros((size, columns), np.float32)
    for k, raw in parts.repartition(PIECES, "piece").mapInArrow(total, "piece int, z binary").collect():
        z[cut[k] : cut[k + 1]] = np.frombuffer(raw, np.float32).reshape(-1, columns)
    return z


def latent_space(z: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """(terms x rank): leading right singular vectors of the matrix whose sketch is z = A'A Omega, by Nystroem's approximation, each
    divided by its singular value (with a ridge)."""
    size, columns = z.shape
    place, sign = sign_matrix(size, columns, seed)
    shift = max(1e-6 * float(np.linalg.norm(z)), 1e-9)
    y = z.astype(np.float64)
    for k in range(SIGNS):
        np.add.at(y, (np.arange(size), place[:, k]), shift * sign[:, k])  # of A'A + shift, to be definite
    core = np.zeros((columns, columns))
    for a in range(0, size, 4096):
        for k in range(SIGNS):
            np.add.at(core, place[a : a + 4096, k], sign[a : a + 4096, k, None] * y[a : a + 4096])
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value[-1], 0) * 1e-8
    half = y @ (vector[:, good] / np.sqrt(value[good]))  # A'A is about half half'
    square, turn = np.linalg.eigh(half.T @ half)
    lead = [k for k in np.argsort(-square)[:rank].tolist() if square[k] > max(1e-8 * square[-1], 2 * shift)]
    if not lead:
        return np.zeros((size, 0), np.float32)
    return (half @ (turn[:, lead] / np.sqrt(square[lead] * (square[lead] + RIDGE * square[lead].mean())))).astype(np.float32)


def longest_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    place: dict[int, int] = {}
    for i, t in enumerate(a.tolist()):
        place[t] = place.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b.tolist():
        if m := place.get(t):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def fit(item: Item, text: np.ndarray, start: int, stop: int) -> tuple[float, float, int, int] | None:
    """(share of the item, share of its answer, first and end word) of the best of all stretches of text near [start, stop) that are leaks."""
    n = len(item.ids)
    length = n if n < SHORT else int(1.25 * n) + 2
    a, b = max(0, start - n), min(len(text), stop + n)
    near = text[a:b]
    inside = np.concatenate([[0], np.cumsum(np.isin(near, item.ids))])
    length = min(length, len(near))
    if n < SHORT:
        hits = [s for s in range(len(near) - n + 1) if (near[s : s + n] == item.ids).all()]
        return (1.0, 1.0, a + hits[0], a + hits[0] + n) if hits else None
    many = inside[length:] - inside[: len(inside) - length]
    most = many.copy()  # no common subsequence of a stretch is longer, nor by more than their distance than that of another stretch
    place = np.arange(len(many))
    best = None
    for s in np.argsort(-many, kind="stable").tolist():
        if many[s] / n < PART or best and many[s] < best[0]:
            break
        if most[s] / n < PART or best and (most[s], 1.0) <= best[:2]:
            continue
        common = longest_common(item.ids, near[s : s + length])
        most = np.minimum(most, common + np.abs(place - s))
        if common / n < PART:
            continue
        answer = longest_common(item.answer, near[s : s + length]) / len(item.answer)
        if (common / n >= MOST or answer >= ANSWER) and (best is None or (common, answer) > best[:2]):
            best = (common, answer, s)
    return (best[0] / n, best[1], a + best[2], a + best[2] + length) if best else None


def _found_type(kind: T.DataType) -> T.StructType:
    """Of leaks: the text's hashes, the item's id, cosine, shares of item and answer, and word places."""
    return T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("item", kind), *[T.StructField(c, T.DoubleType()) for c in ("cosine", "lcs", "answer")], *[T.StructField(c, T.LongType()) for c in ("start", "stop")]])


def _found(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(schema.fields)], names=schema.names)


def _masks(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each 64 words of an item: its distinct ids, bits of the places of each, and how many words."""
    out = []
    for a in range(0, len(ids), 64):
        part = ids[a : a + 64]
        distinct, which = np.unique(part, return_inverse=True)
        bits = np.zeros(len(distinct), np.uint64)
        np.bitwise_or.at(bits, which, np.uint64(1) << np.arange(len(part), dtype=np.uint64))
        out.append((distinct, bits, len(part)))
    return out


def most_in_common(near: np.ndarray, owner: np.ndarray, masks: list[list[tuple]]) -> np.ndarray:
    """For each row of near (word ids, 0 for none) a number that the longest common subsequence with its owner's words does not pass; the
    length itself for owners of up to 64 words. Owners come in order. Bit-parallel, all rows at once."""
    total = np.zeros(len(near), np.int64)
    run = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    end = np.append(run[1:], len(owner))
    for c in range(max(len(masks[i]) for i in owner[run].tolist())):
        bits = np.zeros(near.shape, np.uint64)
        n = np.zeros(len(near), np.uint64)
        for a, b, i in zip(run.tolist(), end.tolist(), owner[run].tolist(), strict=True):
            if c < len(masks[i]):
                distinct, bit, n[a:b] = masks[i][c]
                at = np.minimum(np.searchsorted(distinct, near[a:b]), len(distinct) - 1)
                bits[a:b] = np.where(distinct[at] == near[a:b], bit[at], np.uint64(0))
        row = np.full(len(near), ~np.uint64(0))
        for column in np.ascontiguousarray(bits.T):
            u = row & column
            row = (row + u) | (row - u)
        full = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))
        total += np.bitwise_count(~row & full).astype(np.int64)
    return total


def targets(weight: np.ndarray, space: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(terms x rank) what a term adds to a passage's vector, and (rank x parts) the unit vectors of items' parts."""
    mapped = (space * weight[:, None]).astype(np.float32)
    out = np.stack([mapped[np.unique(ids).astype(np.int64) - 1].sum(0) for _, ids in parts])
    return mapped, np.ascontiguousarray((out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).T)


def candidates(ids: np.ndarray, first: np.ndarray, used: np.ndarray, mapped: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows (as the number of their first half among those of all texts), parts and cosines above COSINE; and the texts' first halves."""
    passage, term, begin = passages(ids, first, _HALF, used)
    halves = int(begin[-1])
    last = np.zeros(halves, bool)
    last[begin[1:][np.diff(begin) > 0] - 1] = True
    window, part, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    step = max(32, (1 << 18) // max(target.shape[1], 1))
    for a in range(0, halves, step):  # so many windows, and the half behind them
        b = min(a + step, halves)
        low, high = np.searchsorted(passage, (a, b + 1)).tolist()
        half = np.zeros((b + 1 - a, mapped.shape[1]), np.float32)
        for k in range(low, high, TERMS):
            p, t = passage[k : min(k + TERMS, high)] - a, term[k : min(k + TERMS, high)]
            new = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            half[p[new]] += np.add.reduceat(mapped[t], new)
        y = half[:-1].copy()
        y[~last[a:b]] += half[1:][~last[a:b]]
        length = np.maximum(np.sqrt(np.einsum("ij,ij->i", y, y)), 1e-9)
        cosine = y @ target
        k, i = np.nonzero(cosine > COSINE * length[:, None])
        window.append(a + k)
        part.append(i)
        value.append(cosine[k, i] / length[k])
    return np.concatenate(window), np.concatenate(part), np.concatenate(value), begin


def _possible(ids: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, owner: np.ndarray, size: np.ndarray, masks: list[list[tuple]]) -> np.ndarray:
    """Which candidates have enough in common with all text that fit() would look at."""
    out = np.zeros(len(doc), bool)
    order = np.lexsort((owner, size[owner]))  # rows of like width together
    for k in range(0, len(order), CANDIDATES):
        at = order[k : k + CANDIDATES]
        at = at[np.argsort(owner[at], kind="stable")]
        n = size[owner[at]]
        low, high = np.maximum(start[at] - n, 0), np.minimum(start[at] + WINDOW + n, (first[1:] - first[:-1])[doc[at]])
        place = low[:, None] + np.arange(int((high - low).max()))
        near = np.where(place < high[:, None], ids[np.minimum(first[doc[at]][:, None] + place, len(ids) - 1)], 0)
        out[at] = most_in_common(near, owner[at], masks) >= PART * n
    return out


def search(table: DataFrame, vocabulary: Vocabulary, weight: np.ndarray, space: np.ndarray, items: list[Item], parts: list[tuple[int, np.ndarray]], schema: T.StructType) -> DataFrame:
    """Leaks of items in the texts: by cosine of the items' parts with windows, then by what they have in common, and then by fit()."""
    kind, used = vocabulary.kind, np.append(False, weight > 0)
    mapped, target = targets(weight, space, parts)
    owner, size = np.array([i for i, _ in parts]), np.array([len(x.ids) for x in items])

    def run(batches):
        masks = [_masks(x.ids) for x in items]
        for batch in batches:
            for part, ids, first in _texts(batch, kind):
                h1, h2 = part.column("h1").to_pylist(), part.column("h2").to_pylist()
                window, which, cosine, begin = candidates(ids, first, used, mapped, target)
                doc = np.searchsorted(begin, window, side="right") - 1
                start = (window - begin[doc]) * _HALF
                good = np.flatnonzero(_possible(ids, first, doc, start, owner[which], size, masks))
                hits: dict[tuple[int, int], list[tuple[float, int]]] = {}
                for d, i, c, s in zip(doc[good].tolist(), owner[which[good]].tolist(), cosine[good].tolist(), start[good].tolist(), strict=True):
                    hits.setdefault((d, i), []).append((c, s))
                out = []
                for (d, i), windows in hits.items():
                    text = ids[first[d] : first[d + 1]]
                    best = None
                    for c, s in sorted(windows, reverse=True):
                        got = fit(items[i], text, s, s + WINDOW)
                        if got and (best is None or got[:2] > best[1][:2]):
                            best = (c, got)
                            if got[0] == 1:
                                break
                    if best:
                        out.append((h1[d], h2[d], items[i].id, best[0], *best[1]))
                yield _found(out, schema)

    return table.select("h1", "h2", "ids").mapInArrow(run, schema)


def exact(table: DataFrame, vocabulary: Vocabulary, items: list[Item], schema: T.StructType) -> DataFrame:
    """The first place of each of some items in the texts, word for word."""
    kind, by_length = vocabulary.kind, {}
    for item in items:
        by_length.setdefault(len(item.ids), {}).setdefault(tuple(item.ids.tolist()), []).append(item.id)

    def run(batches):
        size = len(vocabulary.hashes) + 1
        starts, ends = ({n: np.bincount([r[k] for r in runs], minlength=size) > 0 for n, runs in by_length.items()} for k in (0, -1))
        for batch in batches:
            for part, ids, first in _texts(batch, kind):
                h1, h2, out = part.column("h1").to_pylist(), part.column("h2").to_pylist(), {}
                for n, runs in by_length.items():
                    at = np.flatnonzero(starts[n][ids[: max(0, len(ids) - n + 1)]] & ends[n][ids[n - 1 :]])
                    doc = np.searchsorted(first, at, side="right") - 1
                    inside = at + n <= first[doc + 1]
                    for s, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                        for item in runs.get(tuple(ids[s : s + n].tolist()), ()):
                            place = s - int(first[d])
                            out.setdefault((d, item), (h1[d], h2[d], item, 1.0, 1.0, 1.0, place, place + n))
                yield _found(list(out.values()), schema)

    return table.select("h1", "h2", "ids").mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", folder: str | None = None) -> DataFrame:
    """One row for each row of docs: key, contaminated, and leaks: an array of (item, cosine, lcs, answer, start, stop), by item, with
    word places in the text."""
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or shared_dir(spark, "decontaminate")
    schema = _found_type(benchmark.schema[item].dataType)
    todo = benchmark.select(F.col(f"`{item}`").alias("id"), F.col(f"`{item_text}`").alias("text")).where(F.col("text").isNotNull()).orderBy("id", "text").toLocalIterator()
    found, rows, g = None, None, 0
    while group := list(islice(todo, GROUP)):
        items, vocabulary = benchmark_items([tuple(r) for r in group])
        if not items:
            continue
        table = stored(word_ids(docs, key, text, vocabulary), f"{folder}/ids{g}")
        hits = []
        if short := [x for x in items if len(x.ids) < SHORT]:
            hits.append(stored(exact(table, vocabulary, short, schema), f"{folder}/exact{g}"))
        df, n = frequencies(table, vocabulary)
        weight = weights(df, n, items)
        items = [x for x in items if len(x.ids) >= SHORT]
        space = latent_space(sketch(table, vocabulary, weight, SKETCH)) if items else np.zeros((0, 0), np.float32)
        if space.shape[1]:
            hits.append(stored(search(table, vocabulary, weight, space, items, pieces(items), schema), f"{folder}/found{g}"))
        for h in hits:
            found = h if found is None else found.unionByName(h)
        if rows is None:
            rows = stored(table.select("h1", "h2", "id"), f"{folder}/rows")
        delete(spark, f"{folder}/ids{g}")
        g += 1
    of_item = T.ArrayType(T.StructType([f for f in schema.fields if f.name not in ("h1", "h2")]))
    none = F.array().cast(of_item)
    if found is None:
        return docs.select(F.col(f"`{key}`").alias(key), F.lit(False).alias("contaminated"), none.alias("leaks"))
    best = found.groupBy("h1", "h2", "item").agg(F.max_by(F.struct(*of_item.elementType.names), F.struct("lcs", "answer", "cosine", "start")).alias("leak"))
    per_text = stored(best.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("leak")).alias("leaks")), f"{folder}/leaks")
    for k in range(g):
        delete(spark, f"{folder}/found{k}")
        delete(spark, f"{folder}/exact{k}")
    out = rows.join(per_text, ["h1", "h2"], "left")
    return out.select(F.col("id").alias(key), F.col("leaks").isNotNull().alias("contaminated"), F.coalesce("leaks", none).alias("leaks"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """docs without the contaminated rows; rows with the same id and text go together."""
    folder = folder or shared_dir(docs.sparkSession, "remove-leaks")
    keyed = docs.select(row_key(key, text).alias("key"), F.col(f"`{text}`").alias("text"))
    found = decontaminate(keyed, benchmark, "key", "text", folder=f"{folder}/found")
    return without(docs, stored(found.where("contaminated").select("key").distinct(), f"{folder}/leaked"), key, text)
