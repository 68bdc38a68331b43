"""Toxicity by multiple-instance learning: a text is a bag of sentences, and is toxic if any sentence is.

A sentence's probability is a logistic function of its hashed words and word beginnings, 0 if none of them has a weight; the text's is
the noisy-or 1 - prod(1 - p). The odds that a given sentence is the offending one fall with the number of sentences, so the bias, itself trained, is lowered by
the logarithm of how many times a text has the sentences of a usual training text: clean sentences do not add up however
many there are. Only text labels train the model, so the gradient reaches a sentence through its share in the noisy-or, and the offending sentences are located
by their own probabilities. Only features that occur in toxic texts more than chance explains (a log-likelihood ratio test over the
training texts) get weights, which start at their log odds and are refined by gradient descent.

Sentences end at . ! ? and line ends. Whole texts count. Null and empty texts have no sentence, score 0 and no spans; repeated rows have equal
results; columns named as those of SCORED are replaced, others kept. Label, language, source and id are no inputs. Equal training rows count
once. Without training rows, toxic ones among them, every score is 0; an empty table gives no rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.llm._common import attach, held_out, labelled_sample, utf8
from binweave.llm.words import segment_sum, words

#: Hash bits of features, and the byte lengths of the word beginnings among them.
BITS, STEMS = 18, (4, 5, 6, 7, 8)
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (for each word itself and its beginnings, -1 where it is no longer than those), first word of each sentence
    (and one more), the text of each, and its byte range from first to last word."""
    w = words(data, off)
    n = len(w.hash)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(STEMS)), np.int32), np.zeros(1, np.int64), none, none, none
    ends = np.concatenate([[0], np.cumsum(_END[data])])
    new = np.ones(n, bool)
    new[1:] = (w.doc[1:] != w.doc[:-1]) | (ends[w.start[1:]] > ends[w.end[:-1]])
    first = np.append(np.flatnonzero(new), n)
    bucket = np.empty((n, 1 + len(STEMS)), np.int32)
    bucket[:, 0] = w.hash >> np.uint64(64 - BITS)
    long = w.end - w.start
    stem, done, last = np.zeros(n, np.uint32), 0, len(w.low) - 1
    for k, size in enumerate(STEMS):
        for j in range(done, size):
            stem = (stem ^ w.low[np.minimum(w.start + j, last)]) * np.uint32(0x01000193) + np.uint32(0x3C6EF372)
        done = size
        bucket[:, k + 1] = np.where(long > size, (stem ^ (stem >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS), -1)
    return bucket, first, w.doc[first[:-1]], w.start[first[:-1]], w.end[first[1:] - 1]


@dataclass
class NoisyOr:
    """Sentence model: weights of feature buckets (the last place, that of no feature, is 0), a bias, and the sentences of a usual text."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1, np.float32))
    bias: float = -np.inf
    usual: float = 1.0

    def lowered(self, many: np.ndarray) -> np.ndarray:
        """The bias of the sentences of texts of so many."""
        return self.bias - np.log(np.maximum(many / self.usual, 1))

    def sentence(self, bucket: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Probability of each sentence of texts."""
        weight = self.weights[bucket]
        z = np.clip(segment_sum(weight.sum(1), first) + self.lowered(np.bincount(doc)[doc]), -60, 30)
        return np.where(segment_sum((weight != 0).any(1).astype(np.int64), first) > 0, 1 / (1 + np.exp(-z)), 0)

    def bags(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Probability of each text, then of each sentence with its text and byte range."""
        bucket, first, doc, start, end = sentences(data, off)
        p = self.sentence(bucket, first, doc) if len(doc) else np.zeros(0)
        none = segment_sum(np.log1p(-np.minimum(p, 1 - 1e-12)), np.searchsorted(doc, np.arange(len(off))))
        return np.abs(np.expm1(none)), p, doc, start, end


def train(docs: list[bytes], y: np.ndarray, epochs: int = 20, rate: float = 0.05, ratio: float = 18.0, least: float = 2.0, support: float = 0.02, bias: float = -9.0, scale: float = 1.0, seed: int = 5) -> NoisyOr:
    """Gradient descent on the log loss of the noisy-or, over features whose likelihood ratio passes `ratio` and whose log odds of a
    toxic text pass `least`, in a share of `support` of the toxic texts or more."""
    model = NoisyOr()
    y = np.asarray(y, np.int64)
    if not len(docs) or not y.any():
        return model
    rng = np.random.default_rng(seed)
    bags, seen = [], np.zeros((2, 1 << BITS))
    for d, label in zip(docs, y.tolist(), strict=True):
        bucket, first, *_ = sentences(np.frombuffer(d, np.uint8), np.array([0, len(d)]))
        have = np.unique(bucket)
        seen[label, have[have >= 0]] += 1
        bags.append((bucket, first))
    n, share = seen.sum(0), y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda count, expected: np.where(count > 0, count * np.log(count / expected), 0)
        g2 = 2 * (part(seen[1], n * share) + part(seen[0], n * (1 - share)))
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - y).sum() + 1))
    chosen = (odds >= least) & (g2 >= ratio) & (seen[1] >= max(3, support * y.sum()))
    w, model.bias = model.weights, bias
    many = np.array([len(first) - 1 for _, first in bags])
    model.usual = max(1.0, float(many.mean()))
    length = np.log(np.maximum(many / model.usual, 1))
    w[:-1][chosen] = odds[chosen] * scale
    sparse = []
    for bucket, first in bags:
        flat = bucket.ravel()
        good = (flat >= 0) & chosen[flat]
        sentence = np.repeat(np.arange(len(first) - 1), np.diff(first) * bucket.shape[1])[good]
        some, sentence = np.unique(sentence, return_inverse=True)  # the others have probability 0
        sparse.append((flat[good], sentence, len(some)))
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        for i in rng.permutation(len(docs)):
            at, sentence, m = sparse[i]
            if not len(at):
                continue
            p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, w[at], m) + model.bias - length[i], -60, 30)))
            total = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
            g = p if not y[i] else -p * (1 - total) / max(total, 1e-6)
            np.subtract.at(w, at, (step * g[sentence]).astype(np.float32))
            model.bias -= step * float(g.sum())
    return model


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", cap: int = 4000) -> NoisyOr:
    """Train on about cap labelled texts of each class (chosen by a hash of doc_id; cap and SAMPLE_BYTES bound what reaches the driver), none
    from the held-out third (crc32(doc_id as text) mod 3 is 1). Rows with a null label or id are left out."""
    rows = labelled_sample(documents, labels, label, ~held_out(F.col("k"), 3, 1), cap, [])
    got = rows.select("t", "y", F.xxhash64("t", "k").alias("h")).toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    return train([t.encode() for t in got["t"].to_pylist()], got["y"].to_numpy())


#: What score() adds; spans are character ranges of sentences with p of 0.5 or more, in text order.
SCORED = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("n_sentences", T.LongType()), ("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("p", T.DoubleType())])))]


def score(df: DataFrame, model: NoisyOr, text: str = "text", threshold: float = 0.7, sentence: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """df with the columns of SCORED."""

    def make():
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))

        def work(part):
            data, off = utf8(part.column(text))
            total, p, doc, start, end = model.bags(data, off)
            n = len(off) - 1
            spans: list[list] = [[] for _ in range(n)]
            bad = np.flatnonzero(p >= sentence)
            if len(bad):
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = chars[off[doc[bad]]]
                for i, a, b, q in zip(doc[bad].tolist(), (chars[start[bad]] - base).tolist(), (chars[end[bad]] - base).tolist(), p[bad].tolist(), strict=True):
                    spans[i].append({"start": a, "stop": b, "p": q})
            return [pa.array(total, pa.float64()), pa.array((total >= threshold).astype(np.int32), pa.int32()), pa.array(np.bincount(doc, minlength=n)[:n] if n else [], pa.int64()), pa.array(spans, span)]

        return work

    return attach(df, text, SCORED, make, keep)
