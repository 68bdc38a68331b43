"""Quality by a factorisation machine over hashed words, binned structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)): all pairwise interactions in time linear in
the number of a text's features. Features: words hashed to 2^16 places with x = log(1 + count) over the text's norm, one place for each
bin of each structure statistic, and one for each bin of the metadata (length in characters, computed where the column is null).
Whole texts count. Null and empty texts have the statistics of no words, and a score like any other; repeated rows have equal scores;
columns of the input named score or predicted are replaced, others kept. Label, language, source and id are no inputs; equal training rows count once. Without training rows the score
is 0.5; with one class only it is that class's; an empty table gives no rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.llm._common import SLICE_BYTES, attach, held_out, labelled_sample, utf8
from binweave.llm.words import Words, distinct, segment_sum, words

BITS, RANK, BINS = 16, 8, 24
#: Values: the norm of a text's words, and the value of each statistic's bin.
WORDS, STATS = 0.15, 1.0
_SPECIAL = 32  # places for statistics: _SPECIAL * BINS behind the words'
SIZE = (1 << BITS) + _SPECIAL * BINS
_UPPER = np.zeros(256, np.int8)
_UPPER[65:91] = 1
_SMALL = np.zeros(256, np.int8)
_SMALL[97:123] = _SMALL[128:192] = 1
_DIGIT = np.zeros(256, np.int8)
_DIGIT[48:58] = 1
_SIGN = np.zeros(256, np.int8)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_SIGN[[ord(c) for c in ".,'-"]] = 0
_STOP = np.zeros(256, np.int8)
_STOP[[ord(c) for c in ".,;:?"]] = 1


def statistics(data: np.ndarray, off: np.ndarray, w: Words, chars: np.ndarray) -> np.ndarray:
    """Structure statistics of each text, each a number of 0 to 1."""
    n_bytes = np.maximum(np.diff(off), 1)
    n_words = np.diff(w.first)
    many = np.maximum(n_words, 1)
    share = lambda table: segment_sum(table[data], off) / n_bytes
    follows = (w.doc[1:] == w.doc[:-1]) if len(w.doc) > 1 else np.zeros(0, bool)
    same = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & follows]) if len(w.hash) else np.zeros(0, bool)
    _, count, first = distinct(w.hash, w.doc, len(off) - 1)
    kinds = np.diff(first)
    top = np.zeros(len(off) - 1)
    full = np.flatnonzero(kinds)
    if len(full):
        top[full] = np.maximum.reduceat(count, first[full])
    length = w.end - w.start
    upper = segment_sum(_UPPER[data], off)
    lines = segment_sum(data == 10, off) + 1
    log = lambda x, most: np.minimum(np.log1p(x) / np.log1p(most), 1)
    return np.stack([
        share(_UPPER), upper / np.maximum(upper + segment_sum(_SMALL[data], off), 1), share(_DIGIT), np.sqrt(share(_SIGN)), share(_STOP), np.sqrt(segment_sum(data == 33, off) / n_bytes), np.sqrt(segment_sum(data == 124, off) / n_bytes),
        np.sqrt(segment_sum(same, w.first) / many), kinds / many, top / many, kinds / np.maximum(np.sqrt(n_words), 1) / 60, log(n_words, 20_000), log(segment_sum(length, w.first) / many, 40), log(n_words / lines, 2_000), log(lines, 2_000), log(chars, 200_000),
        segment_sum(data >= 128, off) / n_bytes, np.minimum(segment_sum(data == 32, off) / many, 2) / 2,
    ], 1).clip(0, 1)


def features(data: np.ndarray, off: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and each text's first, statistics behind the words."""
    w = words(data, off)
    n = len(off) - 1
    place, count, first = distinct((w.hash >> np.uint64(64 - BITS)).astype(np.int64), w.doc, n)
    x = np.log1p(count)
    doc = np.repeat(np.arange(n), np.diff(first))
    x *= (WORDS / np.sqrt(np.maximum(segment_sum(x * x, first), 1e-9)))[doc] if len(x) else 1
    stats = statistics(data, off, w, chars)
    k = stats.shape[1]
    bins = (1 << BITS) + np.arange(k) * BINS + np.minimum(stats * BINS, BINS - 1).astype(np.int64)
    place = np.concatenate([place, bins.ravel()])
    doc = np.concatenate([doc, np.repeat(np.arange(n), k)])
    order = np.argsort(doc, kind="stable")
    return place[order].astype(np.int32), np.concatenate([x, np.full(n * k, STATS)])[order].astype(np.float32), np.searchsorted(doc[order], np.arange(n + 1))


@dataclass
class FactorisationMachine:
    """bias, weights (SIZE) and factors (SIZE x RANK)."""

    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, RANK), np.float32))

    def raw(self, place: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds by the sum-of-squares identity."""
        vx = self.factors[place] * x[:, None]
        total = segment_sum(vx, first)
        return self.bias + segment_sum(self.weights[place] * x, first) + 0.5 * (total**2 - segment_sum(vx * vx, first)).sum(1)

    def score(self, data: np.ndarray, off: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(data, off, chars)), -40, 40)))


def train(docs: list[bytes], y: np.ndarray, chars: np.ndarray, prior: float | None = None, epochs: int = 12, rate: float = 0.15, decay: float = 2e-4, seed: int = 3) -> FactorisationMachine:
    """AdaGrad on the log loss; prior: the share of label 1 outside the sample, to which the bias is moved."""
    model = FactorisationMachine()
    if not len(docs):
        return model
    y = np.asarray(y, np.float64)
    rng = np.random.default_rng(seed)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    while (k := len(rows)) < len(docs):  # a slice at a time, for the driver's memory
        size = np.cumsum([len(d) for d in docs[k : k + 500]])
        part = docs[k : k + max(1, int(np.searchsorted(size, SLICE_BYTES, side="right")))]
        off = np.concatenate([[0], size[: len(part)]]).astype(np.int64)
        place, x, first = features(np.frombuffer(b"".join(part), np.uint8), off, np.asarray(chars[k : k + len(part)]))
        rows += [(place[a:b].copy(), x[a:b].copy()) for a, b in zip(first[:-1], first[1:], strict=True)]
    model.factors = rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32)
    w, v = model.weights, model.factors
    gw, gv, gb = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, RANK), 1e-3, np.float32), 1e-3
    mean = np.clip(y.mean(), 0.001, 0.999)
    b = float(np.log(mean / (1 - mean)))
    weight = np.where(y == 1, 0.5 / mean, 0.5 / (1 - mean))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, xi = rows[i]
            vi = v[at]
            vx = vi * xi[:, None]
            total = vx.sum(0)
            z = b + w[at] @ xi + 0.5 * (total @ total - (vx * vx).sum())
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i]) * weight[i]
            dw = g * xi + decay * w[at]
            dv = g * xi[:, None] * (total - vx) + decay * vi
            gw[at] += dw * dw
            gv[at] += dv * dv
            gb += g * g
            w[at] -= rate * dw / np.sqrt(gw[at])
            v[at] -= rate * 0.3 * dv / np.sqrt(gv[at])
            b -= rate * g / np.sqrt(gb)
    shift = np.clip(prior if prior is not None else y.mean(), 0.001, 0.999)
    model.bias = float(b + np.log(shift / (1 - shift)))  # trained with classes of equal weight
    return model


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", cap: int = 3000) -> FactorisationMachine:
    """Train on about cap labelled texts of each class (chosen by a hash of doc_id; cap and SAMPLE_BYTES bound what reaches the driver), none of them
    from the held-out fifth (crc32(doc_id as text) mod 5 is 0). Rows with a null label or id are left out."""
    known = ~held_out(F.col("k"), 5, 0)
    share = labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull() & known).agg(F.avg("y")).first()[0]
    chars = (F.col("n_chars") if "n_chars" in documents.columns else F.lit(None)).cast("long")
    rows = labelled_sample(documents.withColumn("n", chars), labels, label, known, cap, ["n"])
    got = rows.select("t", "y", F.coalesce("n", F.length("t")).alias("n"), F.xxhash64("t", "k").alias("h")).toArrow().sort_by([("h", "ascending"), ("y", "ascending"), ("n", "ascending")])
    return train([t.encode() for t in got["t"].to_pylist()], got["y"].to_numpy(), got["n"].to_numpy(), share)


def score(df: DataFrame, model: FactorisationMachine, text: str = "text", chars: str | None = "n_chars", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """df with score and predicted (1 from threshold up)."""

    def make():
        def work(part):
            data, off = utf8(part.column(text))
            lengths = np.add.reduceat(np.append((data & 0xC0) != 0x80, False).astype(np.int64), off[:-1]) * (np.diff(off) > 0)
            if chars and chars in part.schema.names:
                known = part.column(chars).cast(pa.int64())
                lengths = np.where(np.asarray(known.is_valid()), np.asarray(known.fill_null(0)), lengths)
            p = model.score(data, off, np.maximum(lengths, 0))
            return [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]

        return work

    return attach(df, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make, keep)
