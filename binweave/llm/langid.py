"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent.

A text is the mean of the embeddings of its hashed byte 3-grams and 4-grams (small letters, anything else one space, so that word ends
are seen). Confidence is the softmax after a temperature fitted on texts kept out of training; a text whose confidence is below the
threshold fitted there is rejected. Null texts and texts without a letter are `und` with score 0 and are rejected. Whole texts count.
Ties go to the alphabetically first language. With no training text everything is `und`. Repeated rows have equal results, and equal training rows count
once; columns of the input named lang_pred, score or lang_accepted are replaced, others kept; an empty table gives no rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.llm._common import SLICE_BYTES, attach, class_sample, held_out, utf8
from binweave.llm.words import lower, segment_sum

BITS, SIZES = 15, (3, 4)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def grams(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of texts, each text's first place among them, and whether a text has a letter."""
    low = lower(data)
    letter = _LETTER[low]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other bytes the first stays, as a space
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    small = np.where(letter, low, 32)[keep].astype(np.uint32)
    n, doc = len(small), np.repeat(np.arange(len(off) - 1), np.diff(at))
    code, out, docs = np.zeros(n, np.uint32), [], []
    for k in range(max(SIZES)):
        m = max(n - k, 0)
        code = code[:m] + (small[k:] + np.uint32(1)) * np.uint32(pow(0x01000193, k + 1, 1 << 32))
        if k + 1 in SIZES:
            same = doc[:m] == doc[k:]
            x = code[same] * np.uint32(0x9E3779B1)
            out.append(((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - bits)).astype(np.int32))
            docs.append(doc[:m][same])
    first = [np.searchsorted(d, np.arange(len(off))) for d in docs]
    has = segment_sum(letter[keep].astype(np.int64), at) > 0
    plain = segment_sum((low[keep] >= 97) & (low[keep] <= 122), at) > 0
    for i in np.flatnonzero(has & ~plain).tolist():  # other bytes may be signs and marks alone
        has[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out, first, has


@dataclass
class LanguageModel:
    """table: logits of each bucket (embedding times softmax weights); scores below threshold are rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    report: dict = field(default_factory=dict)

    def logits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and whether there is a letter."""
        out, first, has = grams(data, off)
        step = max(1, 32 // max(len(out), 1))  # languages at once, so that what is gathered is bounded whatever their number
        total = np.concatenate([sum(segment_sum(self.table[:, k : k + step][b], f) for b, f in zip(out, first, strict=True)) for k in range(0, len(self.languages), step)], axis=1)
        n = sum(np.diff(f) for f in first)
        return total / np.maximum(n, 1)[:, None] + self.bias, has

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated confidence and acceptance of each text."""
        if not self.languages:
            n = len(off) - 1
            return ["und"] * n, np.zeros(n), np.zeros(n, bool)
        z, has = self.logits(data, off)
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        score = np.where(has, np.clip(p.max(1), 0, 1), 0.0)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, has, strict=True)], score, has & (score >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: list[bytes], langs: list[str], dim: int = 16, epochs: int = 8, rate: float = 4.0, reject: float = 0.0005, seed: int = 7) -> LanguageModel:
    """Fit on whole texts. A fifth of them (chosen by seed) sets temperature and the threshold below which `reject` of the rightly
    predicted ones fall, halved for safety."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    has = np.zeros(len(docs), bool)
    while (k := len(rows)) < len(docs):  # a slice at a time, for the driver's memory
        size = np.cumsum([len(d) for d in docs[k : k + 500]])
        part = docs[k : k + max(1, int(np.searchsorted(size, SLICE_BYTES, side="right")))]
        out, first, has[k : k + len(part)] = grams(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], size[: len(part)]]).astype(np.int64))
        for i in range(len(part)):
            b, c = np.unique(np.concatenate([o[f[i] : f[i + 1]] for o, f in zip(out, first, strict=True)]), return_counts=True)
            rows.append((b, (c / max(c.sum(), 1)).astype(np.float32)))
    kept = rng.random(len(docs)) < 0.2 if len(docs) >= 50 else np.zeros(len(docs), bool)
    emb = rng.normal(0, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    w, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    w += rng.normal(0, 0.3, w.shape)
    share = np.bincount(y, minlength=len(names)) / len(y)
    weight = 1 / (len(names) * share)
    use = np.flatnonzero(~kept & has)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(use):
            b, x = rows[i]
            h = x @ emb[b]
            z = h @ w + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            g *= step * weight[y[i]]
            back = w @ g
            w -= 0.05 * np.outer(h, g)
            bias -= 0.01 * g
            emb[b] -= x[:, None] * back * 4
    model = LanguageModel(names, (emb @ w).astype(np.float32), bias.astype(np.float64))
    test = np.flatnonzero((kept if kept.any() else np.ones(len(docs), bool)) & has)
    if len(test):
        z = np.array([rows[i][1] @ model.table[rows[i][0]] for i in test]) + model.bias
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(test)), y[test]], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.02, 20, 60), key=loss))
        p = softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == y[test]]
        floor = 1 / len(names)
        model.threshold = float(floor + (np.quantile(right, reject) - floor) / 2) if len(right) else 0.0
        model.report = {"texts": len(docs), "calibration": len(test), "accuracy": len(right) / len(test)}
    return model


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", cap: int = 1000) -> LanguageModel:
    """Train on about cap texts of each language, chosen by a hash of key and text, among rows outside the held-out quarter
    (crc32(key as text) mod 4 is 2) with a non-null language. cap and SAMPLE_BYTES bound what reaches the driver."""
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("k"), 4, 2))
    got = class_sample(rows, "l", "k", cap, "t").select("t", "l", F.xxhash64("t", "k").alias("h")).toArrow().sort_by([("h", "ascending"), ("l", "ascending")])
    return train([x.encode() for x in got["t"].to_pylist()], got["l"].to_pylist())


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with lang_pred, score (0 to 1) and lang_accepted."""

    def make():
        def work(part):
            lang, score, ok = model.predict(*utf8(part.column(text)))
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())]

        return work

    return attach(df, text, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("lang_accepted", T.BooleanType())], make, keep)
