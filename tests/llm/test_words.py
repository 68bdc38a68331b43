import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binweave.llm._common import class_sample, free_name, held_out, slices, utf8
from binweave.llm.words import distinct, segment_sum, shingles, words

_text = st.text(st.sampled_from("abZÉé ß.,\n-漢9_"), max_size=60)


def plain(t):
    low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in t)
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", low)


@given(st.lists(st.none() | _text, max_size=6))
def test_words_and_shingles(texts):
    data, off = utf8(pa.array(texts, pa.string()))
    w = words(data, off)
    want = [plain(t or "") for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    flat = [x for t in want for x in t]
    assert len(set(w.hash.tolist())) == len(set(flat))
    code, doc = shingles(w, 3)
    runs = [(i, tuple(t[k : k + 3])) for i, t in enumerate(want) for k in range(max(1, len(t) - 2) if t else 0)]
    assert doc.tolist() == [i for i, _ in runs]
    assert len(set(code.tolist())) == len({r for _, r in runs})


def test_long_words_differ_in_their_last_byte():
    data, off = utf8(pa.array(["a" * 40 + "b", "a" * 40 + "c", "a" * 16, "a" * 8, "a" * 9]))
    assert len(set(words(data, off).hash.tolist())) == 5


def test_distinct_and_sums():
    key, count, first = distinct(np.array([5, 3, 5, 1]), np.array([0, 0, 0, 2]), 3)
    assert (key.tolist(), count.tolist(), first.tolist()) == ([3, 5, 1], [1, 2, 1], [0, 2, 2, 3])
    assert segment_sum(np.array([1, 2, 4]), np.array([0, 2, 2, 3])).tolist() == [3, 0, 4]


def test_slices_keep_rows():
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "t": ["a" * 50, None, "", "b" * 500, "c", "d" * 90, "e" * 20]})
    parts = list(slices(batch, "t", 100))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(7))
    assert max(len(p) for p in parts) > 1
    assert list(slices(batch.slice(0, 0), "t")) == []


def test_samples_and_names(spark):
    df = spark.createDataFrame([(i, i % 10 == 0) for i in range(4000)], "id long, y boolean")
    got = class_sample(df, "y", "id", 300).groupBy("y").count().collect()
    assert all(200 < n < 420 for _, n in got)
    assert class_sample(df.limit(0), "y", "id", 5).count() == 0
    assert free_name(spark.createDataFrame([], "X int, _x int"), "x") == "__x"
    kept = spark.createDataFrame([(None,), (0,)], "id long").select(held_out(F.col("id"), 4, 2)).collect()
    assert kept[0][0] is False


def test_sieve_lets_all_keys_through(spark, monkeypatch):
    from binweave.llm import _common

    df = spark.range(20_000).select(F.col("id"), F.xxhash64("id").alias("h"))
    keys = df.where("id % 10 = 0").select("h")
    maybe = _common.sieve(keys)
    hit = {r["id"] for r in df.where(maybe(F.col("h"))).collect()}
    assert {i for i in range(0, 20_000, 10)} <= hit
    assert len(hit) < 4000
    assert df.where(_common.sieve(keys.limit(0))(F.col("h"))).count() == 0
    monkeypatch.setattr(_common, "SIEVE_MOST", 1024)
    assert _common.sieve(keys) is None


def test_without(spark):
    from binweave.llm._common import row_key, stored, shared_dir, without

    rows = [(1, "a"), (1, "b"), (None, "a"), (None, None), (2, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(0))
    gone = stored(df.where("text = 'a' and (doc_id = 1 or doc_id is null)").select(row_key("doc_id", "text").alias("key")), shared_dir(spark, "k"))
    got = without(df, gone, "doc_id", "text")
    assert got.columns == df.columns
    assert sorted(map(repr, ((r[0], r[1]) for r in got.collect()))) == sorted(map(repr, [(1, "b"), (None, None), (2, "a")]))
