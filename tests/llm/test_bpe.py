import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from binweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.codec(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def known():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80) | st.text(st.sampled_from("ab 'sré½漢😀\n\t!9"), max_size=80))
def test_as_the_library(codec, known, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_runs(codec, known):
    for text in ("a" * 20_000, " " * 5_000, "é" * 3_000, "<|endoftext|>"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == known.encode_ordinary(text)


def test_perfect_hash(codec):
    vocabulary = {k: i for i, k in enumerate(codec.bytes) if k}
    assert len(codec.table.keys) == len(set(codec.table.keys)) == codec.table.n == len(vocabulary)
    assert all(codec.table.get(k) == v for k, v in vocabulary.items())
    texts = [k.decode() for k in vocabulary if k.decode("utf-8", "replace").encode() == k]
    assert codec.table.find([*texts, "no such token", "\ufffd"]).tolist() == [*[vocabulary[t.encode()] for t in texts], -1, vocabulary.get("\ufffd".encode(), -1)]
    assert codec.table.get(b"no such token") == -1
    assert bpe.PerfectHash([], []).get(b"x") == -1
    one = bpe.PerfectHash([b"a"], [7])
    assert (one.get(b"a"), one.get(b"b")) == (7, -1)


def test_memory_of_merges_is_bounded_and_changes_nothing(codec):
    texts = ["qwzx vbnq plkj", "", "qwzx plkj zzqj xxqk", "the qwzx"]
    want, memory = codec.encode_all(texts), {}
    assert codec.encode_all(texts, memory, 100) == want == codec.encode_all(texts, memory, 100)
    assert len(memory) == 6
    assert codec.encode_all(["z" * 49, *texts], memory, 100)[1:] == want
    assert len(memory) == 6
    assert codec.encode_all(texts, memory, 3) == want
    assert not memory


def test_both_tiers_answer(codec, known, monkeypatch):
    """Each pre-token of whole documents is looked up in the perfect hash, each that it lacks is merged, and no other table has the vocabulary."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    looked, merged, find, merge = [], [], codec.table.find, codec.merge
    monkeypatch.setattr(codec.table, "find", lambda tokens: looked.extend(tokens) or find(tokens))
    monkeypatch.setattr(codec, "merge", lambda word: merged.append(word) or merge(word))
    got = codec.encode_all([t or "" for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [known.encode_ordinary(t or "") for t in texts]
    tokens = [x for t in texts for x in codec.split(t or "")]
    assert looked == tokens
    lacking = [t.encode() for t in dict.fromkeys(tokens) if codec.table.get(t.encode()) < 0]
    assert merged == lacking
    assert 0 < sum(x >= 0 for x in find(tokens)) < len(tokens)
    monkeypatch.setattr(codec, "table", bpe.PerfectHash([], []))  # without the hash nothing but pairs of bytes is known
    assert np.frombuffer(codec.encode("the"), "<u4").tolist() != known.encode_ordinary("the")


def test_frames(spark, known):
    rows = [(1, "héllo wörld", "a"), (2, None, "b"), (3, "", "c"), (None, "héllo wörld", None), (1, "héllo wörld", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.round_trip(df, "text", PATH, public_tokenizers.PATTERN, with_ids=True)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    for r in got:
        want = np.array(known.encode_ordinary(r["text"] or ""), "<u4").tobytes()
        assert (bytes(r["ids"]), r["n_tokens"], r["ids_sha256"]) == (want, len(want) // 4, hashlib.sha256(want).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), "text", PATH, public_tokenizers.PATTERN).count() == 0
    again = bpe.decode(bpe.encode(df.select("doc_id", "text"), "text", PATH, public_tokenizers.PATTERN), "ids", PATH, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in again.collect())
