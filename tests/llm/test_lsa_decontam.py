import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binweave.llm import lsa_decontam as d
from binweave.llm._common import utf8
from binweave.llm.words import words




def table(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@given(st.lists(st.integers(0, 4), min_size=1, max_size=90), st.lists(st.integers(0, 4), max_size=40))
def test_longest_common_subsequence(a, b):
    assert d.longest_common(np.array(a), np.array(b, np.int64)) == table(a, b)


@given(st.lists(st.lists(st.integers(0, 6), max_size=30), min_size=1, max_size=5), st.integers(1, 9))
def test_passages(texts, size):
    ids = np.array([x for t in texts for x in t], np.uint16)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    passage, term, begin = d.passages(ids, first, size)
    want, n = set(), 0
    for t in texts:
        for s in range(0, len(t), size):
            want |= {(n, x - 1) for x in t[s : s + size] if x}
            n += 1
    assert begin[-1] == n
    assert sorted(zip(passage.tolist(), term.tolist(), strict=True)) == sorted(want)
    assert (np.diff(passage) >= 0).all()


def test_vocabulary():
    data, off = utf8(pa.array([" ".join(f"word{i}" for i in range(5000)), "other word7"]))
    w = words(data, off)
    v = d.Vocabulary(np.unique(w.hash[: w.first[1]]))
    assert len(set(v.ids(w.hash[: w.first[1]]).tolist())) == 5000
    assert v.ids(w.hash[w.first[1] :]).tolist()[0] == 0
    assert v.ids(w.hash[w.first[1] :])[1] == v.ids(w.hash[:8])[7]


def test_latent_space_is_that_of_an_exact_svd():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(400, 12)) * np.linspace(9, 3, 12) @ np.linalg.qr(rng.normal(size=(80, 12)))[0].T
    place, sign = d.sign_matrix(80, 40)
    omega = np.zeros((80, 40))
    np.add.at(omega, (np.arange(80)[:, None], place), sign)
    z = (a.T @ (a @ omega)).astype(np.float32)
    space = d.latent_space(z, rank=9).astype(float)
    _, value, v = np.linalg.svd(a, full_matrices=False)
    want = v[:9].T / np.sqrt(value[:9] ** 2 + d.RIDGE * (value[:9] ** 2).mean())
    assert np.abs(np.abs((space / np.linalg.norm(space, axis=0) * v[:9].T).sum(0)) - 1).max() < 1e-3
    assert np.abs(np.linalg.norm(space, axis=0) / np.linalg.norm(want, axis=0) - 1).max() < 1e-2
    assert d.latent_space(np.zeros((80, 40), np.float32)).shape[1] == 0


@given(st.lists(st.integers(1, 9), min_size=1, max_size=150), st.lists(st.integers(0, 9), min_size=1, max_size=70), st.lists(st.integers(1, 9), min_size=1, max_size=60))
def test_nothing_in_common_passes_the_bound(long, near, short):
    masks = [d._masks(np.array(x, np.uint16)) for x in (long, short)]
    got = d.most_in_common(np.array([near, near[::-1], near], np.uint16), np.array([0, 0, 1]), masks)
    assert got[0] >= table(long, near)
    assert got[1] >= table(long, near[::-1])
    assert got[2] == table(short, near)


def corpus(prose, seed=4):
    rng = random.Random(seed)
    bench = [(i, prose(100 + i, rng.choice([15, 25, 40, 57])) + ". " + prose(500 + i, 6) + ".") for i in range(30)]
    bench += [(30, prose(130, 300)), (31, "seven words that are quite a few"), (32, None), (33, ""), (5, bench[5][1])]
    docs, leaks = [], set()
    for k in range(300):
        text = [prose(10_000 + k, rng.choice([10, 100, 400]))]
        if k % 10 == 0:
            i = k // 10
            words_ = bench[i][1].split()
            if k % 20:  # a paraphrase: some words changed, some dropped
                for j in rng.sample(range(len(words_)), len(words_) // 8):
                    words_[j] = "changed"
            text.insert(rng.randrange(2), " ".join(words_).upper() if k % 30 == 0 else " ".join(words_))
            leaks.add((k, i))
        docs.append((k, " ".join(text)))
    docs += [(300, "x " + bench[30][1] + " y"), (301, None), (302, ""), (303, "and " + bench[31][1] + " more"), (304, "seven words that are not quite a few")]
    return docs, bench, leaks | {(300, 30), (303, 31)}


def test_planted_leaks_and_no_others(spark, prose):
    docs, bench, leaks = corpus(prose)
    out = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert len(out) == len(docs)
    assert {(r["doc_id"], x["item"]) for r in out for x in r["leaks"]} == leaks
    text = dict(docs)
    for r in out:
        assert r["contaminated"] == bool(r["leaks"])
        for x in r["leaks"]:
            assert 0 <= x["start"] < x["stop"] <= len(text[r["doc_id"]].replace(".", " ").split())
            assert x["lcs"] >= d.PART


def test_groups_change_nothing(spark, prose, monkeypatch):
    docs, bench, leaks = corpus(prose)
    monkeypatch.setattr(d, "GROUP", 20)
    out = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], x["item"]) for r in out for x in r["leaks"]} == leaks
    assert len(out) == len(docs)


def test_ids_of_items_may_be_text(spark, prose):
    bench = spark.createDataFrame([("a", prose(1, 30)), ("b", prose(2, 30)), ("c", "just four words here")], "item_id string, text string")
    docs = spark.createDataFrame([(1, prose(9, 60) + " " + prose(1, 30)), (2, prose(2, 30)), (3, "x just four words here"), (4, prose(5, 80))], "doc_id long, text string")
    got = {r["doc_id"]: [x["item"] for x in r["leaks"]] for r in d.decontaminate(docs, bench).collect()}
    assert got == {1: ["a"], 2: ["b"], 3: ["c"], 4: []}


def space_of(ids, first, items, size):
    """The stages between ids and windows, in memory: used terms, weights, and the sketch."""
    passage, term, begin = d.passages(ids, first, d.WINDOW)
    weight = d.weights(np.bincount(term, minlength=size), int(begin[-1]), items)
    used = np.append(False, weight > 0)
    passage, term, _ = d.passages(ids, first, d.WINDOW, used)
    x = weight[term]
    x = (x / np.sqrt(np.bincount(passage, x * x))[passage]).astype(np.float32)
    t, rows = d._products(passage, term, x, d.sign_matrix(size, d.SKETCH), d.SKETCH)
    z = np.zeros((size, d.SKETCH), np.float32)
    z[t] = rows
    return used, weight, z


def test_recall_against_brute_force_over_all_windows():
    """Paraphrases with a third of the words replaced, in the given documents: every place that fit() accepts, searched one by one, against
    the candidates of the corpus's latent space; and without the corpus there are none."""
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    bench = pq.read_table(f"{sf}/benchmark.parquet")
    items, voc = d.benchmark_items(list(zip(bench["item_id"].to_pylist(), bench["text"].to_pylist(), strict=True)))
    w = words(*utf8(pq.read_table(f"{sf}/documents.parquet")["text"].combine_chunks()))
    base, rng = voc.ids(w.hash), np.random.default_rng(3)
    texts, planted = [], []
    for i in range(300):
        ids = items[i % len(items)].ids.copy()
        at = rng.random(len(ids)) < 1 / 3
        ids[at] = base[rng.integers(0, len(base), at.sum())]
        a = int(rng.integers(0, len(base) - 300))
        texts.append(np.concatenate([base[a : a + 50 + i % 24], ids, base[a + 150 : a + 220]]))
        planted.append(i % len(items))
    ids = np.concatenate([base, *texts])
    first = np.concatenate([w.first, len(base) + np.cumsum([len(t) for t in texts])])
    size = len(voc.hashes)
    used, weight, z = space_of(ids, first, items, size)
    parts = d.pieces(items)
    owner = np.array([i for i, _ in parts])
    mapped, target = d.targets(weight, d.latent_space(z), parts)
    own = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    window, which, _, begin = d.candidates(np.concatenate(texts), own, used, mapped, target)
    doc = np.searchsorted(begin, window, side="right") - 1
    found = set(zip(doc.tolist(), owner[which].tolist(), ((window - begin[doc]) * d._HALF).tolist(), strict=True))
    real = [k for k, i in enumerate(planted) if d.fit(items[i], texts[k], 0, len(texts[k]))]
    got = [k for k in real if any(d.fit(items[planted[k]], texts[k], s, s + d.WINDOW) for doc_, i, s in found if (doc_, i) == (k, planted[k]))]
    assert len(real) > 60
    assert len(got) >= 0.9 * len(real)
    chosen = d._possible(np.concatenate(texts), own, doc, (window - begin[doc]) * d._HALF, owner[which], np.array([len(x.ids) for x in items]), [d._masks(x.ids) for x in items])
    left = set(zip(doc[chosen].tolist(), owner[which[chosen]].tolist(), strict=True))
    assert {(k, planted[k]) for k in got} <= left
    assert d.latent_space(np.zeros_like(z)).shape[1] == 0  # no corpus, no space, no candidate
    other = np.random.default_rng(5).permutation(z)  # a corpus with other co-occurrences has other candidates
    again = d.candidates(np.concatenate(texts), own, used, *d.targets(weight, d.latent_space(other), parts))
    assert set(zip(again[0].tolist(), again[1].tolist(), strict=True)) != set(zip(window.tolist(), which.tolist(), strict=True))


def test_whole_test_table(spark):
    from collections import defaultdict

    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: "".join(x if x.isalnum() else " " for x in t.lower()).split()
    runs = defaultdict(set)
    for r in bench.collect():
        w = plain(r["text"])
        for k in range(len(w) - 7):
            runs[tuple(w[k : k + 8])].add(r["item_id"])
    want = set()
    for r in docs.collect():
        w = plain(r["text"])
        for k in range(len(w) - 7):
            want |= {(r["doc_id"], i) for i in runs.get(tuple(w[k : k + 8]), ())}
    got = {(r["doc_id"], x["item"]) for r in d.decontaminate(docs, bench).collect() for x in r["leaks"]}
    assert got == want


def test_edges(spark, prose):
    docs = spark.createDataFrame([(1, prose(1, 40)), (1, prose(1, 40)), (None, prose(1, 40)), (2, None)], "doc_id long, text string").withColumn("row", F.lit("own"))
    bench = spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["contaminated"]) for r in d.decontaminate(docs, bench).collect()) == [("1", True), ("1", True), ("2", False), ("None", True)]
    assert [r["doc_id"] for r in d.remove_leaks(docs, bench).collect()] == [2]
    for empty in (bench.limit(0), bench.select("item_id", F.lit(None).cast("string").alias("text")), bench.select("item_id", F.lit("...").alias("text"))):
        assert d.decontaminate(docs, empty).where("contaminated").count() == 0
        assert d.remove_leaks(docs, empty).count() == 4
    assert d.decontaminate(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("n", [8, 30])
def test_fit_needs_most_of_the_item(n):
    item = d.Item(1, np.arange(1, n + 1), np.arange(n - 3, n + 1))
    near = np.concatenate([np.full(50, 99), np.arange(1, n + 1), np.full(50, 99)])
    assert d.fit(item, near, 40, 104)[0] == 1
    half = near.copy()
    half[50 : 50 + n // 2 + 1] = 98
    assert d.fit(item, half, 40, 104) is None


@pytest.mark.parametrize("n", [1, 7, 63, 64, 65, 96, 97, 128, 160, 300])
def test_pieces_cover_every_word(n):
    item = d.Item(1, np.arange(1, n + 1), np.arange(n, n + 1))
    got = [p.tolist() for _, p in d.pieces([item])]
    assert {x for p in got for x in p} == set(range(1, n + 1))
    assert all(len(p) == min(n, d.WINDOW) for p in got)
    assert all(b[0] - a[0] <= d.WINDOW // 2 for a, b in zip(got, got[1:]))


def test_leaks_of_the_latter_part_of_long_items(spark, prose):
    many = [f"word{i}" for i in range(6000)]
    bench = [(i, prose(900 + i, [65, 96, 160][i % 3] - 8, many) + ". " + prose(600 + i, 8, many) + ".") for i in range(60)]
    docs = []
    for i, t in bench:
        w = t.split()
        part = w[-math.ceil(0.56 * len(w)) :]
        if len(w) > 65:  # words of other items, a few of each, amid all but the last 32
            other = iter(bench[(i + 3) % 60][1].split()[:60] + bench[(i + 6) % 60][1].split()[:60])
            part = [x for y in part[:-32] for x in (y, next(other), next(other))] + part[-32:]
        docs.append((i, prose(5000 + i, 100 + i, many) + " " + " ".join(part) + " " + prose(7000 + i, 150, many)))
    docs += [(1000 + i, prose(8000 + i, 300, many)) for i in range(200)]
    out = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], x["item"]) for r in out for x in r["leaks"]} == {(i, i) for i, _ in bench}


@given(st.integers(8, 24), st.lists(st.integers(0, 30), min_size=10, max_size=90), st.integers(0, 60), st.integers(0, 2**32 - 1))
def test_fit_judges_every_stretch(n, text, place, seed):
    rng = np.random.default_rng(seed)
    item = d.Item(1, rng.integers(1, 25, n), np.zeros(0))
    item.answer = item.ids[-max(4, n // 4) :]
    copy = [x for t in item.ids.tolist() for x in [[t], [t], [t, 0], [int(rng.integers(0, 25))]][rng.integers(4)]]
    near = np.array(text[:place] + copy + text[place:])
    length, found = min(int(1.25 * n) + 2, len(near)), []
    for s in range(len(near) - length + 1):
        stretch = near[s : s + length].tolist()
        share, answer = table(item.ids.tolist(), stretch) / n, table(item.answer.tolist(), stretch) / len(item.answer)
        if share >= d.MOST or share >= d.PART and answer >= d.ANSWER:
            found.append((share, answer))
    got = d.fit(item, near, 0, len(near))
    assert (got and got[:2]) == (max(found) if found else None)


def test_a_stretch_of_more_words_does_not_hide_the_leak():
    item = d.Item(1, np.arange(1, 41), np.arange(31, 41))
    leak = np.concatenate([np.full(22, 99), np.arange(19, 41), np.full(8, 99)])  # 22 of 40 words, the answer among them
    common = np.tile([3, 2, 1], 20)  # more words of the item, but in no order
    got = d.fit(item, np.concatenate([leak, common]), 0, 112)
    assert got[:2] == (0.55, 1.0)


def test_short_items_occur_word_for_word(spark, prose):
    many = [f"word{i}" for i in range(3000)]
    bench = [(i, prose(900 + i, 4 + i % 4, many)) for i in range(40)] + [(40 + i, prose(2000 + i, 50, many)) for i in range(80)] + [(200, "lonely"), (201, "lonely")]
    plain = lambda t: t.replace(".", " ").lower().split()
    docs = []
    for k in range(400):
        others = [" ".join(plain(bench[40 + (k + j) % 80][1])[10 * j % 30 :][:20]) for j in range(6)]  # words of weight all around
        docs.append((k, " ".join([*others[:3], bench[k % 40][1].upper(), *others[3:]] + ["lonely"] * (k % 50 == 0))))
    docs += [(1000 + i, " ".join(plain(t)[:-1])) for i, t in bench[:40]] + [(2000 + i, " ".join(plain(t)[1:])) for i, t in bench[:40]]
    short = {i: plain(t) for i, t in bench if len(plain(t)) < 8}
    want = {(k, i) for k, t in docs for i, w in short.items() if f" {' '.join(w)} " in f" {' '.join(plain(t))} "}
    assert len(want) >= 400
    out = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], x["item"]) for r in out for x in r["leaks"] if x["item"] in short} == want
    text = dict(docs)
    assert all(plain(text[r["doc_id"]])[x["start"] : x["stop"]] == short[x["item"]] for r in out for x in r["leaks"] if x["item"] in short)
    alone = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([b for b in bench if b[0] in short], "item_id long, text string"))
    assert {(r["doc_id"], x["item"]) for r in alone.collect() for x in r["leaks"]} == want


def test_windows_of_long_texts_take_bounded_memory():
    """Candidates of texts together are those of each alone, and a text of a million words takes a few arrays of its length."""
    import tracemalloc

    rng = np.random.default_rng(2)
    size = 500
    texts = [rng.integers(0, size + 1, n).astype(np.uint16) for n in (0, 5, 23, 24, 25, 47, 48, 49, 3000, 70_000, 1)]
    mapped, target = rng.normal(size=(size, 32)).astype(np.float32), rng.normal(size=(32, 40)).astype(np.float32)
    target /= np.linalg.norm(target, axis=0)
    used = np.append(False, rng.random(size) < 0.8)

    def found(group):
        first = np.concatenate([[0], np.cumsum([len(t) for t in group])])
        window, part, value, begin = d.candidates(np.concatenate(group), first, used, mapped, target)
        doc = np.searchsorted(begin, window, side="right") - 1
        return sorted(zip(doc.tolist(), (window - begin[doc]).tolist(), part.tolist(), value.round(3).tolist(), strict=True))

    together = found(texts)
    assert [x[:3] for x in together] == [(i, *x[1:3]) for i, t in enumerate(texts) for x in found([t])]
    i, w, p, value = together[len(together) // 2]
    ids = texts[i][w * d._HALF : (w + 2) * d._HALF]
    vector = sum(mapped[np.unique(h[used[h]]).astype(int) - 1].sum(0) for h in (ids[: d._HALF], ids[d._HALF :]))
    assert value == pytest.approx(float(vector @ target[:, p] / np.linalg.norm(vector)), abs=2e-3)
    long = np.tile(texts[9], 15)
    tracemalloc.start()
    found([long])
    assert tracemalloc.get_traced_memory()[1] < 220 * len(long)
    tracemalloc.stop()
