import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binweave.llm import langid, quality_fm, toxic_mil
from binweave.llm._common import class_sample, remainder, utf8
from binweave.llm.words import lower

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_held_out(documents):
    model = langid.fit(documents, cap=300)
    test = documents.where(remainder(F.col("doc_id"), 4) == 2).select("doc_id", "text", "lang")
    out = langid.identify(test, model)
    assert out.where("lang = lang_pred").count() / out.count() > 0.99
    assert out.where("lang_accepted").count() / out.count() > 0.99
    assert out.agg(F.min("score"), F.max("score")).first()[1] <= 1


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    model = langid.fit(spark.createDataFrame([*rows, (None, "x", None), (99, None, "en")], "doc_id long, text string, lang string"))
    cases = [(1, None), (2, ""), (3, "12 34 !!"), (4, "— … ½"), (5, "THE DOG"), (6, "漢字"), (7, "the cat " * 50_000), (None, "die katze")]
    out = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(cases, "doc_id long, text string").withColumn("score", F.lit("own")), model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4
    assert not any(out[i]["lang_accepted"] or out[i]["score"] for i in (1, 2, 3, 4))
    assert (out[5]["lang_pred"], out[7]["lang_pred"], out[None]["lang_pred"]) == ("en", "en", "de")
    assert out[6]["lang_pred"] in ("en", "de")
    none = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r["lang_pred"] for r in langid.identify(spark.createDataFrame(cases, "doc_id long, text string"), none).collect()] == ["und"] * 8


def test_prediction_is_by_text_alone(spark, documents):
    model = langid.fit(documents, cap=100)
    part = documents.limit(50)
    other = part.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 10**6)
    a, b = (sorted((r["text"], r["lang_pred"], r["score"]) for r in langid.identify(x, model).collect()) for x in (part, other))
    assert a == b


def rates(out, label):
    hits = out.where(f"predicted = 1 and {label} = 1").count()
    return hits / max(1, out.where("predicted = 1").count()), hits / max(1, out.where(f"{label} = 1").count())


def test_quality_held_out(documents, labels):
    model = quality_fm.fit(documents, labels)
    test = documents.join(labels.where(remainder(F.col("doc_id"), 5) == 0), "doc_id")
    out = quality_fm.score(test, model).cache()
    precision, recall = rates(out, "quality")
    assert precision > 0.97
    assert recall > 0.99
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_held_out(documents, labels):
    model = toxic_mil.fit(documents, labels)
    test = documents.join(labels.where(remainder(F.col("doc_id"), 3) == 1), "doc_id")
    out = toxic_mil.score(test, model).cache()
    precision, recall = rates(out, "toxic")
    assert precision > 0.9
    assert recall > 0.85
    for r in out.where("text like '% idiot %' and size(spans) > 0").limit(20).collect():
        assert any("idiot" in r["text"][s["start"] : s["stop"]] for s in r["spans"])


def test_noisy_or_by_hand():
    model = toxic_mil.train([b"you idiot. fine day."] * 20 + [b"fine day. good dog."] * 20, [1] * 20 + [0] * 20)
    data, off = utf8(pa.array(["fine day.", "fine day. idiot.", "idiot! Idiot? day", ""]))
    total, p, doc, start, end = model.bags(data, off)
    for i in range(4):
        none = 1.0
        for q in p[doc == i]:
            none *= 1 - q
        assert total[i] == pytest.approx(1 - none)
    assert total[1] > 10 * total[0]
    assert total[2] >= total[1]
    assert total[3] == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = quality_fm.FactorisationMachine(0.3, rng.normal(size=quality_fm.SIZE), rng.normal(size=(quality_fm.SIZE, quality_fm.RANK)))
    data, off = utf8(pa.array(["one two three two ONE!", "", "x"]))
    place, x, first = quality_fm.features(data, off, np.array([22, 0, 1]))
    got = model.raw(place, x, first)
    for i in range(3):
        p, v = place[first[i] : first[i + 1]], x[first[i] : first[i + 1]]
        want = 0.3 + model.weights[p] @ v
        for a in range(len(p)):
            for b in range(a):
                want += model.factors[p[a]] @ model.factors[p[b]] * v[a] * v[b]
        assert got[i] == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize(("module", "label"), [(quality_fm, "quality"), (toxic_mil, "toxic")])
def test_model_edges(spark, module, label):
    rows = [(i, "good words here" if i % 2 else "bad !!! bad !!! bad", i) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, "x", None), (61, None, None)], "doc_id long, text string, n_chars long")
    marks = spark.createDataFrame([*[(i, i % 2, 1 - i % 2) for i in range(60)], (61, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(docs, marks)
    cases = spark.createDataFrame([(1, None, None), (2, "", 5), (3, "good words here", None), (3, "good words here", None), (None, "a. " * 100_000, 7)], "doc_id long, text string, n_chars long")
    out = module.score(cases.withColumn("predicted", F.lit("own")), model).collect()
    assert len(out) == 5
    assert all(0 <= r["score"] <= 1 for r in out)
    assert out[2]["score"] == out[3]["score"]
    assert module.score(cases.limit(0), model).count() == 0
    empty = module.fit(docs, marks.limit(0))
    assert all(r["score"] == 0.5 if module is quality_fm else 0 <= r["score"] < 1e-9 for r in module.score(cases, empty).collect())


def test_clean_sentences_do_not_add_up(documents, labels):
    model = toxic_mil.fit(documents, labels)
    toxic = documents.join(labels.where("toxic = 1"), "doc_id").where("text like '% idiot %'").orderBy("doc_id").first()["text"]
    clean = "fine day. good dog! " * 100_000
    data, off = utf8(pa.array([clean, clean + toxic]))
    total, *_ = model.bags(data, off)
    assert total[0] == 0
    assert total[1] >= 0.7


def test_clean_sentences_of_weak_features_do_not_add_up(documents, labels):
    """All clean held-out texts of the table in one, again and again: over 100,000 sentences, some with features of little weight."""
    model = toxic_mil.fit(documents, labels)
    clean = [r["text"] for r in documents.join(labels.where((remainder(F.col("doc_id"), 3) == 1) & (F.col("toxic") == 0)), "doc_id").orderBy("doc_id").collect()]
    data, off = utf8(pa.array(clean))
    total, p, doc, *_ = model.bags(data, off)
    quiet = [t for t, s in zip(clean, total, strict=True) if s < 0.2]
    assert (p > 0).any()
    text = "\n".join(quiet * -(-100_000 * len(quiet) // len(doc) // len(quiet)))
    data, off = utf8(pa.array([text]))
    total, p, *_ = model.bags(data, off)
    assert len(p) > 90_000
    assert (p > 0).sum() > 100
    assert total[0] < 0.7


def test_samples_are_bounded_in_rows_and_bytes(spark):
    rows = [(7 if i < 500 else i, "a", f"{i}" * 50) for i in range(1000)] + [(i, "b", f"{i}" + "y" * 1000) for i in range(20)] + [(None, "b", None), (3, None, "z")] + [(1, "c", "same")] * 300
    df = spark.createDataFrame(rows, "k long, l string, t string").where("l is not null")
    got = class_sample(df, "l", "k", 100, "t", 1 << 20)
    n = {r["l"]: r["n"] for r in got.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 50 <= n["a"] <= 150  # texts of an id that repeats are drawn one by one
    assert n["b"] == 21
    assert n.get("c", 0) <= 1
    few = class_sample(df, "l", "k", 100_000, "t", 20_000)
    assert 0 < few.agg(F.sum(F.octet_length("t"))).first()[0] < 40_000
    assert class_sample(df.limit(0), "l", "k", 100, "t").count() == 0


def test_language_scores_as_a_plain_loop(documents):
    """The model's logits, n-gram by n-gram."""
    model = langid.fit(documents)
    cases = [r["text"] for r in documents.orderBy("doc_id").limit(8).collect()] + ["Ab, ÇÉ x!", "", "12 3"]
    data, off = utf8(pa.array(cases))
    z, has = model.logits(data, off)
    for i, text in enumerate(cases):
        low = lower(data[off[i] : off[i + 1]]).tobytes()
        clean, before = bytearray(), True  # of a run of other bytes the first is a space, none at the start
        for k, c in enumerate(low):
            letter = 97 <= c <= 122 or c >= 128
            if letter or before and (k or i):
                clean.append(c if letter else 32)
            before = letter
        total, n = np.zeros(len(model.languages)), 0
        for size in langid.SIZES:
            for k in range(len(clean) - size + 1):
                code = sum((c + 1) * pow(0x01000193, j + 1, 1 << 32) for j, c in enumerate(clean[k : k + size])) * 0x9E3779B1 % (1 << 32)
                total += model.table[((code ^ code >> 15) * 0x85EBCA77 % (1 << 32)) >> (32 - langid.BITS)]
                n += 1
        assert z[i] == pytest.approx(total / max(n, 1) + model.bias, abs=1e-3), text[:50]
        assert has[i] == any(c.isalpha() for c in text)
