import hashlib
import os
import pathlib
import re
import shutil
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from binweave.llm import isomedia, langid, lsa_decontam, quality_fm, queries
from binweave.llm.words import words

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]}
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def test_stages_and_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept.withColumns({"score": F.lit("own"), "predicted": F.lit(1)}), SF)
        assert kept.columns == [*docs.columns, "score", "predicted"], name
        assert {r[0] for r in kept.select("score").distinct().collect()} <= {"own"}
        kept = kept.select(docs.columns).cache()
        assert kept.exceptAll(before).count() == 0
    out = corpus_pipeline.run(spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert {r["doc_id"] for r in out} == set(text)
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"] for r in out)


def test_each_decision_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    left = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES[:-1]}
    good = left["quality"].join(marks, "doc_id").groupBy().agg(F.avg("quality")).first()[0]
    assert good > docs.join(marks, "doc_id").agg(F.avg("quality")).first()[0]
    assert left["language"].count() >= 0.99 * docs.count()
    assert left["near_copies"].count() == left["near_copies"].select("text").distinct().count() < docs.count()
    assert left["benchmark_leaks"].count() < docs.count()


def test_empty_tables(spark, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    for name, query in queries.queries().items():
        assert query(spark, f"file://{tmp_path}").count() == 0, name


def test_null_columns(spark, tmp_path):
    """Every column null in some rows, and rows that repeat."""
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet").limit(60)
        holes = [df.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name == c else F.col(f.name) for f in df.schema.fields]).limit(3) for c in df.columns]
        for h in holes:
            df = df.unionByName(h)
        df.unionByName(df.limit(2)).write.parquet(f"file://{tmp_path}/{t}.parquet")
    n = {t: spark.read.parquet(f"file://{tmp_path}/{t}.parquet").count() for t in TABLES}
    for name, query in queries.queries().items():
        rows = query(spark, f"file://{tmp_path}").count()
        if name != "op4_preference_pairs":
            assert rows == n["pages" if name.startswith(("op1_", "op2_")) else "documents"], name
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(f"SELECT * FROM ({queries.oracle_sql()[name].strip().rstrip(';')})")
    names = [c[0] for c in found.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_contracts(spark):
    """Columns of op5 and op6 by hand, of op6 by the library."""
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_media_columns(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        body = docs[r["doc_id"]].encode()
        padded = body + bytes(-len(body) % 64 if body else 64)
        media = isomedia.write(padded)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        n, at = len(padded) // 64, len(media) - len(padded)
        assert r["feature"] == f"qt/raw/vide {n / 25:.2f}s {n} samples {n} keyframes at {at}-{len(media)}"
    rows = queries.op6_byte_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = encoding.encode_ordinary(docs[r["doc_id"]])
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def plain_words(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", text.translate(LOWER))


def test_pipeline_against_brute_force(spark):
    """Each stage document by document: the models one text at a time, all pairs of shingle sets, all stretches of all texts for each item,
    and the library's tokens."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    model = quality_fm.fit(docs, labels)
    left = [r for r in docs.collect() if model.score(*one(r["text"] or ""), np.array([r["n_chars"] if r["n_chars"] is not None else len(r["text"] or "")]))[0] >= 0.3]
    frame = lambda rows: spark.createDataFrame(rows, docs.schema)
    model = langid.fit(frame(left))
    left = [r for r in left if model.predict(*one(r["text"] or ""))[2][0]]
    sets = []
    for r in left:
        w = plain_words(r["text"] or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 1.8 >= 0.8 * (len(sets[i]) + len(sets[j])) - 1e-6:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {}
    for r, x in zip(left, root, strict=True):
        least[x] = min(least.get(x, r["doc_id"]), r["doc_id"])
    left = [r for r, x in zip(left, root, strict=True) if least[x] == r["doc_id"]]
    items, vocabulary = lsa_decontam.benchmark_items([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    clean = []
    for r in left:
        ids = vocabulary.ids(words(*one(r["text"] or "")).hash)
        if not any(lsa_decontam.fit(x, ids, 0, len(ids)) for x in items):
            clean.append(r)
    assert len(clean) < len(left) < docs.count()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {r["doc_id"]: np.array(encoding.encode_ordinary(r["text"] or ""), "<u4").tobytes() for r in clean}
    assert {r["doc_id"]: bytes(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_the_rest_without_the_optional_parts(tmp_path):
    """A copy of the repository without both folders and the pipeline: the entry has the other queries and SQL, and one of them runs."""
    here = pathlib.Path(corpus_pipeline.__file__).parent
    leave_out = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".*_cache")
    shutil.copytree(here, tmp_path / "copy", ignore=leave_out)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q); import binweave.catalog"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=120)
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path / "copy", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert collected.returncode == 0, collected.stdout
