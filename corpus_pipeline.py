"""A training corpus from `documents` in five stages: quality, language, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), applies one operator to all rows of docs, and returns a DataFrame; all but the last return the
columns of docs. Decisions: documents that the quality model predicts as 0 or the language model rejects go; of each class of near
copies the document with the least id stays; documents that hold a benchmark passage go; what is left is encoded. Columns of docs that
have the name of one that an operator computes are kept as they are. Empty tables give empty results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from binweave.llm import bpe, chosen_path, langid, lsa_decontam, quality_fm
from binweave.llm._common import delete, free_name, shared_dir, stored


def _filtered(docs: DataFrame, computed: tuple[str, ...], judge: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """The rows of docs for which a condition on an operator's computed columns holds; docs's own columns of such names step aside."""
    aside = {c: free_name(docs, f"_{c}") for c in docs.columns if c.lower() in computed}
    out = judge(docs.withColumnsRenamed(aside)).where(condition).drop(*computed)
    return out.withColumnsRenamed({v: k for k, v in aside.items()}).select(*[f"`{c}`" for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the quality model predicts as 0. Null and empty texts are scored by their lack of words; repeated rows go or stay
    together; ties at the threshold stay."""
    model = quality_fm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _filtered(docs, ("score", "predicted"), lambda d: quality_fm.score(d, model), "predicted = 1")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the language model rejects, among them null texts and texts without a letter. Repeated rows go or stay together."""
    model = langid.fit(docs)
    return _filtered(docs, ("lang_pred", "score", "lang_accepted"), lambda d: langid.identify(d, model), "lang_accepted")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each class of near copies, that of the least doc_id (a null one is the least); null texts and texts without words are
    copies of nothing. Of rows with equal id and text the one with the least hash of all columns stays."""
    return chosen_path.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item. Null and empty texts hold none; rows of equal id and text go together."""
    return lsa_decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (binary, little-endian unsigned 32-bit) and the digests of ids and of their decoding; null texts have no ids."""
    return bpe.round_trip(docs, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: SQL can express neither the trained models nor the tokenizer; tests/llm/test_pipeline.py compares all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is stored before the next, and deleted when that is stored."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
