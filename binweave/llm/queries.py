"""The opN_ queries: each applies its operator to the whole of its table. They only derive the contract's columns from the operators' results."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.llm import bpe, chosen_path, isomedia, langid, lsa_decontam, preference, quality_fm, style_tree, toxic_mil, warc
from binweave.llm._common import attach, delete, held_out, shared_dir, stored, texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each row of pages (null html: empty), written, read back and verified. Repeated rows have a record each; of equal payloads of 100 bytes
    or more the smallest page_id is the response; other columns of pages are not read; no pages, no rows."""
    folder = shared_dir(spark, "warc")
    files = warc.write(_table(spark, sf_dir, "pages"), f"{folder}/work")
    records = stored(warc.read(files, f"{folder}/work", with_payload=False).drop("payload"), f"{folder}/records")
    warc.check_revisits(records)
    delete(spark, f"{folder}/work")
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url")


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each row of pages: null, empty and textless pages have ''; repeated rows count as pages and have a row each; a column
    named text or n_chars would be replaced; no pages, no rows."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return style_tree.extract(pages, keep=["page_id", "url"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each row of documents: null texts and texts without a letter are `und` with score 0; ties go to the alphabetically
    first language; repeated rows have equal results; other columns are not read; no documents, no rows."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    out = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "lang_accepted")


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations holds no pairs, so a conversation is the chosen side, and the rejected side gives a stale last answer."""
    chosen = preference.numbered(_table(spark, sf_dir, "conversations"))
    out = preference.format_pairs(chosen, preference.stale_answer(chosen), "conv_id")
    digest = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return out.withColumns({c: digest(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of documents as a media file and what its stored bytes say: null and empty texts are one frame of zeros; equal texts have equal
    values; long texts are whole; other columns are not read; no documents, no rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    stored = isomedia.store_text(docs, "text", keep=["doc_id", "n_bytes"])
    columns = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]

    def make():
        def row(media: bytes) -> tuple:
            brand, tracks, problem = isomedia.describe(media)
            payload = isomedia.samples(media, isomedia.parse(media)[1][0])
            t = tracks[0]
            places = ",".join(f"{r['start']}-{r['stop']}" for r in t["keyframe_ranges"])
            feature = f"{brand.strip()}/{t['codec'].strip()}/{t['handler']} {t['duration_s']:.2f}s {t['n_samples']} samples {t['n_keyframes']} keyframes at {places}{problem}"
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

        def work(part):
            rows = [row(m) for m in texts(part.column("media"))]
            return [pa.array([r[k] for r in rows], pa.int64() if t == T.LongType() else pa.string()) for k, (_, t) in enumerate(columns)]

        return work

    return attach(stored, "media", columns, make, ["doc_id", "n_bytes"])


def op6_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Tokens of each text of documents: null and empty texts have none; repeated rows have equal results; other columns are not read; no
    documents, no rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, "text", vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each text of documents: null and empty texts are scored by their lack of words; repeated rows have equal results; a null
    n_chars is computed; null labels are left out; without labels the score is 0.5; no documents, no rows."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality_fm.score(docs.select("doc_id", "text", "n_chars"), model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op8_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in each text of documents: null and empty texts have none; null and empty items match nothing; equal texts have equal results;
    of stretches that fit an item equally the one with the higher cosine, then the later window, is given; other columns are not read; no documents, no rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lsa_decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", F.col("leaks.item").alias("item_ids"), F.round(F.array_max("leaks.lcs"), 6).alias("lcs"), "leaks")


def op9_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each text of documents: null and empty texts have score 0; repeated rows have equal results; null labels are left out;
    without labels the score is 0; other columns are not read; no documents, no rows."""
    docs = _table(spark, sf_dir, "documents")
    model = toxic_mil.fit(docs, _table(spark, sf_dir, "labels"))
    out = toxic_mil.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted", "n_sentences", F.size("spans").alias("n_offending"), F.col("spans").alias("offending"))


def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and links of each row of documents: null texts and texts without a word are linked with nothing; repeated rows are copies; ties for a
    class's id go to the smallest; other columns are not read; no documents, no rows."""
    return chosen_path.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_site_style_tree, op3_language_id, op4_preference_pairs, op5_media_columns, op6_byte_bpe, op7_quality_fm, op8_lsa_decontamination, op9_toxicity_mil, op10_chosen_path_join)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE_SQL, "op4_preference_pairs": preference.ORACLE_SQL, "op10_chosen_path_join": chosen_path.ORACLE_SQL}
