"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold.llm import decontam, exact_dedup, html_text, jaccard_join, langid, pii, secrets, sentencepiece_codec, sharding, toxicity
from lanternfold.llm.common import materialise, scratch, table


def piece_model() -> str:
    """The vocabulary file of the public tokenizer; its path is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.BlobLedger(spark, scratch(spark, "ledger"))
    ledger.scan(table(spark, sf_dir, "documents"), "base-1")
    ledger.scan_blobs("formats-1")  # a rule version that comes later scans the blobs that the ledger has
    return secrets.secret_digest(ledger.by_path("base-1"), ledger.findings("formats-1"))


def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op3_ftrl_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_parity_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op6_information_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = materialise(pii.personal_data(docs), "pii-result")
    return pii.personal_digest(found, pii.sanitised_documents(docs, found))


def op7_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.train(docs.where("not held_out"), labels)
    scored = toxicity.score_documents(docs, model)
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op8_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_documents(docs, piece_model())


def op9_progressive_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "matched", "windows", "copied")


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM h
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_blob_ledger, op2_line_blocks, op3_ftrl_ngrams, op4_hilbert_shards, op5_parity_sketches, op6_information_sanitisation, op7_compression_distance, op8_distinct_chunks, op9_progressive_refinement, op10_template_windows)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_progressive_refinement": OP9_SQL}
