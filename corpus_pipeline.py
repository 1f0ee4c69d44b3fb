"""A corpus made ready for training: toxic documents go, then exact and near duplicates, then leaked benchmark items;
what stays is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the next.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternfold.llm import decontam, exact_dedup, jaccard_join, sentencepiece_codec, toxicity
from lanternfold.llm.common import materialise, table
from lanternfold.llm.queries import held_out, piece_model


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model is fitted on labelled documents of the stage's input."""
    model = toxicity.train(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity.score_documents(docs, model, keep_text=True, out="__toxicity")
    return scored.where(scored["__toxicity"] < toxicity.THRESHOLD).select(*docs.columns)


def reject_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def reject_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one_of_each(docs)


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and n_chars with the ids of the text, their number and the digests of ids and decoded text."""
    return sentencepiece_codec.encode_documents(docs, piece_model(), keep_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", reject_exact_duplicates),
    ("n-gram Jaccard join", reject_near_duplicates),
    ("benchmark decontamination", reject_leaks),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL expresses neither the compression model nor the tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
