"""Where models plug in: embedder, extractor, role generator, selector, reader, verifier, prompts.

Each is a Column function or a DataFrame function with a deterministic default, so that every plan runs without a service.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lanternfold.functions.excerpts import focused_excerpt
from lanternfold.functions.text import normalised

EMBEDDING_SIZE = 64
#: The stand-in role where no generator answers.
FALLBACK = {"role_id": "r0", "role_type": "answer_bearing"}


def hashed_vector(text: str, size: int = EMBEDDING_SIZE) -> np.ndarray:
    """Hashed character trigrams, length 1: the default embedder."""
    v = np.zeros(size)
    for w in text.lower().split():
        w = f" {w} "
        for i in range(len(w) - 2):
            h = zlib.crc32(w[i : i + 3].encode())
            v[h % size] += 1 if h >> 16 & 1 else -1
    return v / max(np.linalg.norm(v), 1e-12)


@F.pandas_udf(ArrayType(DoubleType()))
def embedded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Embeddings of texts; a model would be loaded once a task, before the loop."""
    for texts in parts:
        yield texts.fillna("").map(lambda x: hashed_vector(x).tolist())


def extracted_triples(passages: DataFrame, relations: tuple[str, ...] = ("is", "was", "has", "in", "of", "by")) -> DataFrame:
    """The default extractor: word, relation word, word inside a sentence: passage, s, r, o. passages: passage, text."""
    clean = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z ]", "|"))
    hits = F.regexp_extract_all(clean, F.lit(f" [a-z]+ (?:{'|'.join(relations)}) [a-z]+"), F.lit(0))
    found = passages.select("passage", F.explode(hits).alias("x")).withColumn("x", F.split(F.ltrim("x"), " "))
    return found.select("passage", F.col("x")[0].alias("s"), F.col("x")[1].alias("r"), F.col("x")[2].alias("o")).distinct()


def fallback_roles(questions: DataFrame) -> DataFrame:
    """One role for each question: q, pos, role_id, role_type, description. questions: q, text."""
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    description = F.when(clean == "", "Find evidence that directly answers the question.").otherwise(F.concat(F.lit("Find evidence that directly answers: "), clean))
    return questions.select("q", F.lit(0).cast("long").alias("pos"), F.lit(FALLBACK["role_id"]).alias("role_id"), F.lit(FALLBACK["role_type"]).alias("role_type"), description.alias("description"))


def read_answer(passage: Column, question: Column, budget: int = 120) -> Column:
    """The default reader: the excerpt of the passage that fits the question best."""
    return focused_excerpt(passage, question, budget)


def verifier_score(passage: Column, description: Column) -> Column:
    """The default verifier: 0, 1 or 2 by the share of the description's tokens in the passage, halved."""
    tokens = lambda x: F.array_distinct(F.filter(F.split(normalised(x), " "), lambda w: F.length(w) >= 3))
    share = F.size(F.array_intersect(tokens(passage), tokens(description))) / F.greatest(F.size(tokens(description)), F.lit(1))
    return F.when(share >= 0.5, 2).when(share > 0, 1).otherwise(0) / 2.0


def reader_prompt(question: Column, passages: Column) -> Column:
    """The reader's prompt: numbered passages, then the question. passages: array of strings in order."""
    numbered = F.array_join(F.transform(passages, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
    return F.concat(numbered, F.lit("\nQuestion: "), question, F.lit("\nAnswer:"))


def proposition_text(s: Column, r: Column, o: Column, support: Column, snippets: Column) -> Column:
    """What is embedded for a proposition: its lines of summary, relation, ends, support and numbered evidence."""
    clean = F.array_distinct(F.filter(F.transform(snippets, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))
    lines = F.transform(clean, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    head = F.concat(F.lit("Proposition: "), s, F.lit(" "), r, F.lit(" "), o, F.lit("\nRelation: "), r, F.lit("\nSubject: "), s, F.lit("\nObject: "), o, F.lit("\nSupport Count: "), F.greatest(support, F.lit(1)).cast("string"))
    return F.when(F.size(clean) > 0, F.concat(head, F.lit("\nEvidence:\n"), F.array_join(lines, "\n"))).otherwise(head)
