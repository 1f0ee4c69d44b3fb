"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters of the lower-cased text, with runs of non-letters as one space, are hashed to
``2**HASH_BITS`` buckets. Weights are learnt by follow-the-regularised-leader with per-coordinate rates and an
elastic-net penalty (L1 makes them sparse), then one temperature is fitted on rows that taught no weight. Document
frequencies cover all training documents; the weights come from a bounded sample, at most ``MAX_PER_LANGUAGE`` texts of
each language, those with the least hash of id and text.

Defined results: ``und`` with score 0 if a text is null, empty or has no letter, or if nothing was there to learn from;
rows that repeat give a row each; an empty table gives an empty result; other columns pass through
untouched, but columns of the outputs' names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.llm.common import batches_bounded, quoted, small_or_shuffled, whole_text, with_results

HASH_BITS = 15
MAX_PER_LANGUAGE = 400
#: FTRL-proximal: learning rate, its smoothing, elastic net, passes over the sample; share that teaches weights.
ALPHA, BETA, L1, L2, PASSES, WEIGHTS_SHARE = 0.5, 1.0, 0.02, 0.1, 4, 0.8
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point of the basic plane whether it is a letter."""
    return np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x10000)])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and their counts; none if it has no letter."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = _letters()[np.minimum(a, 0xFFFF)]
    high = np.flatnonzero(a > 0xFFFF)
    if high.size:
        each, at = np.unique(a[high], return_inverse=True)
        is_letter[high] = np.array([chr(x).isalpha() for x in each.tolist()])[at]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0)
    a = np.where(is_letter, a, 32)
    a = a[np.r_[True, (a[1:] != 32) | (a[:-1] != 32)]]
    a = np.r_[a[:1] * 0 + 32, a, a[:1] * 0 + 32].astype(np.uint64)
    one = a * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + one[2:]
    grams = np.concatenate([one[a != 32], two, three])
    grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    n = np.bincount((grams >> np.uint64(64 - HASH_BITS)).astype(np.int64), minlength=1 << HASH_BITS)
    at = np.flatnonzero(n)
    return at, n[at].astype(float)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        at, n = counted(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        z = (self.weights[:, at] @ weighted(at, n, self.idf) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of unit length, with 1 + log(count) as term frequency."""
    v = (1 + np.log(n)) * idf[at]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """How many texts have each bucket, and the number of texts. Each task sends one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(1 << HASH_BITS, np.int64), 0
        for batch in batches:
            for text in batch.column("__text").to_pylist():
                at, _ = counted(text)
                df[at] += 1
                total += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int64()), pa.array(np.r_[total, df[at]], pa.int64())], ["bucket", "n"])

    parts = docs.select(whole_text(F.col(text_col)).alias("__text")).mapInArrow(run, "bucket long, n long")
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most 2**HASH_BITS + 1 rows
    df = np.zeros(1 << HASH_BITS, np.int64)
    total = 0
    for r in rows:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, total


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray, total: int) -> LanguageModel:
    """Weights by FTRL on the first rows, the temperature on the rest. rows: language, buckets, counts."""
    idf = np.log((1 + total) / (1 + df)) + 1
    languages = tuple(sorted({r[0] for r in rows}))
    place = {x: k for k, x in enumerate(languages)}
    k, d = len(languages), 1 << HASH_BITS
    data = [(place[lang], at, weighted(at, n, idf)) for lang, at, n in rows if len(at)]
    if not data:
        return LanguageModel((), idf, np.zeros((0, d), np.float32), np.zeros(0), 1.0)
    cut = max(1, int(WEIGHTS_SHARE * len(data)))
    z, n2 = np.zeros((k, d + 1)), np.zeros((k, d + 1))

    def leader(at: np.ndarray) -> np.ndarray:
        zz = z[:, at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n2[:, at])) / ALPHA + L2))

    for _ in range(PASSES):
        for y, at, v in data[:cut]:
            at, v = np.r_[at, d], np.r_[v, 1.0]
            w = leader(at)
            s = w @ v
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * v
            sigma = (np.sqrt(n2[:, at] + g * g) - np.sqrt(n2[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n2[:, at] += g * g
    w = leader(np.arange(d + 1))
    held = data[cut:] or data
    scores = np.array([w[:, at] @ v + w[:, d] for _, at, v in held]).reshape(-1, k)
    truth = np.array([y for y, _, _ in held], int)

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(truth)), truth]))

    grid = np.linspace(-3, 3, 121)
    best = min(grid, key=loss)
    return LanguageModel(languages, idf, w[:, :d].astype(np.float32), w[:, d], float(np.exp(best)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on ``docs`` with a language. Callers leave out the rows that must not teach."""
    batches_bounded(docs.sparkSession)
    docs = docs.select(quoted(id_col).cast("string").alias("id"), quoted(lang_col).cast("string").alias("lang"), whole_text(quoted(text_col)).alias("text")).where("lang is not null")
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    space = 1 << 31
    share = counts.select("lang", F.least(F.lit(1.0), 1.15 * MAX_PER_LANGUAGE / F.col("n")).alias("share"))
    # rows that repeat id and text are one; so about 1.15 * MAX_PER_LANGUAGE texts of a language are below its share
    chosen = docs.withColumn("h", F.pmod(F.xxhash64("id", "text"), F.lit(space))).join(small_or_shuffled(share), "lang").where(F.col("h") < F.col("share") * space)
    chosen = chosen.dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t) for t in batch.column("text").to_pylist()]
            arrays = [batch.column("lang"), batch.column("h"), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "h", "at", "n"])

    rows = sorted(chosen.select("lang", "h", "text").mapInArrow(run, "lang string, h long, at binary, n binary").collect(), key=lambda r: (r["h"], r["lang"], r["at"]))
    taken: dict[str, int] = {}
    sample = []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= MAX_PER_LANGUAGE:
            sample.append((r["lang"], np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["n"], "<f4").astype(float)))
    df, total = document_frequencies(docs, "text")
    return fit(sample, df, total)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred and score."""

    def worker() -> Callable[[list[str]], list[pa.Array]]:
        def make(texts: list[str]) -> list[pa.Array]:
            found = [model.predict(t) for t in texts]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]

        return make

    return with_results(docs, whole_text(quoted(text_col)), [text_col], [("lang_pred", "string"), ("score", "double")], worker)
