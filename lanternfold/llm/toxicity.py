"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled texts, one from toxic and one from ordinary text. Both hold the same
trained base of ordinary text; the toxic one ends with the segments that are over-represented in toxic texts, the
ordinary one with as many bytes of filler, so that lengths differ only by what is particular to toxic text. A text is cut
in overlapping windows of bytes; for each window, (length with the ordinary dictionary) - (length with the toxic one) is
how much nearer it is to toxic text. A logistic calibration, fitted on labelled texts that built no dictionary, turns the
largest differences and the number of windows over fixed thresholds into a score from 0 to 1.

The fit uses a bounded sample of labelled texts: ``MAX_TOXIC`` and ``MAX_ORDINARY`` texts of at most ``MAX_TRAIN_BYTES``
each, those with the least hash of the id; near copies of an earlier sample text count once. Scoring reads whole texts.

Defined results: null and empty texts have one empty window; without labels of both classes every score is 0; rows that
repeat give a row each; an empty table gives an empty result; other columns pass through untouched, but a column of the output's name is replaced.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.llm.common import quoted, whole_text, with_results

MAX_TOXIC, MAX_ORDINARY, MAX_TRAIN_BYTES = 900, 2400, 20_000
#: Share of the sample that builds the dictionaries; the rest fits the calibration.
DICTIONARY_SHARE = 0.6
WINDOW, STRIDE, LEVEL, BASE_BYTES = 64, 48, 6, 65_536
#: Segments: letters of a seed, least documents with it, least log-likelihood ratio, most segments.
SEED, MIN_DOCS, MIN_LLR, MAX_SEGMENTS = 5, 5, 40.0, 400
N_FEATURES = 8
THRESHOLD = 0.7


def prepared(text: str) -> bytes:
    """Lower case, white space as spaces, a space at each end."""
    return b" " + re.sub(r"\s", " ", text.lower()).encode("utf-8", "replace") + b" "


def windows(data: bytes) -> list[bytes]:
    """Overlapping windows that cover all of ``data``."""
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STRIDE)), STRIDE)]


@dataclass(frozen=True)
class ToxicityModel:
    base: bytes
    toxic_tail: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self) -> tuple:
        """One compressor for each dictionary: ordinary, toxic."""
        import zstandard

        out = []
        for tail in (b"\0" * len(self.toxic_tail), self.toxic_tail):
            data = zstandard.ZstdCompressionDict(self.base + tail, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(self.base) + len(tail), write_content_size=0, write_checksum=0, write_dict_id=0)
            data.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(compression_params=params, dict_data=data))
        return tuple(out)


def features(data: bytes, ordinary, toxic) -> list[float]:
    """What the calibration sees of a text: its greatest window differences and counts of windows over thresholds."""
    a, b = ordinary.compress, toxic.compress
    diff = sorted((len(a(w)) - len(b(w)) for w in windows(data)), reverse=True)
    n, top = len(diff), [max(x, 0) for x in diff]
    over = [sum(x >= k for x in diff) / math.sqrt(n) for k in (2, 3, 4)]
    return [diff[0], sum(top[:2]), sum(top[:4]), *over, math.log(n), sum(top) / n]


def _words(text: str) -> set[str]:
    return {w for x in text.lower().split() if len(w := x.strip(".,;:!?\"'()")) >= 4}


def _distinct(texts: list[str]) -> list[str]:
    """Texts of which no more than half the word 5-shingles were seen in earlier ones."""
    seen: set[int] = set()
    out = []
    for text in texts:
        w = text.split()
        shingles = {hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))}
        if 2 * len(shingles & seen) <= len(shingles):
            out.append(text)
            seen |= shingles
    return out


def toxic_segments(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Segments over-represented in toxic texts, the strongest first.

    Seeds are runs of SEED characters inside words. The seed with the greatest log-likelihood ratio over documents is
    taken and lengthened while nearly all its documents stay; the words that it explains then count no more.
    """
    docs_of: tuple[dict[str, set[int]], dict[str, set[int]]] = (defaultdict(set), defaultdict(set))
    for found, texts in zip(docs_of, (toxic, ordinary), strict=True):
        for i, text in enumerate(texts):
            for w in _words(text):
                found[w].add(i)
    in_toxic, in_ordinary = docs_of
    n, m = len(toxic), len(ordinary)

    def ratio(a: int, b: int) -> float:
        part = lambda p, x, k: (x * math.log(p) if x else 0.0) + ((k - x) * math.log(1 - p) if k > x else 0.0)
        return 2 * (part(a / n, a, n) + part(b / m, b, m) - part((a + b) / (n + m), a, n) - part((a + b) / (n + m), b, m))

    seeds = lambda w: {s[i : i + SEED] for s in (f" {w} ",) for i in range(len(s) - SEED + 1)}
    words_of: dict[str, list[str]] = defaultdict(list)
    for w, docs in in_toxic.items():
        if len(docs) / n > 2 * len(in_ordinary.get(w, ())) / m:
            for s in seeds(w):
                words_of[s].append(w)
    ordinary_of: dict[str, set[int]] = defaultdict(set)
    for w, docs in in_ordinary.items():
        for s in seeds(w):
            if s in words_of:
                ordinary_of[s] |= docs
    explained: set[str] = set()

    def score(seed: str) -> tuple[float, int]:
        docs: set[int] = set()
        for w in words_of[seed]:
            if w not in explained:
                docs |= in_toxic[w]
        a, b = len(docs), len(ordinary_of.get(seed, ()))
        return (ratio(a, b) if a >= MIN_DOCS and a / n > 5 * (b + 0.5) / m else 0.0), a

    heap = [(-s, seed) for seed in words_of if (s := score(seed)[0]) >= MIN_LLR]
    heapq.heapify(heap)
    out: list[str] = []
    while heap and len(out) < MAX_SEGMENTS:
        _, seed = heapq.heappop(heap)
        now, n_docs = score(seed)
        if now < MIN_LLR:
            continue
        if heap and now < -heap[0][0]:
            heapq.heappush(heap, (-now, seed))
            continue
        out.append(_lengthened(seed, [w for w in words_of[seed] if w not in explained], in_toxic, n_docs))
        explained.update(words_of[seed])
    return out


def _lengthened(segment: str, words: list[str], docs_of: dict[str, set[int]], n_docs: int) -> str:
    while True:
        longer: dict[str, set[int]] = defaultdict(set)
        for w in words:
            s = f" {w} "
            at = s.find(segment)
            while at >= 0:
                if at + len(segment) < len(s):
                    longer[s[at : at + len(segment) + 1]] |= docs_of[w]
                if at:
                    longer[s[at - 1 : at + len(segment)]] |= docs_of[w]
                at = s.find(segment, at + 1)
        best = max(sorted(longer), key=lambda x: len(longer[x]), default=None)
        if best is None or len(longer[best]) < 0.9 * n_docs:
            return segment
        segment = best


def fit(toxic: list[str], ordinary: list[str]) -> ToxicityModel | None:
    """Dictionaries from the first part of each class, the calibration from the rest."""
    import zstandard

    if len(toxic) < 2 * MIN_DOCS or len(ordinary) < 2 * MIN_DOCS:
        return None
    cut = [int(DICTIONARY_SHARE * len(x)) for x in (toxic, ordinary)]
    segments = toxic_segments(_distinct(toxic[: cut[0]]), _distinct(ordinary[: cut[1]]))
    samples = [w for t in ordinary[: cut[1]] for w in windows(prepared(t))]
    try:
        base = zstandard.train_dictionary(BASE_BYTES, samples, threads=0).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: it is its own dictionary
        base = b"".join(samples)[-BASE_BYTES:]
    # what stands last in a dictionary costs least to refer to
    tail = "".join(segments[::-1]).encode()
    model = ToxicityModel(base, tail, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1))
    pair = model.compressors()
    rows = [(features(prepared(t), *pair), y) for y, (texts, c) in enumerate(((ordinary, cut[1]), (toxic, cut[0]))) for t in texts[c:]]
    x, y = np.array([r for r, _ in rows]), np.array([k for _, k in rows], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(N_FEATURES + 1)
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
    return ToxicityModel(base, tail, mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    """Fit on a bounded sample of ``labels`` (id, label 0 or 1). Callers leave out the rows that must not teach."""
    texts: dict[int, list[str]] = {}
    one_text = docs.select(quoted(id_col).alias("id"), whole_text(quoted(text_col)).alias("text")).where(F.octet_length("text") <= MAX_TRAIN_BYTES)
    for y, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)):
        labelled = labels.where((quoted(label_col) == y) & quoted(id_col).isNotNull()).select(quoted(id_col).alias("id"))
        chosen = labelled.distinct().withColumn("h", F.xxhash64(F.col("id").cast("string"))).orderBy("h", "id").limit(most)
        rows = one_text.join(F.broadcast(chosen), "id").select("h", "text").orderBy("h", "text").limit(most).collect()  # `most` rows, however often an id repeats
        texts[y] = [r["text"] for r in rows]
    return fit(texts[1], texts[0])


def score_documents(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", keep_text: bool = False, out: str = "score") -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with the score, a double from 0 to 1, in column ``out``, which it replaces."""
    dropped = [] if keep_text else [text_col]
    if model is None:
        gone = {x.lower() for x in (*dropped, out)}
        return docs.select(*[quoted(c) for c in docs.columns if c.lower() not in gone], F.lit(0.0).alias(out))

    def worker() -> Callable[[list[str]], list[pa.Array]]:
        ordinary, toxic = model.compressors()

        def make(texts: list[str]) -> list[pa.Array]:
            x = np.array([features(prepared(t), ordinary, toxic) for t in texts]).reshape(-1, N_FEATURES)
            z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))] @ model.weights
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())]

        return make

    return with_results(docs, whole_text(quoted(text_col)), dropped, [(out, "double")], worker)
