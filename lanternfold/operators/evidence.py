"""Endpoint-specific ranking, fact filters with a cache, and the order in which evidence is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.operators.ranking import top_k

#: Weights of a document's place in the evidence: coverage, BM25, links, and the four priors.
ORDER_WEIGHTS = {"coverage": 1.25, "bm25": 0.65, "link": 1.15, "anchor": 1.35, "specificity": 1.05, "support": 0.75, "neighbourhood": 0.65}
#: Of these the logarithm of 1 + value counts.
ORDER_LOGS = ("bm25", "link")


def smooth_idf(rows: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """ln((N + 1) / (n + 0.5)) + 1 of each ``key`` over the documents: key, idf."""
    total = rows.agg(F.countDistinct(doc).alias("total"))
    counts = rows.groupBy(key).agg(F.countDistinct(doc).alias("n"))
    return counts.join(F.broadcast(total)).select(key, (F.log((F.col("total") + 1) / (F.col("n") + 0.5)) + 1).alias("idf"))  # total is one row


def endpoint_documents(questions: DataFrame, endpoints: DataFrame, tokens: DataFrame, top: int = 20) -> DataFrame:
    """Documents by the endpoints that a question touches: q, doc, score, rank.

    score = idf of the endpoints that share a token with the question + idf of the question's tokens that the document's
    endpoints have. questions: q, token; endpoints: doc, endpoint; tokens: endpoint, token.
    """
    held, named = endpoints.select("doc", "endpoint").distinct(), tokens.select("endpoint", "token").distinct()
    asked = questions.select("q", "token").distinct()
    words = held.join(named, "endpoint").select("doc", "token").distinct()
    touched = asked.join(named, "token").select("q", "endpoint").distinct()
    by_endpoint = touched.join(held, "endpoint").join(smooth_idf(held, "endpoint"), "endpoint").select("q", "doc", "idf")
    by_token = asked.join(words, "token").join(smooth_idf(words, "token"), "token").select("q", "doc", "idf")
    scored = by_endpoint.unionByName(by_token).groupBy("q", "doc").agg(F.round(F.sum("idf"), 9).alias("score"))
    return top_k(scored, ["q"], [F.desc("score"), "doc"], top, "rank").select("q", "doc", "score", "rank")


def filtered_facts(candidates: DataFrame, named: DataFrame, top: int = 5) -> DataFrame:
    """The candidates that a filter named, in its order: q, fact, rank, fallback.

    A name that is no candidate's text counts as the nearest one by edit distance, then by place. A question whose filter
    named nothing keeps its candidates in their order. candidates: q, place, fact, text, ``top`` or so a question;
    named: q, at, text.
    """
    near = candidates.join(named.select("q", "at", F.col("text").alias("said")), "q").select("q", "at", "place", "fact", F.levenshtein("text", "said").alias("distance"))
    best = near.groupBy("q", "at").agg(F.min_by("fact", F.struct("distance", "place")).alias("fact"))
    once = best.groupBy("q", "fact").agg(F.min("at").alias("at")).withColumn("fallback", F.lit(False))
    silent = candidates.join(once.select("q").distinct(), "q", "left_anti").select("q", "fact", F.col("place").alias("at"), F.lit(True).alias("fallback"))
    return top_k(once.unionByName(silent), ["q"], ["at", "fact"], top, "rank").select("q", "fact", "rank", "fallback")


def filter_keys(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The cache key of each question's filter request: q, key. It covers the question and the candidates in their order."""
    listed = candidates.groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("listed"))
    return questions.join(listed, "q").select("q", F.sha2(F.concat_ws("\n", "question", "listed"), 256).alias("key"))


def filtered_facts_cached(questions: DataFrame, candidates: DataFrame, cache: DataFrame, top: int = 5) -> DataFrame:
    """``filtered_facts`` with the answers of a cache (key, at, text), where it has the question's key: q, fact, rank, fallback, cached."""
    hits = filter_keys(questions, candidates).join(cache, "key").select("q", "at", "text")
    known = hits.select("q").distinct().withColumn("cached", F.lit(True))
    return filtered_facts(candidates, hits, top).join(known, "q", "left").fillna(False, ["cached"])


def reading_order(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The order in which chosen documents are read: q, doc, pos. Anchors come first in their order, then the rest by score.

    docs: q, doc and the columns of ORDER_WEIGHTS; anchors: q, doc, rank.
    """
    def term(name: str, weight: float) -> Column:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return weight * (F.log1p(F.greatest(value, F.lit(0.0))) if name in ORDER_LOGS else value)

    score = sum((term(name, weight) for name, weight in ORDER_WEIGHTS.items()), F.lit(0.0))
    first = anchors.groupBy("q", "doc").agg(F.min("rank").alias("anchor_rank"))
    rows = docs.withColumn("score", F.round(score, 9)).join(first, ["q", "doc"], "left")
    order = Window.partitionBy("q").orderBy(F.asc_nulls_last("anchor_rank"), F.when(F.col("anchor_rank").isNull(), -F.col("score")), "doc")
    return rows.select("q", "doc", F.row_number().over(order).cast("long").alias("pos"))
