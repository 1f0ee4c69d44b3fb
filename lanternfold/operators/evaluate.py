"""Evaluation: retrieval recall, exact match, token F1, role coverage, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.functions.text import answer_text, words


def recall_at(gold: DataFrame, retrieved: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per question and k the share of its gold documents within rank k: q, k, recall. gold: q, doc; retrieved: q, doc, pos.

    Questions without gold have recall 0 if they have results.
    """
    gold = gold.select("q", "doc").distinct()
    golds = gold.groupBy("q").agg(F.count("*").alias("n"))
    depth = retrieved.sparkSession.createDataFrame([(k,) for k in ks], "k long")
    first = retrieved.groupBy("q", "doc").agg(F.min("pos").alias("pos")).join(gold, ["q", "doc"], "left_semi")
    hits = first.join(F.broadcast(depth), F.col("pos") <= F.col("k")).groupBy("q", "k").agg(F.count("*").alias("hits"))
    every = retrieved.select("q").union(gold.select("q")).distinct().crossJoin(F.broadcast(depth))
    return every.join(golds, "q", "left").join(hits, ["q", "k"], "left").select("q", "k", F.coalesce(F.coalesce("hits", F.lit(0)) / F.col("n"), F.lit(0.0)).alias("recall"))


def pooled_recall(per_question: DataFrame) -> DataFrame:
    """The mean recall at each k, to four places: k, recall."""
    return per_question.groupBy("k").agg(F.round(F.avg("recall"), 4).alias("recall"))


def exact_match(rows: DataFrame) -> DataFrame:
    """Per question 1 if a gold answer equals the prediction after normalising, else 0: q, em. rows: q, gold, prediction."""
    return rows.groupBy("q").agg(F.max((answer_text(F.col("gold")) == answer_text(F.col("prediction"))).cast("double")).alias("em"))


def token_f1(rows: DataFrame) -> DataFrame:
    """Per question the best F1 of the token multisets over its gold answers: q, f1. rows: q, gold_id, gold, prediction."""
    g = rows.select("q", "gold_id", words(answer_text(F.col("gold"))).alias("g"), words(answer_text(F.col("prediction"))).alias("p"))
    sizes = g.select("q", "gold_id", F.size("g").alias("ng"), F.size("p").alias("np"))
    count = lambda c, n: g.select("q", "gold_id", F.explode(c).alias("token")).groupBy("q", "gold_id", "token").agg(F.count("*").alias(n))
    common = count("g", "a").join(count("p", "b"), ["q", "gold_id", "token"]).groupBy("q", "gold_id").agg(F.sum(F.least("a", "b")).alias("same"))
    f1 = F.when(F.col("same") > 0, 2.0 * F.col("same") / (F.col("ng") + F.col("np"))).otherwise(0.0)
    return sizes.join(common, ["q", "gold_id"], "left").groupBy("q").agg(F.max(f1).alias("f1"))


def role_coverage_rate(chosen: DataFrame, role_scores: DataFrame) -> DataFrame:
    """Per question the mean over its roles of the best score in the chosen set: q, rate."""
    roles = role_scores.groupBy("q").agg(F.countDistinct("role").alias("n"))
    best = role_scores.join(chosen.select("q", "doc"), ["q", "doc"], "left_semi").groupBy("q", "role").agg(F.max("s").alias("m")).groupBy("q").agg(F.sum("m").alias("m"))
    return roles.join(best, "q", "left").select("q", (F.coalesce("m", F.lit(0.0)) / F.col("n")).alias("rate"))


def summary(rows: DataFrame) -> DataFrame:
    """Per variant the mean and how many questions are better, worse or other than the baseline's: rows: variant, q, value, base."""
    better, worse = F.col("value") > F.col("base"), F.col("value") < F.col("base")
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(F.col("value") - F.col("base")).alias("delta"), F.count_if(better).alias("improved"), F.count_if(worse).alias("worsened"), F.count_if(better | worse).alias("changed"))


def macro(rows: DataFrame) -> DataFrame:
    """Means by dataset and their mean (dataset ``macro``): rows: dataset, value."""
    each = rows.groupBy("dataset").agg(F.avg("value").alias("value"))
    return each.unionByName(each.agg(F.lit("macro").alias("dataset"), F.avg("value").alias("value")))
