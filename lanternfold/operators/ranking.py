"""Ranking inside groups: top k, first of each, order-preserving dedup, rank priors, score normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """``df`` with a 1-based rank inside each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank. The limit on row_number lets Spark cut groups before the shuffle."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def first_of_each(df: DataFrame, by: list[str], key: list[str], order: list) -> DataFrame:
    """Per group and key the first row in ``order``: an order-preserving dedup."""
    rn = F.row_number().over(Window.partitionBy(*by, *key).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def min_max(score: Column, by: list[str]) -> Column:
    """(x - min) / (max - min) inside a group; 1 where all scores are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi > lo, (score - lo) / (hi - lo)).otherwise(F.lit(1.0))


def min_max_zero_safe(score: Column, by: list[str]) -> Column:
    """``min_max``, but 0 where all scores are 0."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi > lo, (score - lo) / (hi - lo)).when(hi == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def rank_scores(df: DataFrame, by: list[str], rank: str, score: str) -> DataFrame:
    """Min-max of the scores; where a group has none or they are equal, 1 - rank0 / max(n - 1, 1). Adds ``norm``."""
    w = Window.partitionBy(*by)
    lo, hi, n = F.min(score).over(w), F.max(score).over(w), F.count("*").over(w)
    prior = 1 - (F.col(rank) - 1) / F.greatest(n - 1, F.lit(1))
    return df.withColumn("norm", F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(prior))


def rank_prior(rank: Column, scale: float = 1.0) -> Column:
    """scale / sqrt(rank)."""
    return F.lit(scale) / F.sqrt(rank.cast("double"))


def concentration(df: DataFrame, by: list[str], score: str, k: int = 5) -> DataFrame:
    """Per group the best score over the mean of the k best."""
    top = top_k(df, by, [F.col(score).desc()], k)
    return top.groupBy(*by).agg((F.max(score) / (F.avg(score) + 1e-8)).alias("concentration"))
