"""Role-channel retrieval: a ranked channel for each evidence role of a question, filters on their facts, one fused list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.operators import fusion
from lanternfold.operators.vector import dense_scores


def role_channels(roles: DataFrame, keys: DataFrame, depth: int = 50, top: int = 20) -> DataFrame:
    """The fused list of each question's role channels: q, doc, score, pos. roles: q, role, cpos, v; keys: id, v.

    All roles of all questions are scored in one blocked product; a question without roles has no row.
    """
    numbered = roles.withColumn("rid", F.col("q") * 1000 + F.col("cpos"))
    scored = dense_scores(numbered.select(F.col("rid").alias("id"), "v"), keys, k=depth)
    channels = scored.withColumnRenamed("q", "rid").join(numbered.select("rid", "q", F.col("role").alias("channel"), F.col("cpos").cast("int").alias("cpos")), "rid")
    return fusion.reciprocal_rank_fusion(channels.select("q", "channel", "cpos", F.col("id").alias("doc"), "rank", "score"), fusion.RRF_K, top)


def shared_filter(channels: DataFrame, decided: DataFrame, depth: int = 5) -> DataFrame:
    """One decision for a question's facts, projected back on its roles: q, channel, doc, rank, kept.

    decided: q, doc (what the filter kept of the union of all roles' top facts). A role that keeps none falls back to its first.
    """
    top = channels.where(F.col("rank") <= depth).groupBy("q", "channel", "doc").agg(F.min("rank").alias("rank"))
    marked = top.join(decided.withColumn("kept", F.lit(True)), ["q", "doc"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    w = Window.partitionBy("q", "channel")
    seen = marked.withColumns({"any": F.max("kept").over(w), "first": F.min("rank").over(w)})
    return seen.where("kept or (not any and rank = first)").select("q", "channel", "doc", "rank", "kept")
