"""Fusing ranked channels and building candidate pools, for all questions in one plan.

Channels are long: q, channel, cpos (place of the channel, from 0), rank (from 1), doc, score. A document may stand
several times in a channel; positions count repeats, as the raw lists do.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.operators.ranking import first_of_each, rank_scores, ranked, top_k

RRF_K, DEPTH_CAP = 60, 16
CANDIDATE_TOP_K, MAX_CANDIDATES = 12, 24


def reciprocal_rank_fusion(channels: DataFrame, k: int = RRF_K, top: int = 50) -> DataFrame:
    """q, doc, score, pos: the sum over channels of 1 / (k + rank) of the first occurrence; ties by first exposure, then doc."""
    once = channels.groupBy("q", "channel", "cpos", "doc").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("q", "doc").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("cpos", "rank")).alias("seen"))
    return top_k(fused, ["q"], [F.desc("score"), "seen", "doc"], top, "pos").select("q", "doc", "score", "pos")


def interleaved(channels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each question's documents in depth-major order, each once: q, doc, pos."""
    first = first_of_each(channels, by or ["q"], ["doc"], ["rank", "cpos"])
    return ranked(first, by or ["q"], ["rank", "cpos"], "pos")


def round_robin(channels: DataFrame, top: int) -> DataFrame:
    """q, doc, pos, score: depth-major, score 1 - pos0 / n."""
    kept = interleaved(channels).where(F.col("pos") <= top)
    return kept.select("q", "doc", "pos", (1 - (F.col("pos") - 1) / F.count("*").over(Window.partitionBy("q"))).alias("score"))


def best_channel_first(channels: DataFrame, top: int) -> DataFrame:
    """q, doc, pos: channels by their best score, one after the other, each document once."""
    best = channels.withColumn("best", F.max("score").over(Window.partitionBy("q", "channel")))
    order = [F.desc("best"), "cpos", "rank"]
    return top_k(first_of_each(best, ["q"], ["doc"], order), ["q"], order, top, "pos").select("q", "doc", "pos")


def pointwise_score(channels: DataFrame, top: int) -> DataFrame:
    """q, doc, score, pos: the sum of normalised scores over all occurrences; ties by the largest, first exposure, doc."""
    norm = rank_scores(channels, ["q", "channel"], "rank", "score")
    fused = norm.groupBy("q", "doc").agg(F.round(F.sum("norm"), 9).alias("score"), F.round(F.max("norm"), 9).alias("top"), F.min(F.struct("cpos", "rank")).alias("seen"))
    return top_k(fused, ["q"], [F.desc("score"), F.desc("top"), "seen", "doc"], top, "pos").select("q", "doc", "score", "pos")


def fuse(channels: DataFrame, method: str, top: int = 50, k: int = RRF_K) -> DataFrame:
    """Fusion by name: rrf, round_robin, best_channel_first or pointwise."""
    if method == "rrf":
        return reciprocal_rank_fusion(channels, k, top)
    return {"round_robin": round_robin, "best_channel_first": best_channel_first, "pointwise": pointwise_score}[method](channels, top)


def balanced_pool(channels: DataFrame, depth: int = CANDIDATE_TOP_K, most: int = MAX_CANDIDATES, seeds: DataFrame | None = None) -> DataFrame:
    """The channel-balanced pool: q, doc, pos. seeds (q, doc, rank) come first; then the channels depth-major."""
    rows = channels.where(F.col("rank") <= min(depth, DEPTH_CAP)).select("q", "doc", "rank", "cpos")
    if seeds is not None:
        rows = rows.unionByName(seeds.select("q", "doc", (F.col("rank") - 1_000_000).alias("rank"), F.lit(-1).alias("cpos")))
    return interleaved(rows).where(F.col("pos") <= most).select("q", "doc", "pos")


def appended(base: DataFrame, extra: DataFrame, order: list, most: int) -> DataFrame:
    """``base`` (q, doc, pos), then the documents of ``extra`` that it lacks in ``order``, ``most`` in all."""
    new = ranked(extra.join(base.select("q", "doc"), ["q", "doc"], "left_anti"), ["q"], order, "pos").select("q", "doc", (F.col("pos") + 1_000_000).alias("pos"))
    return ranked(base.unionByName(new), ["q"], ["pos"], "place").where(F.col("place") <= most).select("q", "doc", F.col("place").alias("pos"))


def cross_channel_pool(channels: DataFrame, base: int = 8, deep: int = 16, support: int = 2, most: int = MAX_CANDIDATES) -> DataFrame:
    """A shallow pool, then documents that ``support`` channels or more hold within ``deep``."""
    held = channels.where(F.col("rank") <= deep).groupBy("q", "doc").agg(F.countDistinct("channel").alias("n"), F.min(F.struct("rank", "cpos")).alias("seen"))
    return appended(balanced_pool(channels, base, most), held.where(F.col("n") >= support), ["seen"], most)


def terminal_pool(channels: DataFrame, terminals: DataFrame, base: int = 8, deep: int = 16, limit: int = 4, most: int = MAX_CANDIDATES) -> DataFrame:
    """A shallow pool, then at most ``limit`` more documents of the terminal channels (q, channel)."""
    start = balanced_pool(channels, base, most)
    held = channels.where(F.col("rank") <= deep).join(terminals, ["q", "channel"], "left_semi")
    extra = held.groupBy("q", "doc").agg(F.min(F.struct("rank", "cpos")).alias("seen")).join(start, ["q", "doc"], "left_anti")
    return appended(start, top_k(extra, ["q"], ["seen"], limit).drop("rank"), ["seen"], most)


def rolewise_pool(channels: DataFrame, depth: int = 5, most: int = MAX_CANDIDATES) -> DataFrame:
    """The heads of the channels one after the other, each document once."""
    first = first_of_each(channels.where(F.col("rank") <= depth), ["q"], ["doc"], ["cpos", "rank"])
    return top_k(first, ["q"], ["cpos", "rank"], most, "pos").select("q", "doc", "pos")


def consensus(channels: DataFrame, top: int, weights: DataFrame | None = None) -> DataFrame:
    """The sum of weight / (rank + 1); ties by the number of channels, best rank, doc. weights: channel, w."""
    once = channels.groupBy("q", "channel", "doc").agg(F.min("rank").alias("rank"))
    once = once.withColumn("w", F.lit(1.0)) if weights is None else once.join(F.broadcast(weights), "channel")
    fused = once.groupBy("q", "doc").agg(F.round(F.sum(F.col("w") / (F.col("rank") + 1)), 9).alias("score"), F.count("*").alias("n"), F.min("rank").alias("best"))
    return top_k(fused, ["q"], [F.desc("score"), F.desc("n"), "best", "doc"], top, "pos").select("q", "doc", "score", "pos")


def residual_repair_pool(selected: DataFrame, channels: DataFrame, pool: DataFrame, depth: int = CANDIDATE_TOP_K, most: int = MAX_CANDIDATES) -> DataFrame:
    """The selected documents, the heads of channels that hold none of them, then the pool."""
    covered = channels.where(F.col("rank") <= depth).join(selected.select("q", "doc"), ["q", "doc"], "left_semi").select("q", "channel").distinct()
    heads = channels.where("rank = 1").join(covered, ["q", "channel"], "left_anti").select("q", "doc", F.lit(1).alias("tier"), F.col("cpos").cast("long").alias("at"))
    rows = selected.select("q", "doc", F.lit(0).alias("tier"), F.col("pos").alias("at")).unionByName(heads).unionByName(pool.select("q", "doc", F.lit(2).alias("tier"), F.col("pos").alias("at")))
    return top_k(first_of_each(rows, ["q"], ["doc"], ["tier", "at"]), ["q"], ["tier", "at"], most, "place").select("q", "doc", F.col("place").alias("pos"))


def provenance(channels: DataFrame, pool: DataFrame, depth: int = CANDIDATE_TOP_K) -> DataFrame:
    """For each pooled document the channels that hold it: q, doc, pos, n, best, channels (by place, with the rank in each)."""
    held = channels.where(F.col("rank") <= depth).groupBy("q", "doc", "channel", "cpos").agg(F.min("rank").alias("rank"))
    rows = pool.join(held, ["q", "doc"]).groupBy("q", "doc", "pos").agg(F.count("*").alias("n"), F.min("rank").alias("best"), F.sort_array(F.collect_list(F.struct("cpos", "channel", "rank"))).alias("x"))
    return rows.select("q", "doc", "pos", "n", "best", F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["channel"], x["rank"].cast("string"))), ",").alias("channels"))


def shuffled_profile(pool: DataFrame, seed: int) -> DataFrame:
    """The control in which documents swap their profiles: q, doc, other (the document whose profile it gets).

    Documents in the order of sha256(``seed:q:doc``) face those in pool order.
    """
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("q").cast("string"), F.col("doc").cast("string")), 256)
    mixed = ranked(pool.withColumn("key", key), ["q"], ["key"], "at").select("q", F.col("doc").alias("other"), F.col("at").alias("pos"))
    return pool.select("q", "doc", "pos").join(mixed, ["q", "pos"])


def rank_vectors(channels: DataFrame, depth: int) -> DataFrame:
    """Each document's ranks by channel, depth + 1 where a channel lacks it: q, doc, v (array by cpos), seen."""
    held = channels.where(F.col("rank") <= depth)
    sizes = channels.groupBy("q").agg(F.max("cpos").alias("hi"))
    best = held.groupBy("q", "doc", "cpos").agg(F.min("rank").alias("rank")).groupBy("q", "doc").agg(F.map_from_entries(F.collect_list(F.struct("cpos", "rank"))).alias("m"), F.min(F.struct("rank", "cpos")).alias("seen"))
    return best.join(sizes, "q").select("q", "doc", F.transform(F.sequence(F.lit(0), F.col("hi")), lambda c: F.coalesce(F.element_at("m", c), F.lit(depth + 1).cast("long"))).alias("v"), "seen")


def pareto_layers(channels: DataFrame, depth: int = CANDIDATE_TOP_K, most: int = MAX_CANDIDATES) -> DataFrame:
    """The pool by non-dominated layers of the rank vectors; in a layer depth-major: q, doc, layer, pos.

    A question has at most channels x depth documents, so each is one small group.
    """

    def layers(rows: pd.DataFrame) -> pd.DataFrame:
        rest = sorted(zip(rows["seen_rank"], rows["seen_cpos"], rows["doc"], map(tuple, rows["v"]), strict=True))
        out, layer = [], 0
        while rest and len(out) < most:
            front = [r for r in rest if not any(o[3] != r[3] and all(x <= y for x, y in zip(o[3], r[3], strict=True)) for o in rest)]
            out += [(r[2], layer) for r in front]
            chosen = {r[2] for r in front}
            rest = [r for r in rest if r[2] not in chosen]
            layer += 1
        frame = pd.DataFrame(out[:most], columns=["doc", "layer"])
        frame.insert(0, "q", rows["q"].iloc[0])
        frame["pos"] = range(1, len(frame) + 1)
        return frame

    vectors = rank_vectors(channels, depth).select("q", "doc", "v", F.col("seen.rank").alias("seen_rank"), F.col("seen.cpos").alias("seen_cpos"))
    return vectors.groupBy("q").applyInPandas(layers, "q long, doc long, layer long, pos long")


def dominated(channels: DataFrame, pool: DataFrame, depth: int = CANDIDATE_TOP_K) -> DataFrame:
    """The pooled documents that another document of the channels dominates: q, doc."""
    vectors = rank_vectors(channels, depth)
    mine = vectors.join(pool.select("q", "doc"), ["q", "doc"], "left_semi").select("q", "doc", "v")
    other = vectors.select("q", F.col("doc").alias("other"), F.col("v").alias("w"))
    better = F.forall(F.zip_with("w", "v", lambda a, b: a <= b), lambda x: x) & F.exists(F.zip_with("w", "v", lambda a, b: a < b), lambda x: x)
    return mine.join(other, "q").where((F.col("other") != F.col("doc")) & better).select("q", "doc").distinct()


def pareto_repair_pool(channels: DataFrame, depth: int = CANDIDATE_TOP_K, most: int = MAX_CANDIDATES) -> DataFrame:
    """The balanced pool's size, undominated documents first, then the pool in its order."""
    pool = balanced_pool(channels, depth, most)
    bad = dominated(channels, pool, depth).withColumn("bad", F.lit(1))
    marked = pool.join(bad, ["q", "doc"], "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
    return ranked(marked, ["q"], ["bad", "pos"], "place").select("q", "doc", F.col("place").alias("pos"))


def demand_marginal_pool(channels: DataFrame, depth: int = CANDIDATE_TOP_K, most: int = MAX_CANDIDATES, alpha: float = 0.35, seeds: DataFrame | None = None) -> DataFrame:
    """Greedy coverage of demands: q, doc, pos. ``seeds`` (q, doc, rank) come first.

    A document's exposure to a channel is 1 / log2(1 + rank) within ``depth``. Each step takes the document with the greatest
    alpha * (its largest exposure) + (1 - alpha) * gain, where the gain is the sum of exposure * (1 - coverage) and the coverage of
    a channel is the largest exposure taken so far. Ties: gain, largest exposure, first seen in the order of channels and
    ranks, doc. A question's documents are a bounded list: channels times depth.
    """
    width = channels.agg(F.max("cpos")).first()[0]

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        shown, first = rows[rows["cpos"] >= 0].sort_values(["cpos", "rank"]), rows[rows["cpos"] < 0].sort_values("rank")["doc"].drop_duplicates().tolist()
        docs = shown["doc"].drop_duplicates().to_numpy()  # in the order first seen
        exposure = np.zeros((len(docs), (width or 0) + 1))
        at = {d: k for k, d in enumerate(docs)}
        np.maximum.at(exposure, (shown["doc"].map(at).to_numpy(int), shown["cpos"].to_numpy(int)), 1 / np.log2(1 + shown["rank"].to_numpy(float)))
        out = first[:most]
        free = ~np.isin(docs, out)
        cover = exposure[~free].max(0, initial=0.0)
        top = exposure.max(1, initial=0.0)
        while free.any() and len(out) < most:
            gain = exposure @ (1 - cover)
            order = np.lexsort((docs, np.arange(len(docs)), -top.round(9), -gain.round(9), -(alpha * top + (1 - alpha) * gain).round(9)))
            pick = order[free[order]][0]
            free[pick] = False
            cover = np.maximum(cover, exposure[pick])
            out.append(int(docs[pick]))
        return pd.DataFrame({"q": rows["q"].iloc[0], "doc": out, "pos": range(1, len(out) + 1)})

    rows = channels.where(F.col("rank") <= depth).select("q", "doc", F.col("cpos").cast("int").alias("cpos"), F.col("rank").cast("long").alias("rank"))
    if seeds is not None:
        rows = rows.unionByName(seeds.select("q", "doc", F.lit(-1).alias("cpos"), F.col("rank").cast("long").alias("rank")))
    return rows.groupBy("q").applyInPandas(greedy, "q long, doc long, pos long")


def candidate_pool(channels: DataFrame, policy: str, **options) -> DataFrame:
    """A pool by the name of its policy."""
    policies = {
        "balanced": balanced_pool, "cross_channel": cross_channel_pool, "terminal": terminal_pool, "rolewise": rolewise_pool,
        "pareto": pareto_layers, "pareto_repair": pareto_repair_pool, "demand_marginal": demand_marginal_pool,
    }
    if policy not in policies:
        raise ValueError(f"no policy {policy}; there are {', '.join(policies)}")
    return policies[policy](channels, **options)


#: What the clean main line demands of a configuration.
MAINLINE = {"admission": "balanced", "baseline_top_k": 0, "provenance": True, "objective": "demand", "construction": "selector_stable", "reader_top_k": 5}


def mainline_violations(config: dict) -> list[str]:
    """The settings of ``config`` that are not the main line's."""
    return [f"{k} is {config.get(k)!r}, not {v!r}" for k, v in MAINLINE.items() if config.get(k) != v]
