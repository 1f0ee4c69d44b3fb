"""Final evidence sets: from a pool in order and a selector's choice, or greedy by coverage.

pool: q, doc, pos (from 1). selected: q, doc, spos (from 1), members of the pool, each once.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfold.operators.ranking import top_k

TOP = 5


def _both(pool: DataFrame, selected: DataFrame) -> DataFrame:
    return pool.join(selected, ["q", "doc"], "left")


def _filled(scored: DataFrame, order: list, top: int) -> DataFrame:
    return top_k(scored, ["q"], order, top, "place").select("q", "doc", F.col("place").alias("pos"))


def selector_stable(pool: DataFrame, selected: DataFrame, top: int = TOP) -> DataFrame:
    """The selected documents in pool order, then the pool in order."""
    return _filled(_both(pool, selected), [F.col("spos").isNull(), "pos"], top)


def rank_product(pool: DataFrame, selected: DataFrame, top: int = TOP) -> DataFrame:
    """The selected ones by 1 / (pool rank * selector rank), then the pool in order."""
    score = F.coalesce(1.0 / (F.col("pos") * F.col("spos")), F.lit(0.0))
    return _filled(_both(pool, selected).withColumn("s", score), [F.desc("s"), "pos"], top)


def _isr(pool: DataFrame, selected: DataFrame) -> DataFrame:
    square = lambda c: F.coalesce(1.0 / (F.col(c) * F.col(c)), F.lit(0.0))
    return _both(pool, selected).withColumn("s", F.round(square("pos") + square("spos"), 9))


def isr_fusion(pool: DataFrame, selected: DataFrame, top: int = TOP) -> DataFrame:
    """By the sum of the inverse squares of both ranks."""
    return _filled(_isr(pool, selected), [F.desc("s"), "pos"], top)


def isr_stable(pool: DataFrame, selected: DataFrame, top: int = TOP) -> DataFrame:
    """The members of ``isr_fusion`` in pool order."""
    kept = top_k(_isr(pool, selected), ["q"], [F.desc("s"), "pos"], top, "place")
    return _filled(kept.drop("place"), ["pos"], top)


def rank_fusion(pool: DataFrame, selected: DataFrame, top: int = TOP, k: int = 5, weight: float = 0.5) -> DataFrame:
    """By 1 / (k + pool rank) + weight / (k + selector rank)."""
    score = F.round(1.0 / (k + F.col("pos")) + F.coalesce(weight / (k + F.col("spos")), F.lit(0.0)), 9)
    return _filled(_both(pool, selected).withColumn("s", score), [F.desc("s"), "pos"], top)


def evidence_set(pool: DataFrame, selected: DataFrame, construction: str = "selector_stable", top: int = TOP) -> DataFrame:
    """A final set by the name of its construction."""
    names = {"selector_stable": selector_stable, "isr_stable": isr_stable, "rank_fusion": rank_fusion}
    if construction not in names:
        raise ValueError(f"no construction {construction}; there are {', '.join(names)}")
    return names[construction](pool, selected, top)


def coverage_greedy(channels: DataFrame, pool: DataFrame, depth: int = 12, top: int = TOP) -> DataFrame:
    """Each step takes the document with most uncovered channels, then most channels, then the first in the pool: q, doc, pos."""

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, set[int]] = {}
        place: dict[int, int] = {}
        for doc, pos, c in zip(rows["doc"], rows["pos"], rows["cpos"], strict=True):
            place[int(doc)] = int(pos)
            held.setdefault(int(doc), set()).update([] if pd.isna(c) else [int(c)])
        covered: set[int] = set()
        out: list[int] = []
        while place and len(out) < top:
            pick = min(place, key=lambda d: (-len(held[d] - covered), -len(held[d]), place[d]))
            covered |= held[pick]
            del place[pick]
            out.append(pick)
        return pd.DataFrame({"q": rows["q"].iloc[0], "doc": out, "pos": range(1, len(out) + 1)})

    held = channels.where(F.col("rank") <= depth).select("q", "doc", "cpos").distinct()
    return pool.join(held, ["q", "doc"], "left").select("q", "doc", "pos", "cpos").groupBy("q").applyInPandas(greedy, "q long, doc long, pos long")


def role_coverage(base: DataFrame, role_scores: DataFrame, top: int = TOP, weight: float = 0.1) -> DataFrame:
    """Greedy for the sum over roles of the best score + weight * the sum of base scores: q, doc, pos.

    base: q, doc, pos, score; role_scores: q, doc, role, s. Ties: greater coverage gain, base score, place.
    """

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        place: dict[int, int] = {}
        score: dict[int, float] = {}
        roles: dict[int, dict[str, float]] = {}
        for doc, pos, b, role, s in zip(rows["doc"], rows["pos"], rows["score"], rows["role"], rows["s"], strict=True):
            place[int(doc)], score[int(doc)] = int(pos), float(b)
            if role is not None and not pd.isna(s):
                roles.setdefault(int(doc), {})[role] = float(s)
        best: dict[str, float] = {}
        out: list[int] = []
        while place and len(out) < top:
            def value(d: int) -> tuple:
                gain = sum(max(0.0, s - best.get(r, 0.0)) for r, s in roles.get(d, {}).items())
                return (round(gain + weight * score[d], 9), round(gain, 9), score[d], -place[d])

            pick = max(place, key=value)
            for r, s in roles.get(pick, {}).items():
                best[r] = max(best.get(r, 0.0), s)
            del place[pick]
            out.append(pick)
        return pd.DataFrame({"q": rows["q"].iloc[0], "doc": out, "pos": range(1, len(out) + 1)})

    rows = base.join(role_scores, ["q", "doc"], "left").select("q", "doc", "pos", "score", "role", "s")
    return rows.groupBy("q").applyInPandas(greedy, "q long, doc long, pos long")


def coverage_value(chosen: DataFrame, role_scores: DataFrame, base: DataFrame, weight: float) -> DataFrame:
    """The objective of ``role_coverage`` for a chosen set: q, value. chosen: q, doc."""
    per_role = chosen.join(role_scores, ["q", "doc"]).groupBy("q", "role").agg(F.max("s").alias("m")).groupBy("q").agg(F.sum("m").alias("cover"))
    relevance = chosen.join(base.select("q", "doc", "score"), ["q", "doc"]).groupBy("q").agg(F.sum("score").alias("rel"))
    return relevance.join(per_role, "q", "left").select("q", (F.coalesce("cover", F.lit(0.0)) + weight * F.col("rel")).alias("value"))


def pointwise_merge(base: DataFrame, role_scores: DataFrame, top: int = TOP, weight: float = 0.1) -> DataFrame:
    """By the sum of role scores + weight * base, then the largest role score, base, place."""
    summed = role_scores.groupBy("q", "doc").agg(F.sum("s").alias("total"), F.max("s").alias("most"))
    rows = base.join(summed, ["q", "doc"], "left").withColumns({"total": F.coalesce("total", F.lit(0.0)), "most": F.coalesce("most", F.lit(0.0))})
    value = F.round(F.col("total") + weight * F.col("score"), 9)
    return _filled(rows.withColumn("value", value), [F.desc("value"), F.desc("most"), F.desc("score"), "pos"], top)


def role_scores_from_ranks(channels: DataFrame, pool: DataFrame) -> DataFrame:
    """Each pooled document's normalised score in each channel of its question, 0 where the channel lacks it: q, doc, role, s."""
    from lanternfold.operators.ranking import rank_scores

    norm = rank_scores(channels, ["q", "channel"], "rank", "score").groupBy("q", "channel", "doc").agg(F.max("norm").alias("s"))
    roles = channels.select("q", "channel").distinct()
    return pool.select("q", "doc").join(roles, "q").join(norm, ["q", "channel", "doc"], "left").select("q", "doc", F.col("channel").alias("role"), F.coalesce("s", F.lit(0.0)).alias("s"))


def residual_optimum(channels: DataFrame, pool: DataFrame, backbone: DataFrame, depth: int = 12, top: int = TOP) -> DataFrame:
    """The best set of ``top`` pooled documents: q, docs (joined, ascending).

    Allowed: sets that lose no role of the backbone, make no role's best rank worse, and gain a role. Of these the one with
    most roles, least sum of best ranks, most backbone documents, least sum of pool places, least documents; else the
    backbone. The search is exhaustive over one question's pool.
    """

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        ranks: dict[int, dict[int, int]] = {}
        place: dict[int, int] = {}
        bone: set[int] = set()
        for doc, pos, c, r, b in zip(rows["doc"], rows["pos"], rows["cpos"], rows["rank"], rows["bone"], strict=True):
            place[int(doc)] = int(pos)
            held = ranks.setdefault(int(doc), {})
            if not pd.isna(c):
                held[int(c)] = min(int(r), held.get(int(c), 1 << 30))
            if b:
                bone.add(int(doc))

        def best(docs) -> dict[int, int]:
            out: dict[int, int] = {}
            for d in docs:
                for c, r in ranks[d].items():
                    out[c] = min(r, out.get(c, 1 << 30))
            return out

        start = best(bone)
        every = best(place)
        found = None
        if len(every) > len(start):
            for docs in combinations(sorted(place), min(top, len(place))):
                have = best(docs)
                if len(have) <= len(start) or any(have.get(c, 1 << 30) > r for c, r in start.items()):
                    continue
                key = (-len(have), sum(have.values()), -len(bone.intersection(docs)), sum(place[d] for d in docs), docs)
                if found is None or key < found:
                    found = key
        docs = found[-1] if found else tuple(sorted(bone))
        return pd.DataFrame({"q": [rows["q"].iloc[0]], "docs": [",".join(map(str, docs))]})

    held = channels.where(F.col("rank") <= depth).groupBy("q", "doc", "cpos").agg(F.min("rank").alias("rank"))
    marked = pool.join(backbone.select("q", "doc", F.lit(True).alias("bone")), ["q", "doc"], "left").withColumn("bone", F.coalesce("bone", F.lit(False)))
    return marked.join(held, ["q", "doc"], "left").select("q", "doc", "pos", "cpos", "rank", "bone").groupBy("q").applyInPandas(search, "q long, docs string")


def verifier_shortlist(pool: DataFrame, compatibility: DataFrame, head: int = 3, size: int = 8) -> DataFrame:
    """The head of the pool, then the documents of greatest compatibility: q, doc, pos. compatibility: q, doc, c."""
    rows = pool.join(compatibility, ["q", "doc"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    first: Column = F.col("pos") <= head
    return _filled(rows, [~first, F.when(first, F.col("pos")).otherwise(0), F.desc(F.round("c", 9)), "pos"], size)


