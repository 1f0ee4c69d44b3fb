"""Candidate channels of the canonical interface: passages ranked by how a question's activated facts support them.

activation: q, fact, frank (rank of the fact); entities: q, entity; dense: q, passage, drank; facts: fact, passage, s, r, o.
Ties end with the passage id descending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.operators.ranking import top_k
from lanternfold.operators.shared import kept, small_or_shuffled

FAR = 1 << 30


def _ranked(rows: DataFrame, order: list, top: int) -> DataFrame:
    return top_k(rows, ["q"], [*order, F.desc("passage")], top).select("q", "passage", "rank")


def _stated(rows: DataFrame, fact: str, facts: DataFrame) -> DataFrame:
    """``rows``, kept, with the passages that state their ``fact``. Where the rows' facts are few, the others are not shuffled."""
    rows = kept(rows)
    wanted = small_or_shuffled(kept(rows.select(fact).distinct()))
    return rows.join(facts.select(F.col("fact").alias(fact), "passage").join(wanted, fact, "left_semi").distinct(), fact)


def _evidence(activation: DataFrame, entities: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    by_fact = activation.join(facts.select("fact", "passage").distinct(), "fact").groupBy("q", "passage").agg(F.countDistinct("fact").alias("n_fact"), F.min("frank").alias("best_fact"))
    named = facts.select("passage", F.explode(F.array("s", "o")).alias("entity")).distinct()
    by_entity = entities.join(named, "entity").groupBy("q", "passage").agg(F.countDistinct("entity").alias("n_entity"))
    return by_fact, by_entity


def coverage(activation: DataFrame, entities: DataFrame, dense: DataFrame, facts: DataFrame, top: int) -> DataFrame:
    """By facts, entities, then dense rank."""
    by_fact, by_entity = _evidence(activation, entities, facts)
    rows = by_fact.join(by_entity, ["q", "passage"], "full_outer").join(dense, ["q", "passage"], "full_outer")
    rows = rows.fillna(0, ["n_fact", "n_entity"]).fillna(FAR, ["drank"])
    return _ranked(rows, [F.col("n_fact") == 0, F.desc("n_fact"), F.col("n_entity") == 0, F.desc("n_entity"), "drank"], top)


def support(activation: DataFrame, entities: DataFrame, dense: DataFrame, facts: DataFrame, top: int) -> DataFrame:
    """By (entity, relation) pairs shared with the activated facts, endpoints, entities, best fact rank, dense rank."""
    asked = activation.join(facts.select("fact", "s", "r", "o").distinct(), "fact")
    pair = lambda df, keep: df.select(*keep, F.explode(F.array(F.struct(F.col("s").alias("e"), "r"), F.struct(F.col("o").alias("e"), "r"))).alias("x")).select(*keep, "x.e", "x.r").distinct()
    have = pair(facts, ["passage"])
    by_pair = pair(asked, ["q", "frank"]).groupBy("q", "e", "r").agg(F.min("frank").alias("frank")).join(have, ["e", "r"]).groupBy("q", "passage").agg(F.count("*").alias("n_pair"), F.min("frank").alias("best_pair"))
    by_fact, by_entity = _evidence(activation, entities, facts)
    rows = by_pair.join(by_fact, ["q", "passage"], "full_outer").join(by_entity, ["q", "passage"], "full_outer").join(dense, ["q", "passage"], "left")
    rows = rows.fillna(0, ["n_pair", "n_fact", "n_entity"]).fillna(FAR, ["best_pair", "best_fact", "drank"])
    return _ranked(rows, [F.desc("n_pair"), "best_pair", F.desc("n_entity"), "best_fact", "drank"], top)


def slot_tier(activation: DataFrame, dense: DataFrame, facts: DataFrame, top: int) -> DataFrame:
    """By slots of the activated facts that a passage supports: as target, as exact fact, as anchor, as entity; then dense rank."""
    asked = activation.join(facts.select("fact", "s", "r", "o").distinct(), "fact")
    states = facts.select("passage", "s", "r", "o").distinct()
    tier = lambda on, name: asked.select("q", *on).distinct().join(states.select("passage", *on).distinct(), on).groupBy("q", "passage").agg(F.count("*").alias(name))
    rows = tier(["r", "o"], "target").join(tier(["s", "r", "o"], "exact"), ["q", "passage"], "full_outer").join(tier(["s", "r"], "anchor"), ["q", "passage"], "full_outer")
    rows = rows.join(dense, ["q", "passage"], "left").fillna(0, ["target", "exact", "anchor"]).fillna(FAR, ["drank"])
    return _ranked(rows, [F.desc("target"), F.desc("exact"), F.desc("anchor"), "drank"], top)


def bridge_path(activation: DataFrame, paths: DataFrame, facts: DataFrame, top: int) -> DataFrame:
    """By bridges from activated facts: the facts at their far ends state the passages; more paths, shared entities, shared passages, best rank."""
    both = paths.select(F.col("left").alias("fact"), F.col("right").alias("far"), "entity_overlap", "source_overlap").unionByName(paths.select(F.col("right").alias("fact"), F.col("left").alias("far"), "entity_overlap", "source_overlap"))
    hop = _stated(activation.join(both, "fact"), "far", facts)
    rows = hop.groupBy("q", "passage").agg(F.count("*").alias("n"), F.countDistinct("fact").alias("n_fact"), F.sum("entity_overlap").alias("ent"), F.sum("source_overlap").alias("src"), F.min("frank").alias("best"))
    return _ranked(rows, [F.desc("n"), F.desc("n_fact"), F.desc("ent"), F.desc("src"), "best"], top)


def support_trail(activation: DataFrame, found: DataFrame, facts: DataFrame, top: int) -> DataFrame:
    """By trails that start at activated facts: more trails, more activated facts on them, best rank."""
    members = found.withColumn("fact", F.explode(F.array("start", "middle", "end")))
    mine = activation.select("q", F.col("fact").alias("start"), "frank").join(members, "start")
    held = _stated(mine, "fact", facts)
    rows = held.groupBy("q", "passage").agg(F.countDistinct("start", "middle", "end").alias("n"), F.countDistinct("fact").alias("n_fact"), F.min("frank").alias("best"))
    return _ranked(rows, [F.desc("n"), F.desc("n_fact"), "best"], top)


def route(activation: DataFrame, head: DataFrame, dense: DataFrame, facts: DataFrame, top: int) -> DataFrame:
    """Passages reached from the entities of the head passages (q, passage): by activated facts, shared entities, dense rank."""
    named = facts.select("passage", F.explode(F.array("s", "o")).alias("entity")).distinct()
    entities = head.join(named, "passage").select("q", "entity").distinct()
    by_fact, by_entity = _evidence(activation, entities, facts)
    rows = by_entity.join(by_fact, ["q", "passage"], "left").join(dense, ["q", "passage"], "left").fillna(0, ["n_fact"]).fillna(FAR, ["drank"])
    return _ranked(rows, [F.desc("n_fact"), F.desc("n_entity"), "drank"], top)


def deficits(activation: DataFrame, head: DataFrame, facts: DataFrame) -> DataFrame:
    """Activated facts that no head passage states, with weights by rank, normalised: q, fact, weight."""
    stated = head.join(facts.select("fact", "passage").distinct(), "passage").select("q", "fact").distinct()
    open_ = activation.join(stated, ["q", "fact"], "left_anti").withColumn("w", 1.0 / F.col("frank"))
    total = open_.groupBy("q").agg(F.sum("w").alias("t"))
    return open_.join(total, "q").select("q", "fact", (F.col("w") / F.col("t")).alias("weight"))


def local_subgraph(candidates: DataFrame, activation: DataFrame, facts: DataFrame) -> DataFrame:
    """The edges among a question's candidates, activated facts and their entities: q, edge_type, src, dst."""
    stated = facts.select("fact", "passage").distinct()
    ends = facts.select("fact", F.explode(F.array("s", "o")).alias("entity")).distinct()
    fp = candidates.join(stated, "passage").join(activation.select("q", "fact"), ["q", "fact"], "left_semi").select("q", F.lit("fact_passage").alias("edge_type"), F.col("fact").alias("src"), F.col("passage").alias("dst"))
    fe = activation.join(ends, "fact").select("q", F.lit("fact_entity").alias("edge_type"), F.col("fact").alias("src"), F.col("entity").alias("dst"))
    return fp.unionByName(fe).distinct()
