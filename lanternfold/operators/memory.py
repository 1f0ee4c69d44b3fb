"""Continual memory: merging records step by step, deletion cascades, support indexes, bridges between facts, trails.

Facts are long: fact (id), passage, s, r, o.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.operators import units
from lanternfold.operators.ranking import top_k
from lanternfold.operators.shared import kept, small_or_shuffled

PATHS_PER_FACT, TRAIL_NEIGHBOURS, TRAILS_PER_FACT = 32, 4, 8


def merged_records(batches: DataFrame) -> DataFrame:
    """Entity records from observations of all steps: entity, sources, support, first_seen, last_seen. batches: entity, source, step, n."""
    return batches.groupBy("entity").agg(F.countDistinct("source").alias("sources"), F.sum("n").alias("support"), F.min("step").alias("first_seen"), F.max("step").alias("last_seen"))


def upsert(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State and a batch, both entity, sources (array), support, last_seen: union of sources, sum, latest step."""
    both = state.unionByName(batch)
    return both.groupBy("entity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.sum("support").alias("support"), F.max("last_seen").alias("last_seen"))


def merge_score(same_relation, shared_participants, similarity):
    """0.4 * same relation + 0.4 * share of participants + 0.2 * text similarity: what decides if two propositions are one."""
    return 0.4 * same_relation.cast("double") + 0.4 * shared_participants + 0.2 * similarity


def merged_propositions(candidates: DataFrame) -> DataFrame:
    """Propositions of one id as one record: h, sources, support, last_seen, snippets. candidates: h, source, step, support, snippet."""
    first = candidates.groupBy("h", "snippet").agg(F.min(F.struct("step", "source")).alias("at"))
    snippets = first.groupBy("h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "snippet"))), lambda x: x["snippet"]), "|").alias("snippets"))
    merged = candidates.groupBy("h").agg(F.countDistinct("source").alias("sources"), F.sum("support").alias("support"), F.max("step").alias("last_seen"))
    return merged.join(snippets, "h")


def after_deletion(records: DataFrame, gone: DataFrame) -> DataFrame:
    """Records without deleted sources; support is what is left, records without any drop out. records: id, source; gone: source."""
    return records.select("id", "source").distinct().join(gone.select("source"), "source", "left_anti").groupBy("id").agg(F.count("*").alias("support"))


def support_index(facts: DataFrame) -> DataFrame:
    """The inverted support index: kind, k1, k2, k3, n passages, first passage.

    Kinds: fact (s, r, o), pair (entity, relation), anchor and target (side, relation, entity), entity, relation.
    """
    key = lambda *parts: F.struct(*[F.lit(p).alias(n) if p in ("", "subject", "object") or n == "kind" else F.col(p).alias(n) for n, p in zip(("kind", "k1", "k2", "k3"), parts, strict=True)])
    keys = F.array(
        key("fact", "s", "r", "o"), key("pair", "s", "r", ""), key("pair", "o", "r", ""), key("anchor", "subject", "r", "s"), key("target", "object", "r", "o"),
        key("entity", "s", "", ""), key("entity", "o", "", ""), key("relation", "r", "", ""),
    )
    rows = facts.select("passage", F.explode(keys).alias("k")).select("passage", "k.*")
    return rows.groupBy("kind", "k1", "k2", "k3").agg(F.countDistinct("passage").alias("n"), F.min("passage").alias("first_passage"))


def slot_support(facts: DataFrame) -> DataFrame:
    """The support of each slot of a fact, by tier: fact, slot, entity, exact, pair, entity_support (passages).

    Slots are the subject (anchor) and the object (target).
    """
    slots = facts.select("fact", "r", F.explode(F.array(F.struct(F.lit("anchor").alias("slot"), F.col("s").alias("entity")), F.struct(F.lit("target").alias("slot"), F.col("o").alias("entity")))).alias("x")).select("fact", "r", "x.slot", "x.entity").distinct()
    index = support_index(facts)
    exact = index.where("kind in ('anchor', 'target')").select(F.col("kind").alias("slot"), F.col("k2").alias("r"), F.col("k3").alias("entity"), F.col("n").alias("exact"))
    pair = index.where("kind = 'pair'").select(F.col("k1").alias("entity"), F.col("k2").alias("r"), F.col("n").alias("pair"))
    whole = index.where("kind = 'entity'").select(F.col("k1").alias("entity"), F.col("n").alias("entity_support"))
    return slots.join(exact, ["slot", "r", "entity"], "left").join(pair, ["entity", "r"], "left").join(whole, "entity", "left").select("fact", "slot", "entity", "exact", "pair", "entity_support")


def bridges(facts: DataFrame, max_degree: int, per_fact: int = PATHS_PER_FACT) -> DataFrame:
    """Transitions between facts that share an entity or a passage: left, right, kind, entity_overlap, source_overlap.

    Entities and passages of more than ``max_degree`` facts are hubs. Kinds, the first that fits: relation_continuation (a
    shared entity and one relation), same_source_chain (a shared passage), shared_entity_bridge. Of each fact the
    ``per_fact`` strongest stay.
    """
    return Bridges(facts, max_degree, per_fact).paths()


class Bridges:
    """``bridges`` and what is built on them. A passage whose facts share entities below a hub with no other passage is a unit
    of its own: its bridges and trails never leave it, so one shuffle of the facts makes them. The facts of all other passages,
    of hubs too, go by joins on their keys. Entities and passages go by 64-bit hashes.

    facts: fact (the id of s, r, o), passage, s, r, o. ``wanted`` (fact), a small table: only units with such a fact are made.
    ``shown``: how ids come out.
    """

    def __init__(self, facts: DataFrame, max_degree: int, per_fact: int = PATHS_PER_FACT, wanted: DataFrame | None = None, shown: Callable[[Column], Column] = lambda c: c):
        self.max_degree, self.per_fact, self.shown = max_degree, per_fact, shown
        key = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
        rows = facts.select("fact", F.coalesce(key("passage"), F.xxhash64("fact")).alias("home"), F.col("passage").isNotNull().alias("placed"), key("r").alias("r"), key("s").alias("s"), key("o").alias("o"))
        f = F.xxhash64("fact")
        # distinct facts are at least the bits that they set
        bits = [F.bit_or(F.when(f.bitwiseAND(64) == k * 64, F.call_function("shiftleft", F.lit(1).cast("long"), f.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long"))) for k in (0, 1)]
        keys = rows.select(F.explode(F.array("s", "o")).alias("e"), "home", "fact").where("e is not null")
        keys = keys.groupBy("e").agg(F.min("home").alias("a"), F.max("home").alias("b"), F.min(f).alias("f"), F.max(f).alias("g"), (F.bit_count(bits[0]) + F.bit_count(bits[1])).alias("bits"))
        # entities of several passages; those that are no hub for certain, and have several facts, are live
        across = small_or_shuffled(kept(keys.where("a <> b").select("e", ((F.col("f") != F.col("g")) & (F.col("bits") <= max_degree)).alias("live"))))
        for c in ("s", "o"):
            rows = rows.join(across.select(F.col("e").alias(c), F.col("live").alias(f"{c}_live")), c, "left")
        # an entity of one passage says that the fact has no other one
        own = lambda c: F.col(c).isNotNull() & F.col(f"{c}_live").isNull()
        live = F.coalesce(F.col("s_live"), F.lit(False)) | F.coalesce(F.col("o_live"), F.lit(False))
        left = lambda c: F.when(F.coalesce(F.col(f"{c}_live"), F.lit(True)), F.col(c)).alias(c)
        self.rows = rows.select("fact", "home", "placed", "r", left("s"), left("o"), live.alias("live"), (live | ~(own("s") | own("o")) | ~F.col("placed") | F.col("fact").isNull()).alias("open"))
        homes = self.rows.groupBy("home").agg(F.count("*").alias("n"), F.min(f).alias("f"), F.max(f).alias("g"), F.max("open").alias("open"), F.max("live").alias("live"))
        one_id = _one_id(facts)
        homes = homes.where((F.col("open") | (F.col("n") > max_degree)) & ((F.col("f") != F.col("g")) | F.col("live"))) if one_id else homes
        homes = kept(homes.select("home"))
        self.none_open = homes.isEmpty()
        self.units = self.open = self.rows
        if not self.none_open:
            homes = small_or_shuffled(homes)
            self.units, self.open = self.rows.join(homes, "home", "left_anti"), self.rows.join(homes, "home", "left_semi")
        if wanted is not None:
            self.units = self.units.join(small_or_shuffled(kept(self.rows.join(F.broadcast(wanted), "fact", "left_semi").select("home").distinct())), "home", "left_semi")

    def _made(self, made, schema: str) -> DataFrame:
        rows = self.units.select("home", "fact", "r", "s", "o").repartition("home").sortWithinPartitions("home", "fact")
        rows = rows.select("home", self.shown(F.col("fact")).alias("fact"), "r", "s", "o")
        kind = dict(rows.dtypes)["fact"]
        return rows.mapInArrow(units.maker(self.per_fact, made, [x.split()[0] for x in schema.split(", ")]), schema.replace(" id", f" {kind}"))

    def _with_open(self, made: DataFrame, of_open: Callable[[], DataFrame], *ids: str) -> DataFrame:
        return made if self.none_open else made.unionByName(of_open().withColumns({c: self.shown(F.col(c)) for c in ids}))

    def _open_paths(self) -> DataFrame:
        ends = self.open.select(F.lit(0).alias("by"), F.explode(F.array("s", "o")).alias("key"), "fact", "r")
        return _bridges_by_keys(ends.unionByName(self.open.where("placed").select(F.lit(1).alias("by"), F.col("home").alias("key"), "fact", "r")), self.max_degree, self.per_fact)

    def paths(self) -> DataFrame:
        made = self._made(units.pairs, "left id, right id, kind string, entity_overlap long, source_overlap long")
        return self._with_open(made, self._open_paths, "left", "right")

    def trails(self, neighbours: int = TRAIL_NEIGHBOURS, per_start: int = TRAILS_PER_FACT) -> DataFrame:
        made = self._made(units.trails(neighbours, per_start), "start id, middle id, end id, place long")
        return self._with_open(made, lambda: trails(self._open_paths(), neighbours, per_start), "start", "middle", "end")

    def trail_membership(self, neighbours: int = TRAIL_NEIGHBOURS, per_start: int = TRAILS_PER_FACT) -> DataFrame:
        made = self._made(units.membership(neighbours, per_start), "fact id, trails long, facts long, passages long")
        held = self.rows.select("fact", F.when(F.col("placed"), F.col("home")).alias("passage"))
        return self._with_open(made, lambda: trail_membership(trails(self._open_paths(), neighbours, per_start), held), "fact")

    def trail_endpoints(self, neighbours: int = TRAIL_NEIGHBOURS, per_start: int = TRAILS_PER_FACT) -> DataFrame:
        made = self._made(units.endpoints(neighbours, per_start), "fact id, other id, trails long")
        return self._with_open(made, lambda: trail_endpoints(trails(self._open_paths(), neighbours, per_start)), "fact", "other")


def _one_id(facts: DataFrame) -> bool:
    """Whether each id is that of one fact; only atoms with a bar or null ones can make one id of two."""
    atoms = ["s", "r", "o"]
    odd = facts.where(" or ".join(f"{c} is null or contains({c}, '|')" for c in atoms)).select("fact").distinct()
    if odd.isEmpty():
        return True
    return facts.join(odd, "fact", "left_semi").select("fact", *atoms).distinct().groupBy("fact").count().where("count > 1").isEmpty()


def _bridges_by_keys(rows: DataFrame, max_degree: int, per_fact: int) -> DataFrame:
    """``bridges`` of facts by their keys: by (0 entity, 1 passage), key, fact, r."""
    rows = rows.where("key is not null")
    # one shuffle for what is distinct, the degrees and the lists
    rows = rows.repartition("by", "key").dropDuplicates(["by", "key", "fact"])
    low = rows.withColumn("d", F.count("*").over(Window.partitionBy("by", "key"))).where(f"d between 2 and {max_degree}")
    lists = low.groupBy("by", "key").agg(F.sort_array(F.collect_list(F.struct("fact", "r"))).alias("facts"))
    # keys of the same facts are one group, so a fact of one group has partners of one strength, in the order of their ids
    groups = lists.groupBy("facts").agg(F.sum(1 - F.col("by")).alias("entity_overlap"), F.sum("by").alias("source_overlap")).withColumns({"g": F.xxhash64("facts"), "h": F.hash("facts")})
    members = groups.select("g", "h", F.explode("facts.fact").alias("fact"))
    several = members.join(members.groupBy("fact").agg(F.count("*").alias("n")).where("n > 1").select("fact"), "fact").groupBy("g", "h").agg(F.collect_list("fact").alias("several"))
    groups = groups.join(several, ["g", "h"], "left").withColumn("several", F.coalesce("several", F.array().cast(several.schema["several"].dataType)))
    more = lambda x: F.array_contains("several", x["fact"])
    # the first per_fact others of each fact of one group: of a pair the later fact takes the earlier one if that is among the first, the earlier one the later if that is, too
    after = lambda x, i: F.transform(F.slice("facts", i + 2, F.size("facts")), lambda y, j: F.struct(x.alias("x"), y.alias("y"), (~more(y) | (~more(x) & (i + 1 + j <= per_fact))).alias("taken")))
    first = groups.select("entity_overlap", "source_overlap", "several", F.explode(F.flatten(F.transform(F.slice("facts", 1, per_fact), after))).alias("p")).where("p.taken")
    first = first.select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), "entity_overlap", "source_overlap", (more(F.col("p.x")) | more(F.col("p.y"))).alias("more"))
    # facts of several groups add up what they share
    held = groups.where(F.size("several") > 0).select("facts", "entity_overlap", "source_overlap", F.explode(F.filter("facts", more)).alias("owner"))
    held = held.select("owner", F.explode("facts").alias("other"), "entity_overlap", "source_overlap").where("owner.fact <> other.fact")
    summed = held.groupBy("owner", "other").agg(F.sum("entity_overlap").alias("entity_overlap"), F.sum("source_overlap").alias("source_overlap"))
    best = top_k(summed, ["owner"], [F.desc("entity_overlap"), F.desc("source_overlap"), "other"], per_fact, "at").select(F.least("owner", "other").alias("x"), F.greatest("owner", "other").alias("y"), "entity_overlap", "source_overlap")
    pairs = first.where("not more").drop("more").unionByName(first.where("more").drop("more").unionByName(best).distinct())
    kind = F.when((F.col("entity_overlap") > 0) & (F.col("x.r") == F.col("y.r")), "relation_continuation").when(F.col("source_overlap") > 0, "same_source_chain").otherwise("shared_entity_bridge")
    return pairs.select(F.col("x.fact").alias("left"), F.col("y.fact").alias("right"), kind.alias("kind"), "entity_overlap", "source_overlap")


def trails(paths: DataFrame, neighbours: int = TRAIL_NEIGHBOURS, per_start: int = TRAILS_PER_FACT) -> DataFrame:
    """Two-step trails over bridges: start, middle, end, hops, shared; simple, the ``per_start`` first of each start.

    Steps go to the ``neighbours`` first: a shared passage before none, more shared entities, then the neighbour's id.
    """
    both = paths.select(F.col("left").alias("a"), F.col("right").alias("b"), "entity_overlap", "source_overlap").unionByName(paths.select(F.col("right").alias("a"), F.col("left").alias("b"), "entity_overlap", "source_overlap"))
    steps = top_k(both, ["a"], [F.col("source_overlap") == 0, F.desc("entity_overlap"), "b"], neighbours, "at").select("a", "b", "at")
    two = steps.select(F.col("a").alias("start"), F.col("b").alias("middle"), F.col("at").alias("at1")).join(steps.select(F.col("a").alias("middle"), F.col("b").alias("end"), F.col("at").alias("at2")), "middle").where("start <> end")
    return top_k(two, ["start"], ["at1", "at2"], per_start, "place").select("start", "middle", "end", "place")


def trail_membership(found: DataFrame, facts: DataFrame) -> DataFrame:
    """For every fact the trails, other facts and passages that its trails touch: fact, trails, facts, passages."""
    rows = found.withColumn("trail", F.concat_ws(">", "start", "middle", "end")).withColumn("all", F.array("start", "middle", "end"))
    owned = rows.select("trail", F.explode("all").alias("fact"), "all").select("trail", "fact", F.explode("all").alias("member"))
    held = owned.join(facts.select(F.col("fact").alias("member"), "passage").distinct(), "member")
    return held.groupBy("fact").agg(F.countDistinct("trail").alias("trails"), F.countDistinct("member").alias("facts"), F.countDistinct("passage").alias("passages"))


def trail_endpoints(found: DataFrame) -> DataFrame:
    """Trails as pairs of endpoints: fact, other, trails."""
    ends = found.select(F.col("start").alias("fact"), F.col("end").alias("other")).unionByName(found.select(F.col("end").alias("fact"), F.col("start").alias("other")))
    return ends.groupBy("fact", "other").agg(F.count("*").alias("trails"))


def latest(state: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of each key the row with the greatest ``order``."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return state.withColumn("__rn", rn).where("__rn = 1").drop("__rn")
