"""Building and changing graphs: fact, passage and synonymy edges, typed hypergraphs, components, deletion.

Triples are long: passage, s, r, o. Edges are src, dst, weight; both directions are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.functions.text import hash_id
from lanternfold.operators.ranking import top_k
from lanternfold.operators.shared import kept, small_or_shuffled

EE_THRESHOLD, EE_TOP = 0.88, 16
HH_ANCHOR, HH_ROLE, HH_SUMMARY, HH_CONTEXT, HH_LEAST, HH_TOP = 0.35, 0.20, 0.25, 0.20, 0.40, 8
SYNONYM_LEAST, SYNONYM_MOST = 0.8, 101
#: Groups whose pairs a worker makes at once: a bound of memory, not of results.
GROUPS_AT_ONCE = 200


def entity_id(text: Column) -> Column:
    return hash_id("entity", text)


def valid_triples(triples: DataFrame, drop_self_loops: bool = False) -> DataFrame:
    """Triples with three non-blank atoms, each once a passage; optionally without s = o."""
    full = triples.where((F.trim("s") != "") & (F.trim("r") != "") & (F.trim("o") != "")).dropDuplicates(["passage", "s", "r", "o"])
    return full.where("s <> o") if drop_self_loops else full


def fact_edges(triples: DataFrame) -> DataFrame:
    """1 in both directions for every occurrence of a triple."""
    s, o = entity_id(F.col("s")), entity_id(F.col("o"))
    one_way = triples.select(s.alias("src"), o.alias("dst"))
    return one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def mentions(triples: DataFrame) -> DataFrame:
    """Each passage with each entity it names: passage, entity."""
    return triples.select("passage", F.explode(F.array("s", "o")).alias("entity")).distinct()


def passage_edges(triples: DataFrame) -> DataFrame:
    """Passage to entity, weight 1."""
    return mentions(triples).select(F.col("passage").alias("src"), entity_id(F.col("entity")).alias("dst"), F.lit(1.0).alias("weight"))


def synonymy_edges(neighbours: DataFrame, least: float = SYNONYM_LEAST, most: int = SYNONYM_MOST) -> DataFrame:
    """Edges to near neighbours: neighbours q, id, score, rank; not to oneself, score ``least`` or more, ``most`` a node."""
    near = neighbours.where((F.col("q") != F.col("id")) & (F.col("score") >= least))
    return top_k(near, ["q"], [F.desc(F.round("score", 9)), "id"], most, "at").select(F.col("q").alias("src"), F.col("id").alias("dst"), F.col("score").alias("weight"))


def with_synonymy(facts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Fact edges, on which a synonymy edge of the same direction overwrites the weight."""
    new = synonyms.withColumnRenamed("weight", "new")
    return facts.join(new, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("new", "weight").alias("weight"))


def materialised(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The undirected weights: no self loops, both ends known, w(a, b) + w(b, a) in both directions."""
    rows = edges.where("src <> dst")
    if nodes is not None:
        ids = nodes.select("id").distinct()
        rows = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    one_way = rows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return one_way.select(F.explode(both).alias("x"), "weight").select("x.src", "x.dst", "weight")


def numbered(rows: DataFrame, columns: list[str], more: DataFrame, kind: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with 64-bit numbers for the names in ``columns``, odd ones for those of the ``kind``, and these names and ``more`` (node): id, node.

    Numbers are hashes; should two names have one, all are hashed anew.
    """
    nodes = kept(rows.select(F.explode(F.array(*columns)).alias("node")).union(more.select("node")).where("node is not null").distinct())
    seed = 0
    while True:
        number = lambda c: F.when(c.isNotNull(), F.xxhash64(F.lit(seed), c).bitwiseAND(F.lit(-2)).bitwiseOR(kind(c).cast("long")))  # noqa: B023, E731
        names = nodes.select(number(F.col("node")).alias("id"), "node")
        if names.groupBy("id").count().where("count > 1").isEmpty():
            return rows.withColumns({c: number(F.col(c)) for c in columns}), names
        seed += 1


def deduplicated(edges: DataFrame) -> DataFrame:
    """Typed edges, each (src, dst, type) once with the greatest weight and support."""
    return edges.groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight"), F.max("support").alias("support"))


def graph_info(triples: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Counts of passages, entities, facts, triples with an entity of two passages or more, fact edges, passage edges, synonymy edges."""
    named = mentions(triples)
    shared = named.groupBy("entity").agg(F.count("*").alias("n"))
    each = [
        ("passages", triples.select("passage").distinct()), ("entities", named.select("entity").distinct()), ("facts", triples.select("s", "r", "o").distinct()),
        ("shared_entities", shared.where("n > 1")), ("fact_edges", fact_edges(triples)), ("passage_edges", passage_edges(triples)), ("synonymy_edges", synonyms),
    ]
    out = None
    for name, rows in each:
        row = rows.agg(F.lit(name).alias("counter"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def surviving_triples(triples: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After deleting passages: the triples that stay, and the distinct facts that no passage states any more."""
    stay = triples.join(deleted.select("passage"), "passage", "left_anti")
    facts = ["s", "r", "o"]
    return stay, triples.select(*facts).distinct().join(stay.select(*facts).distinct(), facts, "left_anti")


def hyperedges(triples: DataFrame) -> DataFrame:
    """A hyperedge for each distinct fact: h, s, r, o, support (its passages)."""
    return triples.groupBy("s", "r", "o").agg(F.countDistinct("passage").alias("support")).withColumn("h", F.concat(F.lit("prop-"), F.md5(F.concat_ws("|", "s", "r", "o").cast("binary"))))


def hypergraph_nodes(triples: DataFrame) -> DataFrame:
    """Entities, hyperedges and passages with their support: id, node_type, support."""
    h = hyperedges(triples)
    entity = mentions(triples).groupBy("entity").agg(F.count("*").alias("support")).select(entity_id(F.col("entity")).alias("id"), F.lit("entity").alias("node_type"), "support")
    passage = triples.select("passage", "s", "r", "o").distinct().groupBy("passage").agg(F.count("*").alias("support")).select(F.col("passage").alias("id"), F.lit("passage").alias("node_type"), "support")
    return entity.unionByName(h.select(F.col("h").alias("id"), F.lit("hyperedge").alias("node_type"), "support")).unionByName(passage)


def hypergraph_edges(triples: DataFrame, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """Edges among entities, hyperedges and passages, both ways: src, dst, edge_type, weight, support. ``shown``: how ids come out.

    Where each hyperedge's id is that of one fact, its edges are made distinct by what makes them, in one shuffle of the facts
    and one of the mentions; both ends of an edge come from one row.
    """
    rows = kept(triples.select("passage", "s", "r", "o"))
    atoms = ["s", "r", "o"]
    odd = rows.where(" or ".join(f"{c} is null or contains({c}, '|')" for c in atoms) + " or passage is null or passage rlike '^(entity|prop)-'")
    if not odd.isEmpty():
        edges = _edges_made_distinct(rows)
        return edges.withColumns({c: shown(F.col(c)) for c in ("src", "dst")}) if shown else edges
    shown = shown or (lambda c: c)
    facts = rows.groupBy(*atoms).agg(F.collect_set("passage").alias("passages"))
    facts = facts.select("s", "o", shown(F.concat(F.lit("prop-"), F.md5(F.concat_ws("|", *atoms).cast("binary")))).alias("h"), F.size("passages").cast("long").alias("support"), "passages")
    entity = lambda c: shown(entity_id(F.col(c)))
    ways = lambda a, b, weight, support: [F.struct(x.alias("src"), y.alias("dst"), weight.cast("double").alias("weight"), support.alias("support")) for x, y in ((a, b), (b, a))]

    def both(df: DataFrame, edge_type: str, edges: Column) -> DataFrame:
        return df.select(F.explode(edges).alias("x")).select("x.src", "x.dst", F.lit(edge_type).alias("edge_type"), "x.weight", "x.support")

    one = F.col("s") == F.col("o")
    eh = facts.select("h", "support", F.when(one, 1.2).otherwise(1.1).alias("weight"), F.explode(F.when(one, F.array(entity("s"))).otherwise(F.array(entity("s"), entity("o")))).alias("a"))
    hp = facts.select("h", "support", F.explode("passages").alias("b")).withColumn("b", shown(F.col("b")))
    ep = mentions(rows).select(entity("entity").alias("a"), shown(F.col("passage")).alias("b"))
    facts = both(eh, "entity_hyperedge", F.array(*ways(F.col("a"), F.col("h"), F.col("weight"), F.col("support")))).unionByName(both(hp, "hyperedge_passage", F.array(*ways(F.col("h"), F.col("b"), 1 + F.log1p("support"), F.col("support")))))
    return facts.unionByName(both(ep, "entity_passage", F.array(*ways(F.col("a"), F.col("b"), F.lit(1.0), F.lit(1).cast("long")))))


def _edges_made_distinct(triples: DataFrame) -> DataFrame:
    """``hypergraph_edges`` where ids may be those of several facts, or of a passage and a node: all edges are made distinct."""
    h = hyperedges(triples)
    ends = h.select("h", "support", F.explode(F.array(F.struct(F.col("s").alias("e")), F.struct(F.col("o").alias("e")))).alias("x")).groupBy("h", "support", F.col("x.e").alias("e")).agg(F.count("*").alias("roles"))
    eh = ends.select(entity_id(F.col("e")).alias("src"), F.col("h").alias("dst"), F.lit("entity_hyperedge").alias("edge_type"), (1 + 0.1 * F.col("roles")).alias("weight"), "support")
    source = triples.select("passage", "s", "r", "o").distinct().join(h, ["s", "r", "o"])
    hp = source.select(F.col("h").alias("src"), F.col("passage").alias("dst"), F.lit("hyperedge_passage").alias("edge_type"), (1 + F.log1p("support")).alias("weight"), "support")
    ep = mentions(triples).select(entity_id(F.col("entity")).alias("src"), F.col("passage").alias("dst"), F.lit("entity_passage").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(1).cast("long").alias("support"))
    both = lambda df: df.unionByName(df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "weight", "support"))
    # edges are made distinct one way: the other way only a passage that is called like a node can repeat one, mentions are distinct as they are
    one_way = deduplicated(eh.unionByName(hp)).unionByName(ep)
    odd = (F.col("edge_type") != "entity_hyperedge") & F.coalesce(F.col("dst").rlike("^(entity|prop)-"), F.lit(True))
    return both(one_way.where(~odd)).unionByName(deduplicated(both(one_way.where(odd))))


def hyperedge_pairs(triples: DataFrame, max_degree: int) -> DataFrame:
    """Hyperedges joined by shared entities or passages, the HH_TOP strongest a node: src, dst, weight.

    weight = 0.35 * shared entities + 0.2 * (the greatest shared entity has one role in both) + 0.2 * (a shared passage),
    0.40 or more. Entities and passages of more than ``max_degree`` hyperedges are hubs and join nothing.

    A pair without a shared entity is under 0.40, so pairs are made inside the group of each entity and no table has all of
    them. Each fact brings its passages and its other end, so a group has the whole weight; only facts with two ends that are
    no hubs are in two groups, and their strongest are taken again from both. Entities go by 64-bit hashes.
    """
    atoms = ["s", "r", "o"]
    passage = Window.partitionBy("passage")
    rows = triples.select("passage", *atoms).repartition("passage").distinct().withColumn("facts", F.count(F.when(F.col("s").isNotNull() & F.col("r").isNotNull() & F.col("o").isNotNull(), 1)).over(passage))
    rows = kept(rows)
    # only atoms with a bar or null ones can make one id of two facts
    odd = rows.where(" or ".join(f"{c} is null or contains({c}, '|')" for c in atoms)).select(*atoms).distinct()
    if not odd.groupBy(F.concat_ws("|", *atoms)).count().where("count > 1").isEmpty():
        return _pairs_by_joins(rows, max_degree)
    key = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    ends = rows.select(F.explode(F.array(key("s"), key("o"))).alias("e"), F.xxhash64(*atoms).alias("fact")).where("e is not null").distinct()
    hubs = small_or_shuffled(kept(ends.groupBy("e").count().where(F.col("count") > max_degree).select("e")))
    whole = F.col("r").isNotNull() & F.col("facts").between(2, max_degree) & F.col("s").isNotNull() & F.col("o").isNotNull()
    placed = rows.select(F.unhex(F.md5(F.concat_ws("|", *atoms).cast("binary"))).alias("h"), key("s").alias("ks"), key("o").alias("ko"), (F.col("s") > F.col("o")).alias("s_last"), F.when(whole, F.col("passage")).alias("passage"))
    for c in ("ks", "ko"):
        hub = hubs.select(F.col("e").alias(c), F.lit(True).alias(f"{c}_hub"))
        placed = placed.join(hub, c, "left").withColumn(c, F.when(F.col(f"{c}_hub").isNull(), F.col(c))).drop(f"{c}_hub")
    end = lambda e, role, other, last: F.struct(F.col(e).alias("e"), F.when(F.col("ks") == F.col("ko"), 3).otherwise(role).cast("int").alias("role"), F.when(F.col(e) != F.col(other), F.col(other)).alias("other"), last.alias("last"))
    each = placed.select("h", "passage", F.explode(F.array(end("ks", 1, "ko", F.col("s_last")), end("ko", 2, "ks", ~F.col("s_last")))).alias("x")).select("x.*", "h", "passage").where("e is not null")
    groups = each.groupBy("e").agg(F.collect_set(F.struct("h", "role", "other", "last", "passage")).alias("members")).select("members")
    schema = "src binary, dst binary, weight double"
    alone = groups.mapInArrow(_strongest(False), schema)
    in_two = groups.where(F.exists("members", lambda x: x["other"].isNotNull())).mapInArrow(_strongest(True), schema)
    found = alone.unionByName(top_k(in_two, ["src"], [F.desc("weight"), "dst"], HH_TOP, "at").select("src", "dst", "weight"))
    name = lambda c: F.concat(F.lit("prop-"), F.lower(F.hex(c))).alias(c)
    return found.select(name("src"), name("dst"), "weight")


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every ordered pair (a, b) of places in one run of equal numbers of the sorted ``group``, by a, then b."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    length = np.diff(np.r_[first, len(group)])
    size, start = np.repeat(length, length), np.repeat(first, length)
    a = np.repeat(np.arange(len(group)), size)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _strongest(in_two: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The HH_TOP strongest partners inside each group, of the facts that are in two groups or of the others."""
    weights = np.array([[[round(HH_ANCHOR * n + HH_ROLE * role + HH_CONTEXT * context, 9) for context in (0, 1)] for role in (0, 1)] for n in (1, 2)])
    place = np.argsort(np.argsort(-weights, axis=None, kind="stable")).reshape(weights.shape)

    def strongest(lists: pa.Array) -> pa.RecordBatch:
        flat = lists.flatten()
        group = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        column = lambda c, null: pc.fill_null(flat.field(c), null).to_numpy(zero_copy_only=False)
        ids = np.frombuffer(b"".join(flat.field("h").to_pylist()), np.uint8).reshape(-1, 16)
        high, low = ids.view(">u8").T
        order = np.lexsort((low, high, group))
        new = np.r_[True, (np.diff(group[order]) != 0) | (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])]
        member = np.empty(len(order), np.int64)
        member[order] = np.cumsum(new) - 1
        one = order[new]  # a row of each member; members are in the order of their groups and ids
        ids, role, last, other, has_other = ids[one], column("role", 0)[one], column("last", False)[one], column("other", 0)[one], flat.field("other").is_valid().to_numpy(zero_copy_only=False)[one]
        a, b = _runs(group[one])
        wanted = (a != b) & (has_other[a] == in_two)
        a, b = a[wanted], b[wanted]
        held = flat.field("passage").is_valid().to_numpy(zero_copy_only=False)
        code = pc.dictionary_encode(flat.field("passage").filter(pa.array(held))).indices.to_numpy()
        met = np.unique(np.stack([group[held], code, member[held]], 1), axis=0) if held.any() else np.empty((0, 3), np.int64)
        x, y = _runs(met[:, 0] * (len(held) + 1) + met[:, 1])
        context = np.isin(a * len(one) + b, met[x, 2] * len(one) + met[y, 2])
        two = has_other[a] & has_other[b] & (other[a] == other[b])
        at = two.astype(int), (role[a] & role[b] != 0).astype(int), context.astype(int)
        # a pair of two shared entities counts in the group of the greater one
        good = (weights[at] >= HH_LEAST) & ~(two & ~last[a])
        a, b, weight, rank = a[good], b[good], weights[at][good], place[at][good]
        order = np.argsort(a * place.size + rank, kind="stable")
        a, b, weight = a[order], b[order], weight[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        top = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < HH_TOP
        text = lambda i: pa.Array.from_buffers(pa.binary(16), len(i), [None, pa.py_buffer(ids[i].tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([text(a[top]), text(b[top]), pa.array(weight[top])], ["src", "dst", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, GROUPS_AT_ONCE):
                yield strongest(batch.column(0).slice(i, GROUPS_AT_ONCE))

    return run


def _pairs_by_joins(triples: DataFrame, max_degree: int) -> DataFrame:
    """``hyperedge_pairs`` for facts of which several have one id, by joins that have every pair."""
    h = hyperedges(triples)
    roles = h.select("h", F.explode(F.array(F.struct(F.col("s").alias("e"), F.lit("s").alias("role")), F.struct(F.col("o").alias("e"), F.lit("o").alias("role")))).alias("x")).select("h", "x.e", "x.role")
    low = lambda df, key: df.join(df.groupBy(key).agg(F.countDistinct("h").alias("d")).where(F.col("d") <= max_degree).select(key), key, "left_semi")
    a = low(roles, "e")
    b = a.select(F.col("h").alias("h2"), "e", F.col("role").alias("role2"))
    shared = a.join(b, "e").where("h < h2").groupBy("h", "h2", "e").agg(F.max((F.col("role") == F.col("role2")).cast("int")).alias("same")).groupBy("h", "h2").agg(F.count("*").alias("anchors"), F.max_by("same", "e").alias("compat"))
    p = low(triples.select("passage", "s", "r", "o").distinct().join(h, ["s", "r", "o"]).select("h", "passage"), "passage")
    context = p.join(p.select(F.col("h").alias("h2"), "passage"), "passage").where("h < h2").select("h", "h2").distinct().withColumn("context", F.lit(1))
    pairs = shared.join(context, ["h", "h2"], "full_outer").fillna(0, ["anchors", "compat", "context"])
    weight = F.round(HH_ANCHOR * F.col("anchors") + HH_ROLE * F.col("compat") + HH_CONTEXT * F.col("context"), 9)
    one = pairs.withColumn("weight", weight).where(F.col("weight") >= HH_LEAST)
    both = one.select(F.col("h").alias("src"), F.col("h2").alias("dst"), "weight").unionByName(one.select(F.col("h2").alias("src"), F.col("h").alias("dst"), "weight"))
    return top_k(both, ["src"], [F.desc("weight"), "dst"], HH_TOP, "at").select("src", "dst", "weight")


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The edges both of whose ends are in ``kept`` (id)."""
    ids = kept.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (the least id): least labels of neighbours, then the label's label, until nothing changes."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct().checkpoint()
    labels = both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", F.least("label", "near").alias("new"), "label")
        after = least.join(labels.select(F.col("id").alias("new"), F.col("label").alias("far")), "new").select("id", F.least("new", "far").alias("next"), "label").checkpoint()
        labels = after.select("id", F.col("next").alias("label"))
        if after.where("next <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component"))


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The k strongest edges of each node: src, dst, weight, rank."""
    return top_k(edges, ["src"], [F.desc(F.round("weight", 9)), "dst"], k)
