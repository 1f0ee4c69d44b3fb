"""Queries of graph construction and diffusion over the star schema read as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.operators import diffusion as D
from lanternfold.operators import graph as G
from lanternfold.operators import vector as V
from lanternfold.operators.ranking import top_k
from lanternfold.operators.shared import kept, small_or_shuffled
from lanternfold.plans import worlds as W
from lanternfold.plans.vector_plans import sides
from lanternfold.registry import Registry, Tables

R = Registry()
TR = W.TRIPLES
EID = "'entity-' || md5({0})"
PLACES = "pl AS (SELECT * FROM tr)"


def places(t: Tables) -> DataFrame:
    """All triples of the star schema."""
    return W.triples(t)


#: What the ids of the passages of ``places`` look like.
PASSAGE_IDS = "^[csnp][0-9]+$"


FE = f"fe AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT {EID.format('s')} AS src, {EID.format('o')} AS dst FROM tr UNION ALL SELECT {EID.format('o')}, {EID.format('s')} FROM tr) GROUP BY ALL)"


@R.add("f22_valid_triples", f"WITH {TR}, x AS (SELECT passage, s, r, CASE WHEN o LIKE '%1' THEN ' ' WHEN o LIKE '%2' THEN s ELSE o END AS o FROM tr) SELECT DISTINCT passage, s, r, o FROM x WHERE trim(s) <> '' AND trim(r) <> '' AND trim(o) <> '' AND s <> o")
def _(t: Tables) -> DataFrame:
    spoilt = W.triples(t).withColumn("o", F.when(F.col("o").endswith("1"), " ").when(F.col("o").endswith("2"), F.col("s")).otherwise(F.col("o")))
    return G.valid_triples(spoilt, drop_self_loops=True).select("passage", "s", "r", "o")


@R.add("g1_fact_edges", f"WITH {TR}, {FE} SELECT * FROM fe")
def _(t: Tables) -> DataFrame:
    return G.fact_edges(W.triples(t))


@R.add("a1_edge_weights", f"WITH {TR}, {FE} SELECT src, CAST(count(*) AS BIGINT) AS degree, sum(weight) AS strength FROM fe GROUP BY src")
def _(t: Tables) -> DataFrame:
    return G.fact_edges(W.triples(t)).groupBy("src").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


MENT = "me AS (SELECT DISTINCT passage, unnest([s, o]) AS entity FROM tr)"


@R.add("a2_entity_passages", f"WITH {TR}, {MENT} SELECT entity, count(*) AS passages, min(passage) AS first_passage FROM me GROUP BY entity")
def _(t: Tables) -> DataFrame:
    return G.mentions(W.triples(t)).groupBy("entity").agg(F.count("*").alias("passages"), F.min("passage").alias("first_passage"))


@R.add("a3_unique_entities_and_facts", f"WITH {TR} SELECT 'entity' AS kind, x AS text FROM (SELECT s AS x FROM tr UNION SELECT o FROM tr) UNION ALL SELECT DISTINCT 'fact', s || '|' || r || '|' || o FROM tr")
def _(t: Tables) -> DataFrame:
    tr = W.triples(t)
    entities = G.mentions(tr).select("entity").distinct().select(F.lit("entity").alias("kind"), F.col("entity").alias("text"))
    return entities.unionByName(tr.select(F.lit("fact").alias("kind"), F.concat_ws("|", "s", "r", "o").alias("text")).distinct())


@R.add("g2_passage_edges", f"WITH {TR}, {MENT} SELECT passage AS src, {EID.format('entity')} AS dst, 1.0::DOUBLE AS weight FROM me")
def _(t: Tables) -> DataFrame:
    return G.passage_edges(W.triples(t))


SYN_SQL = f"sc AS (SELECT q.vec_id AS q, k.vec_id AS id, {W.DOT.format('q', 'k')} AS score FROM embeddings q CROSS JOIN embeddings k WHERE q.{W.VEC_Q}), sr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS k FROM sc), sn AS (SELECT * FROM sr WHERE k <= 200), sy AS (SELECT q AS src, id AS dst, score AS weight, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS k FROM sn WHERE q <> id AND score >= 0.2)"


def synonyms(t: Tables) -> DataFrame:
    return G.synonymy_edges(V.dense_scores(*sides(t), k=200), least=0.2)


@R.add("g3_synonymy_edges", f"""
    WITH {SYN_SQL}, f AS (SELECT vec_id AS src, (vec_id + 1) % 500 AS dst, 7.0::DOUBLE AS weight FROM embeddings)
    SELECT coalesce(sy.src, f.src) AS src, coalesce(sy.dst, f.dst) AS dst, round(coalesce(sy.weight, f.weight), 5) AS weight FROM f FULL JOIN (SELECT * FROM sy WHERE k <= 101) sy ON sy.src = f.src AND sy.dst = f.dst
""")
def _(t: Tables) -> DataFrame:
    facts = t.embeddings.select(F.col("vec_id").alias("src"), ((F.col("vec_id") + 1) % 500).alias("dst"), F.lit(7.0).alias("weight"))
    return G.with_synonymy(facts, synonyms(t)).withColumn("weight", F.round("weight", 5))


@R.add("g4_materialised_edges", f"WITH {TR}, {FE}, k AS (SELECT * FROM fe WHERE src <> dst), b AS (SELECT src, dst, weight FROM k UNION ALL SELECT dst, src, weight FROM k) SELECT src, dst, sum(weight) AS weight FROM b GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    tr = W.triples(t)
    nodes = G.mentions(tr).select(G.entity_id(F.col("entity")).alias("id"))
    return G.materialised(G.fact_edges(tr), nodes)


@R.add("j3_edge_ends_exist", f"WITH {TR}, {FE}, n AS (SELECT DISTINCT {EID.format('o')} AS id FROM tr WHERE r = 'in nation' UNION SELECT DISTINCT {EID.format('o')} FROM tr WHERE r = 'in region') SELECT src, dst, weight FROM fe WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def _(t: Tables) -> DataFrame:
    tr = W.triples(t)
    nodes = tr.where("r in ('in nation', 'in region')").select(G.entity_id(F.col("o")).alias("id"))
    return G.induced(G.fact_edges(tr), nodes).select("src", "dst", "weight")


@R.add("a10_graph_info", f"""
    WITH {TR}, {FE}, {MENT}, {SYN_SQL} SELECT 'passages' AS counter, count(DISTINCT passage) AS n FROM tr UNION ALL SELECT 'entities', count(DISTINCT entity) FROM me UNION ALL SELECT 'facts', count(*) FROM (SELECT DISTINCT s, r, o FROM tr)
    UNION ALL SELECT 'shared_entities', count(*) FROM (SELECT entity FROM me GROUP BY entity HAVING count(*) > 1) UNION ALL SELECT 'fact_edges', count(*) FROM fe UNION ALL SELECT 'passage_edges', count(*) FROM me UNION ALL SELECT 'synonymy_edges', count(*) FROM sy WHERE k <= 101
""")
def _(t: Tables) -> DataFrame:
    return G.graph_info(W.triples(t), synonyms(t))


GONE = "tr WHERE passage NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0 UNION SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0)"


@R.add("g14_deletion_cascade", f"WITH {TR}, st AS (SELECT * FROM {GONE}) SELECT s, r, o FROM (SELECT DISTINCT s, r, o FROM tr) EXCEPT SELECT s, r, o FROM st")
def _(t: Tables) -> DataFrame:
    key = lambda df, prefix, k, bal: df.where(F.col(bal) < 0).select(F.concat(F.lit(prefix), F.col(k).cast("string")).alias("passage"))
    gone = key(t.supplier, "s", "s_suppkey", "s_acctbal").unionByName(key(t.customer, "c", "c_custkey", "c_acctbal"))
    return G.surviving_triples(W.triples(t), gone)[1]


HY = "hy AS (SELECT s, r, o, count(DISTINCT passage) AS support, 'prop-' || md5(s || '|' || r || '|' || o) AS h FROM tr GROUP BY ALL)"


@R.add("g5_hypergraph_nodes", f"""
    WITH {TR}, {MENT}, {HY} SELECT {EID.format('entity')} AS id, 'entity' AS node_type, count(*) AS support FROM me GROUP BY entity UNION ALL SELECT h, 'hyperedge', support FROM hy
    UNION ALL SELECT passage, 'passage', count(*) FROM (SELECT DISTINCT passage, s, r, o FROM tr) GROUP BY passage
""")
def _(t: Tables) -> DataFrame:
    return G.hypergraph_nodes(W.triples(t))


@R.add("g6_hypergraph_edges", f"""
    WITH {TR}, {MENT}, {HY}, en AS (SELECT h, support, unnest([s, o]) AS e FROM hy), eh AS (SELECT {EID.format('e')} AS a, h AS b, 'entity_hyperedge' AS t, 1 + 0.1::DOUBLE * count(*) AS w, any_value(support) AS sup FROM en GROUP BY h, e),
    hp AS (SELECT DISTINCT h, passage, 'hyperedge_passage', 1 + ln(1 + support), support FROM hy JOIN tr USING (s, r, o)), ep AS (SELECT {EID.format('entity')}, passage, 'entity_passage', 1.0::DOUBLE, 1 FROM me),
    u AS (SELECT * FROM eh UNION ALL SELECT * FROM hp UNION ALL SELECT * FROM ep), b AS (SELECT a AS src, b AS dst, t AS edge_type, w, sup FROM u UNION ALL SELECT b, a, t, w, sup FROM u)
    SELECT edge_type, md5(src) AS src, md5(dst) AS dst, round(max(w), 6) AS weight, max(sup) AS support FROM b GROUP BY edge_type, src, dst
""")
def _(t: Tables) -> DataFrame:
    _checkpoints(t)
    edges = G.hypergraph_edges(W.triples(t), lambda c: F.md5(c.cast("binary")))
    return edges.select("edge_type", "src", "dst", F.round("weight", 6).alias("weight"), "support")


@R.add("j9_hyperedge_pairs", f"""
    WITH {TR}, {PLACES}, hh AS (SELECT s, r, o, 'prop-' || md5(s || '|' || r || '|' || o) AS h FROM pl GROUP BY ALL), ro AS (SELECT h, s AS e, 's' AS role FROM hh UNION ALL SELECT h, o, 'o' FROM hh),
    lo AS (SELECT * FROM ro WHERE e IN (SELECT e FROM ro GROUP BY e HAVING count(DISTINCT h) <= 40)), sp AS (SELECT a.h, b.h AS h2, a.e, max(CASE WHEN a.role = b.role THEN 1 ELSE 0 END) AS same FROM lo a JOIN lo b ON a.e = b.e AND a.h < b.h GROUP BY ALL),
    sh AS (SELECT h, h2, count(*) AS anchors, arg_max(same, e) AS compat FROM sp GROUP BY ALL), pa AS (SELECT DISTINCT h, passage FROM pl JOIN hh USING (s, r, o)), pc AS (SELECT * FROM pa WHERE passage IN (SELECT passage FROM pa GROUP BY passage HAVING count(*) <= 40)),
    cx AS (SELECT DISTINCT a.h, b.h AS h2, 1 AS context FROM pc a JOIN pc b ON a.passage = b.passage AND a.h < b.h),
    w AS (SELECT coalesce(sh.h, cx.h) AS h, coalesce(sh.h2, cx.h2) AS h2, round(0.35::DOUBLE * coalesce(anchors, 0) + 0.2::DOUBLE * coalesce(compat, 0) + 0.2::DOUBLE * coalesce(context, 0), 9) AS weight FROM sh FULL JOIN cx ON sh.h = cx.h AND sh.h2 = cx.h2),
    b AS (SELECT h AS src, h2 AS dst, weight FROM w WHERE weight >= 0.4 UNION ALL SELECT h2, h, weight FROM w WHERE weight >= 0.4), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM b)
    SELECT src, dst, weight FROM k WHERE k <= 8
""")
def _(t: Tables) -> DataFrame:
    _checkpoints(t)
    return G.hyperedge_pairs(places(t), 40)


CUST = "ce AS (SELECT DISTINCT o_custkey AS src, o_orderkey + 1000000000 AS dst FROM orders)"


def sparse(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1000000000).alias("dst")).distinct()


@R.add("g12_connected_components", f"""
    WITH RECURSIVE {CUST}, b AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce), rc(id, r) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.src, rc.r FROM rc JOIN b ON b.dst = rc.id)
    SELECT id, min(r) AS component FROM rc GROUP BY id
""")
def _(t: Tables) -> DataFrame:
    _checkpoints(t)
    return G.connected_components(sparse(t))


def _checkpoints(t: Tables) -> None:
    """Checkpoints go to the folder that the session names; a session without one gets a folder under the warehouse, which is shared too."""
    if not t.spark.conf.get("spark.checkpoint.dir", None):
        folder = f"{t.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        t.spark.conf.set("spark.checkpoint.dir", folder)
        t.spark.sparkContext.setCheckpointDir(folder)


@R.add("g13_induced_subgraph", f"WITH {CUST} SELECT src, dst FROM ce WHERE src IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND dst IN (SELECT o_orderkey + 1000000000 FROM orders WHERE o_orderstatus = 'F')")
def _(t: Tables) -> DataFrame:
    edges = sparse(t)
    ids = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")).union(t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey") + 1000000000))
    return G.induced(edges, ids).select("src", "dst")


@R.add("w6_top_neighbours", f"WITH {TR}, {FE}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS rank FROM fe) SELECT src, dst, weight, rank FROM r WHERE rank <= 4")
def _(t: Tables) -> DataFrame:
    return G.top_neighbours(G.fact_edges(W.triples(t)), 4)


#: facts that a question's selection scored: each region asks; supplier facts are scored by the balance
SEEDS = f"""sf AS (SELECT n_regionkey AS q, lower(s_name) AS s, lower(n_name) AS o, s_acctbal / 10000.0 AS score, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    {MENT}, cc AS (SELECT entity, count(*) AS n FROM me GROUP BY entity), ps AS (SELECT q, entity, avg(score / coalesce(n, 1)) AS weight FROM (SELECT q, score, unnest([s, o]) AS entity FROM sf WHERE k <= 5) LEFT JOIN cc USING (entity) GROUP BY ALL),
    pr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(weight, 9) DESC, entity) AS k FROM ps)"""


def seeds(t: Tables) -> DataFrame:
    facts = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("q"), F.lower("s_name").alias("s"), F.lower("n_name").alias("o"), (F.col("s_acctbal") / 10000.0).alias("score"), "s_suppkey")
    best = top_k(facts, ["q"], [F.desc("score"), "s_suppkey"], 5)
    counts = G.mentions(W.triples(t)).groupBy("entity").agg(F.count("*").alias("n"))
    return D.phrase_seeds(best, counts, 5)


@R.add("p1_fact_entity_seeds", f"WITH {TR}, {SEEDS} SELECT q, entity AS node, round(weight, 6) AS weight FROM pr WHERE k <= 5")
def _(t: Tables) -> DataFrame:
    return seeds(t).withColumn("weight", F.round("weight", 6))


PASS_SEED = "pp AS (SELECT n_regionkey AS q, 'n' || n_nationkey AS node, 1.0 / (1 + n_nationkey) AS score FROM nation)"
RESET = f"{SEEDS}, {PASS_SEED}, al AS (SELECT q, entity AS node, weight FROM pr WHERE k <= 5 AND weight > 0 UNION ALL SELECT q, node, score * 0.05::DOUBLE FROM pp), rs AS (SELECT q, node, max(weight) AS w FROM al GROUP BY ALL), re AS (SELECT q, node, w / sum(w) OVER (PARTITION BY q) AS v FROM rs)"


def reset(t: Tables) -> DataFrame:
    passages = t.nation.select(F.col("n_regionkey").alias("q"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), (1.0 / (1 + F.col("n_nationkey"))).alias("score"))
    return D.merged_seeds(seeds(t), passages)


@R.add("p2_merged_reset", f"WITH {TR}, {RESET} SELECT q, node, round(v, 6) AS weight FROM re")
def _(t: Tables) -> DataFrame:
    return reset(t).withColumn("weight", F.round("weight", 6))


GRAPH = f"{PLACES}, pe AS (SELECT DISTINCT passage AS a, unnest([s, o]) AS b, 1.0::DOUBLE AS w FROM pl UNION ALL SELECT s, o, count(*)::DOUBLE FROM pl GROUP BY s, o), ge AS (SELECT src, dst, sum(w) AS w FROM (SELECT a AS src, b AS dst, w FROM pe UNION ALL SELECT b, a, w FROM pe) WHERE src <> dst GROUP BY ALL), st AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM ge)"


def place_graph(t: Tables) -> DataFrame:
    tr = places(t)
    named = G.mentions(tr).select(F.col("passage").alias("src"), F.col("entity").alias("dst"), F.lit(1.0).alias("weight"))
    facts = tr.groupBy(F.col("s").alias("src"), F.col("o").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return G.materialised(named.unionByName(facts))


def numbered_graph(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``place_graph`` and ``reset`` with numbers for nodes, odd ones for passages, and the names: id, node."""
    start = kept(reset(t))
    tr, names = G.numbered(places(t).select("passage", "s", "o"), ["passage", "s", "o"], start, lambda c: c.rlike(PASSAGE_IDS))
    named = G.mentions(tr).select(F.col("passage").alias("src"), F.col("entity").alias("dst"), F.lit(1.0).alias("weight"))
    facts = tr.groupBy(F.col("s").alias("src"), F.col("o").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return G.materialised(named.unionByName(facts)), kept(start.join(names, "node").select("q", F.col("id").alias("node"), "weight")), names


def _rounds_sql(n: int, d: float, share: str = "st", key: str = "") -> str:
    steps = ["s0 AS MATERIALIZED (SELECT q, node, v AS p FROM re)"]
    for k in range(n):
        steps.append(f"m{k} AS (SELECT s.q, t.dst AS node, sum(s.p * t.share) AS m FROM s{k} s JOIN {share} t ON t.src = s.node{key} GROUP BY ALL), x{k} AS (SELECT q, sum(p) AS lost FROM s{k} s WHERE NOT EXISTS (SELECT 1 FROM {share} t WHERE t.src = s.node{key}) GROUP BY q), "
                     f"b{k} AS (SELECT re.q, re.node, v * ({1 - d}::DOUBLE + {d}::DOUBLE * coalesce(lost, 0)) AS r FROM re LEFT JOIN x{k} x ON x.q = re.q), s{k + 1} AS MATERIALIZED (SELECT coalesce(m.q, b.q) AS q, coalesce(m.node, b.node) AS node, coalesce(r, 0) + {d}::DOUBLE * coalesce(m, 0) AS p FROM m{k} m FULL JOIN b{k} b ON b.q = m.q AND b.node = m.node)")  # fmt: skip
    return ", ".join(steps)


@R.add("p3_personalised_pagerank", f"WITH {TR}, {RESET}, {GRAPH}, {_rounds_sql(10, 0.5)}, f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(p, 9) DESC, node) AS rank FROM s10 WHERE regexp_matches(node, '^[csnp][0-9]+$')) SELECT q, node, round(p, 6) AS p, rank FROM f WHERE rank <= 50")
def _(t: Tables) -> DataFrame:
    _checkpoints(t)
    edges, start, names = numbered_graph(t)
    p = D.pagerank(edges, start, 0.5, 10).withColumnRenamed("node", "id").where("id % 2 <> 0").join(names, "id")
    return top_k(p, ["q"], [F.desc(F.round("p", 9)), "node"], 50).select("q", "node", F.round("p", 6).alias("p"), "rank")


TYPED = "CASE WHEN regexp_matches({0}, '^[csnp][0-9]+$') THEN 'passage' ELSE 'entity' END"
COND = f"""ty AS (SELECT src, dst, w, {TYPED.format('src')} || '_' || {TYPED.format('dst')} AS et, {TYPED.format('dst')} AS dt FROM ge), ga(et, g) AS (VALUES ('entity_entity', 0.1::DOUBLE), ('entity_passage', 0.2), ('passage_entity', 0.3)),
    qs AS (SELECT DISTINCT q FROM re), ca AS (SELECT qs.q, src, dst, greatest(w * (g + 0.01::DOUBLE * qs.q) * (CASE WHEN dt = 'passage' THEN 0.48::DOUBLE ELSE 0.28 END) * greatest(coalesce(v, 0), 1e-4), 1e-4) AS w FROM ty JOIN ga USING (et) CROSS JOIN qs LEFT JOIN re ON re.q = qs.q AND re.node = dst),
    cs AS (SELECT q, src, dst, w / sum(w) OVER (PARTITION BY q, src) AS share FROM ca)"""


@R.add("p4_conditioned_diffusion", f"WITH {TR}, {RESET}, {GRAPH}, {COND}, {_rounds_sql(6, 0.45, 'cs', ' AND t.q = s.q')}, f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(p, 9) DESC, node) AS rank FROM s6) SELECT q, node, round(p, 6) AS p, rank FROM f WHERE rank <= 30")
def _(t: Tables) -> DataFrame:
    _checkpoints(t)
    edges, start, names = numbered_graph(t)
    kind = lambda c: F.when(F.col(c) % 2 != 0, "passage").otherwise("entity")
    q = start.select("q").distinct()
    gates = F.broadcast(t.spark.createDataFrame([("entity_entity", 0.1), ("entity_passage", 0.2), ("passage_entity", 0.3)], "edge_type string, g double").crossJoin(q).select("q", "edge_type", (F.col("g") + 0.01 * F.col("q")).alias("gate")))
    priors = F.broadcast(t.spark.createDataFrame([("passage", 0.48), ("entity", 0.28)], "dst_type string, prior double").crossJoin(q))
    matches = small_or_shuffled(start.select("q", "node", F.col("weight").alias("match")))
    weigh = lambda rows: D.conditioned_edges(rows.withColumns({"edge_type": F.concat(kind("src"), F.lit("_"), kind("dst")), "dst_type": kind("dst")}), gates, priors, matches)
    p = D.pagerank(edges, start, 0.45, 6, weigh).withColumnRenamed("node", "id").join(names, "id")
    return top_k(p, ["q"], [F.desc(F.round("p", 9)), "node"], 30).select("q", "node", F.round("p", 6).alias("p"), "rank")


@R.add("p5_top_reset_mix", f"""
    WITH {W.CH}, ns AS (SELECT q, doc::VARCHAR AS node, CASE WHEN doc % 3 = 0 THEN 'entity' WHEN doc % 3 = 1 THEN 'hyperedge' ELSE 'passage' END AS nt, sum(score) AS score FROM ch GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY q, nt ORDER BY round(score, 9) DESC, node) AS k FROM ns WHERE score > 0), s AS (SELECT q, node, score / sum(score) OVER (PARTITION BY q, nt) * CASE nt WHEN 'entity' THEN 0.45::DOUBLE WHEN 'hyperedge' THEN 0.2 ELSE 0.35 END AS w FROM k WHERE k <= CASE nt WHEN 'entity' THEN 8 ELSE 12 END)
    SELECT q, node, round(w / sum(w) OVER (PARTITION BY q), 6) AS weight FROM s
""")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("doc") % 3 == 0, "entity").when(F.col("doc") % 3 == 1, "hyperedge").otherwise("passage")
    scores = W.channels(t).groupBy("q", F.col("doc").cast("string").alias("node"), kind.alias("node_type")).agg(F.sum("score").alias("score"))
    mixed = D.top_reset(scores, {"entity": 8, "hyperedge": 12, "passage": 12}, {"entity": 0.45, "hyperedge": 0.2, "passage": 0.35})
    return mixed.withColumn("weight", F.round("weight", 6))


@R.add("p6_fact_hyperedge_seeds", f"WITH {TR}, {SEEDS}, {HY} SELECT q, h AS node, round(max(score), 6) AS weight FROM sf JOIN hy ON hy.s = sf.s AND hy.o = sf.o WHERE k <= 5 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    facts = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("q"), F.lower("s_name").alias("s"), F.lower("n_name").alias("o"), (F.col("s_acctbal") / 10000.0).alias("score"), "s_suppkey")
    best = top_k(facts, ["q"], [F.desc("score"), "s_suppkey"], 5)
    return best.join(G.hyperedges(W.triples(t)), ["s", "o"]).groupBy("q", F.col("h").alias("node")).agg(F.round(F.max("score"), 6).alias("weight"))


@R.add("p9_local_push")
def _(t: Tables) -> DataFrame:
    _checkpoints(t)
    start = reset(t).select(F.col("q").cast("long").alias("q"), "node", "weight")
    return D.local_push(place_graph(t), start, epsilon=1e-4).withColumn("p", F.round("p", 6))


@R.add("p11_sweep_cut", f"""
    WITH {TR}, {GRAPH}, pq AS (SELECT r.r_regionkey AS q, x.node, 1.0 / (2 + (x.h + r.r_regionkey) % 97) AS p FROM (SELECT DISTINCT src AS node, length(src) * 7 + ascii(right(src, 1)) AS h FROM ge) x CROSS JOIN region r),
    dg AS (SELECT src AS node, count(*) AS deg FROM ge GROUP BY src), tt AS (SELECT count(*) AS total FROM ge), o AS (SELECT q, node, row_number() OVER w AS at_, sum(deg) OVER w AS vol FROM pq JOIN dg USING (node) WINDOW w AS (PARTITION BY q ORDER BY round(p / deg, 12) DESC, node)),
    i AS (SELECT a.q, a.at_, count(*) AS inner_ FROM o a JOIN ge ON ge.src = a.node JOIN o b ON b.q = a.q AND b.node = ge.dst AND b.at_ < a.at_ GROUP BY ALL), r AS (SELECT o.q, o.at_, o.vol, sum(coalesce(inner_, 0)) OVER (PARTITION BY o.q ORDER BY o.at_) AS kept FROM o LEFT JOIN i ON i.q = o.q AND i.at_ = o.at_),
    c AS (SELECT q, at_, (vol - 2 * kept) / least(vol, total - vol) AS conductance FROM r CROSS JOIN tt WHERE vol < total), f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(conductance, 9), at_) AS k FROM c)
    SELECT q, at_ AS size, round(conductance, 6) AS conductance FROM f WHERE k = 1
""")
def _(t: Tables) -> DataFrame:
    edges = place_graph(t)
    nodes = edges.select(F.col("src").alias("node")).distinct().withColumn("h", F.length("node") * 7 + F.ascii(F.substring("node", -1, 1)))
    p = nodes.crossJoin(F.broadcast(t.region)).select(F.col("r_regionkey").alias("q"), "node", (1.0 / (2 + (F.col("h") + F.col("r_regionkey")) % 97)).alias("p"))
    return D.sweep_cut(edges, p).withColumn("conductance", F.round("conductance", 6))


@R.add("p12_projected_mass", f"""
    WITH {TR}, {PLACES}, f AS (SELECT DISTINCT passage AS doc, s || '|' || o AS node FROM pl), z AS (SELECT doc, count(*) AS n FROM f GROUP BY doc), p AS (SELECT r_regionkey AS q, node, 1.0 / (1 + length(node) + r_regionkey) AS p FROM (SELECT DISTINCT node FROM f) CROSS JOIN region),
    m AS (SELECT q, f.doc, sum(p) AS m FROM p JOIN f USING (node) GROUP BY ALL) SELECT q, m.doc, round(m / sqrt(n), 6) AS mass FROM m JOIN z USING (doc)
""")
def _(t: Tables) -> DataFrame:
    facts = places(t).select(F.col("passage").alias("doc"), F.concat_ws("|", "s", "o").alias("node")).distinct()
    p = facts.select("node").distinct().crossJoin(F.broadcast(t.region)).select(F.col("r_regionkey").alias("q"), "node", (1.0 / (1 + F.length("node") + F.col("r_regionkey"))).alias("p"))
    return D.projected(p, facts).withColumn("mass", F.round("mass", 6))


@R.add("p14_graph_distances", f"""
    WITH {TR}, {GRAPH}, s AS (SELECT r_regionkey AS q, lower(r_name) AS node FROM region), d1 AS (SELECT DISTINCT q, dst AS node FROM s JOIN ge ON src = node), d2 AS (SELECT DISTINCT q, dst AS node FROM d1 JOIN ge ON src = node), d3 AS (SELECT DISTINCT q, dst AS node FROM d2 JOIN ge ON src = node),
    a AS (SELECT q, node, 0 AS d FROM s UNION ALL SELECT q, node, 1 FROM d1 UNION ALL SELECT q, node, 2 FROM d2 UNION ALL SELECT q, node, 3 FROM d3) SELECT q, node, min(d) AS d FROM a GROUP BY ALL
""")
def _(t: Tables) -> DataFrame:
    _checkpoints(t)
    start = t.region.select(F.col("r_regionkey").alias("q"), F.lower("r_name").alias("node"))
    return D.distances(place_graph(t), start, 3)


@R.add("j4_fact_to_phrase_nodes", f"WITH {TR}, {MENT}, cc AS (SELECT entity, count(*) AS n FROM me GROUP BY entity), x AS (SELECT passage, unnest([s, o]) AS entity FROM tr) SELECT {EID.format('entity')} AS node, count(*) AS facts, any_value(coalesce(n, 1)) AS passages FROM x LEFT JOIN cc USING (entity) GROUP BY entity")
def _(t: Tables) -> DataFrame:
    tr = W.triples(t)
    counts = G.mentions(tr).groupBy("entity").agg(F.count("*").alias("n"))
    ends = tr.select(F.explode(F.array("s", "o")).alias("entity")).groupBy("entity").agg(F.count("*").alias("facts"))
    return ends.join(counts, "entity", "left").select(G.entity_id(F.col("entity")).alias("node"), "facts", F.coalesce("n", F.lit(1).cast("long")).alias("passages"))


@R.add("j8_endpoint_document_pairs", f"WITH {TR}, {PLACES}, e AS (SELECT DISTINCT passage, unnest([s, o]) AS entity FROM pl), k AS (SELECT * FROM e WHERE entity IN (SELECT entity FROM e GROUP BY entity HAVING count(*) <= 70)) SELECT a.passage AS left_doc, b.passage AS right_doc, count(*) AS shared FROM k a JOIN k b ON a.entity = b.entity AND a.passage < b.passage GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    named = G.mentions(places(t))
    low = named.join(named.groupBy("entity").agg(F.count("*").alias("n")).where("n <= 70").select("entity"), "entity", "left_semi")
    other = low.select("entity", F.col("passage").alias("right_doc"))
    return low.join(other, "entity").where("passage < right_doc").groupBy(F.col("passage").alias("left_doc"), "right_doc").agg(F.count("*").alias("shared"))


@R.add("a4_edge_dedup", f"WITH {TR}, e AS (SELECT s AS src, o AS dst, r AS edge_type, length(passage)::DOUBLE AS weight, length(s)::BIGINT AS support FROM tr UNION ALL SELECT s, o, r, 1.5, 2 FROM tr) SELECT src, dst, edge_type, max(weight) AS weight, max(support) AS support FROM e GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    tr = W.triples(t)
    edges = tr.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("r").alias("edge_type"), F.length("passage").cast("double").alias("weight"), F.length("s").cast("long").alias("support"))
    more = tr.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("r").alias("edge_type"), F.lit(1.5).alias("weight"), F.lit(2).cast("long").alias("support"))
    return G.deduplicated(edges.unionByName(more))


@R.add("a18_edge_tier_counts", f"WITH {TR}, {FE}, r AS (SELECT CASE WHEN weight > 50 THEN 'strong' WHEN weight > 1 THEN 'weak' ELSE 'single' END AS tier FROM fe) SELECT tier, count(*) AS n FROM r GROUP BY tier")
def _(t: Tables) -> DataFrame:
    tier = F.when(F.col("weight") > 50, "strong").when(F.col("weight") > 1, "weak").otherwise("single")
    return G.fact_edges(W.triples(t)).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))
