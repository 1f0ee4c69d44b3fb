"""Queries of transition graphs, proposals and slots, the query router and the role-channel retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.functions import router
from lanternfold.operators import fusion, retrieval
from lanternfold.operators import lexical as L
from lanternfold.operators import transitions as X
from lanternfold.operators.ranking import top_k
from lanternfold.plans import worlds as W
from lanternfold.plans.graph_plans import PLACES, places
from lanternfold.plans.text_plans import NORM
from lanternfold.plans.vector_plans import TOK, sides
from lanternfold.registry import Registry, Tables

R = Registry()
TR = W.TRIPLES
CAP = 70

WORLD = f"""{TR}, {PLACES}, nx AS (SELECT passage AS doc, md5(s || '|' || r || '|' || o) AS fact, {NORM.format('s')} AS s, r, {NORM.format('o')} AS o FROM pl),
    ti AS (SELECT 'c' || c_custkey AS doc, {NORM.format('c_name')} AS title FROM customer UNION ALL SELECT 's' || s_suppkey, {NORM.format('s_name')} FROM supplier UNION ALL SELECT 'n' || n_nationkey, {NORM.format('n_name')} FROM nation),
    spn AS (SELECT 's' || s_suppkey AS doc, {NORM.format('c_name')} AS endpoint FROM supplier JOIN customer ON c_custkey = s_suppkey)"""


def world(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    from lanternfold.functions.text import normalised

    facts = places(t).select(F.col("passage").alias("doc"), F.md5(F.concat_ws("|", "s", "r", "o").cast("binary")).alias("fact"), normalised(F.col("s")).alias("s"), "r", normalised(F.col("o")).alias("o"))
    title = lambda df, prefix, key, name: df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("doc"), normalised(F.col(name)).alias("title"))
    titles = title(t.customer, "c", "c_custkey", "c_name").unionByName(title(t.supplier, "s", "s_suppkey", "s_name")).unionByName(title(t.nation, "n", "n_nationkey", "n_name"))
    spans = t.supplier.join(t.customer, F.col("c_custkey") == F.col("s_suppkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc"), normalised(F.col("c_name")).alias("endpoint"))
    return facts, titles, spans


GRAPH = f"""su AS (SELECT DISTINCT doc, s AS e FROM nx WHERE s <> ''), ob AS (SELECT DISTINCT doc, o AS e FROM nx WHERE o <> ''), ro AS (SELECT * FROM su UNION SELECT * FROM ob), lw AS (SELECT e FROM ro GROUP BY e HAVING count(*) <= {CAP}),
    ed AS (SELECT nx.doc AS a, t2.doc AS b, CASE WHEN s = t1.title THEN o ELSE s END AS e, 0 AS k FROM nx JOIN ti t1 ON t1.doc = nx.doc AND (nx.s = t1.title OR nx.o = t1.title) JOIN ti t2 ON t2.title = CASE WHEN s = t1.title THEN o ELSE s END WHERE s <> '' AND o <> ''
     UNION ALL SELECT x.doc, y.doc, x.e, 2 FROM su x JOIN su y ON x.e = y.e WHERE x.e IN (SELECT e FROM lw) UNION ALL SELECT x.doc, y.doc, x.e, 3 FROM ob x JOIN ob y ON x.e = y.e WHERE x.e IN (SELECT e FROM lw)
     UNION ALL SELECT x.doc, y.doc, x.e, 1 FROM ob x JOIN su y ON x.e = y.e WHERE x.e IN (SELECT e FROM lw) UNION ALL SELECT x.doc, y.doc, x.title, 4 FROM ti x JOIN ro y ON x.title = y.e WHERE x.title IN (SELECT e FROM lw)
     UNION ALL SELECT x.doc, y.doc, x.endpoint, 5 FROM spn x JOIN ro y ON x.endpoint = y.e WHERE x.endpoint IN (SELECT e FROM (SELECT doc, endpoint AS e FROM spn UNION SELECT doc, e FROM ro) GROUP BY e HAVING count(*) <= {CAP})),
    gr AS (SELECT least(a, b) AS l, greatest(a, b) AS r, min(k) AS best, count(DISTINCT e) AS endpoints, list_sort(list(DISTINCT k)) AS ks FROM ed WHERE a <> b GROUP BY ALL)"""
NAMES = "['sentence', 'role_bridge', 'same_subject', 'same_object', 'title_grounding', 'source_incidence']"


@R.add("g7_role_transition_graph", f'WITH {WORLD}, {GRAPH} SELECT l AS "left", r AS "right", array_to_string(list_transform(ks, lambda k: {NAMES}[k + 1]), \',\') AS kinds, best, endpoints FROM gr')
def _(t: Tables) -> DataFrame:
    return X.transition_graph(*world(t), CAP)


@R.add("g8_filtered_graph", f'WITH {WORLD}, {GRAPH}, f AS (SELECT *, list_filter(ks, lambda k: k IN (0, 2, 5)) AS kk FROM gr) SELECT l AS "left", r AS "right", array_to_string(list_transform(kk, lambda k: {NAMES}[k + 1]), \',\') AS kinds, kk[1] AS best, endpoints FROM f WHERE len(kk) > 0')
def _(t: Tables) -> DataFrame:
    return X.filtered_graph(X.transition_graph(*world(t), CAP), ("sentence", "same_subject", "source_incidence"))


@R.add("g9_fact_graph", f"""
    WITH {WORLD}, en AS (SELECT DISTINCT doc, fact, unnest([s, o]) AS e FROM nx), le AS (SELECT * FROM en WHERE e IN (SELECT e FROM en GROUP BY e HAVING count(DISTINCT doc) <= {CAP})),
    ac AS (SELECT DISTINCT x.fact AS a, y.fact AS b FROM le x JOIN le y ON x.e = y.e AND x.fact < y.fact AND x.doc <> y.doc), be AS (SELECT DISTINCT unnest([a, b]) AS fact FROM ac), ow AS (SELECT DISTINCT doc, fact FROM nx WHERE fact IN (SELECT fact FROM be))
    SELECT a, b FROM ac UNION SELECT x.fact, y.fact FROM ow x JOIN ow y ON x.doc = y.doc AND x.fact < y.fact
""")
def _(t: Tables) -> DataFrame:
    return X.fact_graph(world(t)[0], CAP)


@R.add("g10_light_units", f"""
    WITH p AS (SELECT 'n' || n_nationkey AS doc, n_name AS title, 'About ' || n_name || '. It lies in ' || r_name || '! Other words' AS text FROM nation JOIN region ON n_regionkey = r_regionkey), f AS (SELECT 'n' || n_nationkey AS doc, lower(n_name) AS s, 'in region' AS r, lower(r_name) AS o FROM nation JOIN region ON n_regionkey = r_regionkey),
    se AS (SELECT doc, unnest(string_split(regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(1), 'g'), chr(1))) AS text FROM p), h AS (SELECT se.doc, se.text, CASE WHEN contains(' ' || {NORM.format('se.text')} || ' ', ' ' || e || ' ') THEN e END AS e FROM se LEFT JOIN (SELECT doc, unnest([s, o]) AS e FROM f) x ON x.doc = se.doc)
    SELECT doc, 'source_span' AS unit_type, text, coalesce(string_agg(DISTINCT e, '|' ORDER BY e), '') AS endpoints FROM h GROUP BY doc, text UNION ALL SELECT f.doc, 'openie_fact', s || ' ' || r || ' ' || o, array_to_string(list_sort(list_distinct([s, o, lower(title)])), '|') FROM f JOIN p USING (doc)
""")
def _(t: Tables) -> DataFrame:
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("doc", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    passages = n.select("doc", F.col("n_name").alias("title"), F.concat(F.lit("About "), "n_name", F.lit(". It lies in "), "r_name", F.lit("! Other words")).alias("text"))
    return X.light_units(passages, n.select("doc", F.lower("n_name").alias("s"), F.lit("in region").alias("r"), F.lower("r_name").alias("o")))


SEED_DOCS = "sd AS (SELECT n_regionkey AS q, 'n' || n_nationkey AS doc, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation), sq AS (SELECT * FROM sd WHERE rank <= 2)"


def seed_docs(t: Tables) -> DataFrame:
    rows = t.nation.select(F.col("n_regionkey").alias("q"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("doc"), "n_nationkey")
    return top_k(rows, ["q"], ["n_nationkey"], 2).select("q", "doc", "rank")


@R.add("g11_query_local_closure", f"""
    WITH {WORLD}, {GRAPH}, {SEED_DOCS}, bo AS (SELECT l AS a, r AS b, best FROM gr UNION ALL SELECT r, l, best FROM gr), s0 AS (SELECT q, doc, 0 AS hop, 0 AS best, rank AS at_ FROM sq),
    s1 AS (SELECT q, b AS doc, 1 AS hop, min(bo.best * 1000000 + at_) AS x FROM s0 JOIN bo ON bo.a = s0.doc WHERE NOT EXISTS (SELECT 1 FROM s0 z WHERE z.q = s0.q AND z.doc = bo.b) GROUP BY q, b), s1b AS (SELECT q, doc, hop, x // 1000000 AS best, x % 1000000 AS at_ FROM s1), k1 AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1b),
    s2 AS (SELECT s.q, b AS doc, 2 AS hop, min(bo.best * 1000000 + at_) AS x FROM s1b s JOIN bo ON bo.a = s.doc WHERE NOT EXISTS (SELECT 1 FROM k1 z WHERE z.q = s.q AND z.doc = bo.b) GROUP BY s.q, b), al AS (SELECT * FROM k1 UNION ALL SELECT q, doc, hop, x // 1000000, x % 1000000 FROM s2),
    f AS (SELECT q, doc, hop, row_number() OVER (PARTITION BY q ORDER BY hop, best, at_, doc) AS pos FROM al) SELECT * FROM f WHERE pos <= 120
""")
def _(t: Tables) -> DataFrame:
    return X.closure(X.transition_graph(*world(t), CAP), seed_docs(t))


ENDS = "en AS (SELECT DISTINCT doc, unnest([s, o]) AS e FROM nx), ed2 AS (SELECT e, count(*) AS d FROM en GROUP BY e)"
LEX = "lx AS (SELECT q, doc, (length(doc) * 3 + q) % 7 + 0.5 AS score FROM (SELECT DISTINCT doc FROM nx) CROSS JOIN (SELECT r_regionkey AS q FROM region))"


def lex(t: Tables, facts: DataFrame) -> DataFrame:
    return facts.select("doc").distinct().crossJoin(F.broadcast(t.region.select(F.col("r_regionkey").alias("q")))).select("q", "doc", ((F.length("doc") * 3 + F.col("q")) % 7 + 0.5).alias("score"))


def ends(facts: DataFrame) -> DataFrame:
    return facts.select("doc", F.explode(F.array("s", "o")).alias("e")).distinct()


@R.add("o1_pairwise_emission", f"""
    WITH {WORLD}, {ENDS}, {LEX}, {SEED_DOCS}, idf AS (SELECT e, ln(((SELECT count(DISTINCT doc) FROM en) + 1) / (d + 0.5::DOUBLE)) + 1 AS idf FROM ed2 WHERE d <= {CAP}),
    pr AS (SELECT sq.q, sq.doc AS anchor, y.doc, sum(idf) AS t, count(*) AS n FROM sq JOIN en x ON x.doc = sq.doc JOIN idf ON idf.e = x.e JOIN en y ON y.e = x.e AND y.doc <> sq.doc GROUP BY ALL),
    sc AS (SELECT pr.q, anchor, pr.doc, round(0.55::DOUBLE * t + 0.35::DOUBLE * coalesce(score, 0) + 0.2::DOUBLE * ln(1 + n), 9) AS score FROM pr LEFT JOIN lx ON lx.q = pr.q AND lx.doc = pr.doc), r AS (SELECT *, row_number() OVER (PARTITION BY q, anchor ORDER BY score DESC, doc) AS k FROM sc)
    SELECT q, anchor, doc, round(score, 6) AS score FROM r WHERE k = 1
""")
def _(t: Tables) -> DataFrame:
    facts = world(t)[0]
    return X.pairwise_emission(seed_docs(t).select("q", "doc"), ends(facts), lex(t, facts), CAP).withColumn("score", F.round("score", 6))


@R.add("o2_anchor_neighbourhood", f"""
    WITH {WORLD}, {ENDS}, {LEX}, {SEED_DOCS}, nb AS (SELECT sq.q, y.doc, count(DISTINCT x.e) AS n FROM sq JOIN en x ON x.doc = sq.doc JOIN ed2 ON ed2.e = x.e AND d <= {CAP} JOIN en y ON y.e = x.e AND y.doc <> sq.doc GROUP BY ALL),
    sc AS (SELECT nb.q, nb.doc, round(n + ln(1 + coalesce(score, 0)), 9) AS score FROM nb LEFT JOIN lx ON lx.q = nb.q AND lx.doc = nb.doc), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM sc) SELECT q, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 20
""")
def _(t: Tables) -> DataFrame:
    facts = world(t)[0]
    return X.neighbourhood(seed_docs(t).select("q", "doc"), ends(facts), lex(t, facts), CAP, 20).withColumn("score", F.round("score", 6))


@R.add("o5_proposal_role_units", f"WITH {W.CH} SELECT q, doc, string_agg(DISTINCT channel, ',' ORDER BY channel) AS roles, round(max(score), 6) AS most, min(rank) AS best, count(*) AS n FROM ch GROUP BY q, doc")
def _(t: Tables) -> DataFrame:
    return X.role_units(W.channels(t).withColumnRenamed("channel", "role")).withColumn("most", F.round("most", 6))


@R.add("o5_covered_units", f"""
    WITH {W.CH}, {W.pool_sql('pool')}, u AS (SELECT DISTINCT q, channel AS role, doc % 40 AS unit, doc FROM ch WHERE rank <= 8), z AS (SELECT q, unit, role, count(*) AS size, count(*) FILTER (EXISTS (SELECT 1 FROM pool p WHERE p.q = u.q AND p.doc = u.doc AND p.pos <= 10)) AS have FROM u GROUP BY ALL)
    SELECT q, role, count(*) AS n FROM z WHERE size = have GROUP BY ALL
""")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    units = ch.where("rank <= 8").select("q", F.col("channel").alias("role"), (F.col("doc") % 40).alias("unit"), "doc").distinct()
    return X.covered_units(units, fusion.balanced_pool(ch).where("pos <= 10").select("q", "doc"))


@R.add("o6_slot_links", f"""
    WITH qt AS (SELECT item_id AS q, split_part(text, '.', 1) AS slot, unnest({TOK.format("split_part(text, '.', 1)")}) AS token FROM benchmark), ut AS (SELECT item_id AS unit, unnest({TOK.format('text')}) AS token FROM benchmark)
    SELECT q, slot, unit, count(DISTINCT token) AS shared FROM qt JOIN ut USING (token) GROUP BY ALL
""")
def _(t: Tables) -> DataFrame:
    slots = L.token_rows(t.benchmark.select(F.col("item_id").alias("q"), F.substring_index("text", ".", 1).alias("slot")), ["q", "slot"], "slot").drop("n")
    return X.slot_links(slots, L.token_rows(t.benchmark.select(F.col("item_id").alias("unit"), "text"), ["unit"]).drop("n"))


@R.add("a12_slot_coverage", f"""
    WITH sl AS (SELECT user_id AS q, event_type AS slot, event_id % 20 AS unit FROM events), du AS (SELECT DISTINCT event_id % 97 AS doc, event_id % 20 AS unit FROM events), {W.CH}, {W.pool_sql('pool')}
    SELECT pool.q, count(DISTINCT slot) AS slots FROM pool JOIN du USING (doc) JOIN sl ON sl.unit = du.unit AND sl.q = pool.q WHERE pos <= 3 GROUP BY pool.q
""")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    links = t.events.select(F.col("user_id").alias("q"), F.col("event_type").alias("slot"), (F.col("event_id") % 20).alias("unit")).distinct()
    units = t.events.select((F.col("event_id") % 97).alias("doc"), (F.col("event_id") % 20).alias("unit")).distinct()
    return X.slot_coverage(links, units, fusion.balanced_pool(ch).where("pos <= 3").select("q", "doc"))


@R.add("o7_support_priors", f"WITH {W.CH} SELECT q, doc, round(max(ln(1 + score) / sqrt(rank)), 6) AS prior FROM ch GROUP BY q, doc")
def _(t: Tables) -> DataFrame:
    return X.support_priors(W.channels(t)).withColumn("prior", F.round("prior", 6))


PAIRW = "pw AS (SELECT a.doc AS l, b.doc AS r, count(*)::DOUBLE AS w FROM (SELECT DISTINCT q, doc FROM ch WHERE rank <= 3) a JOIN (SELECT DISTINCT q, doc FROM ch WHERE rank <= 3) b ON a.q = b.q AND a.doc < b.doc GROUP BY ALL)"


def pair_weights(ch: DataFrame) -> DataFrame:
    top = ch.where("rank <= 3").select("q", "doc").distinct()
    return top.select("q", F.col("doc").alias("left")).join(top.select("q", F.col("doc").alias("right")), "q").where("left < right").groupBy("left", "right").agg(F.count("*").cast("double").alias("w"))


@R.add("k12_evidence_set_score", f"""
    WITH {W.CH}, {W.pool_sql('pool')}, {PAIRW}, st AS (SELECT q, pos % 4 AS set_id, doc, pos FROM pool WHERE pos <= 20), sc AS (SELECT q, doc, max(score) AS score FROM ch GROUP BY ALL), z AS (SELECT q, set_id, count(*) AS n, min(pos) * 0.25 AS mass FROM st GROUP BY ALL),
    lx AS (SELECT st.q, set_id, sum(ln(1 + coalesce(score, 0))) AS lex, sum(st.doc % 3) AS hub FROM st LEFT JOIN sc ON sc.q = st.q AND sc.doc = st.doc GROUP BY ALL), li AS (SELECT a.q, a.set_id, w, row_number() OVER (PARTITION BY a.q, a.set_id ORDER BY round(w, 9) DESC, l, r) AS k FROM st a JOIN st b ON a.q = b.q AND a.set_id = b.set_id JOIN pw ON l = a.doc AND r = b.doc),
    tr AS (SELECT li.q, li.set_id, sum(ln(1 + w)) AS tree, count(*) AS edges FROM li JOIN z ON z.q = li.q AND z.set_id = li.set_id WHERE k <= n - 1 GROUP BY ALL)
    SELECT z.q, z.set_id, round(0.6::DOUBLE * lex + 1.75::DOUBLE * mass + 1.75::DOUBLE * coalesce(tree, 0) - 2.2::DOUBLE * (n - 1 - coalesce(edges, 0)) - 0.18::DOUBLE * hub - 0.2::DOUBLE * greatest(n - 2, 0), 5) AS value FROM z JOIN lx USING (q, set_id) LEFT JOIN tr USING (q, set_id)
""")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    placed = fusion.balanced_pool(ch).where("pos <= 20")
    sets = placed.select("q", (F.col("pos") % 4).alias("set_id"), "doc")
    covered = placed.groupBy("q", (F.col("pos") % 4).alias("set_id")).agg((F.min("pos") * 0.25).alias("mass"))
    hubs = ch.select("doc", (F.col("doc") % 3).alias("n")).distinct()
    scored = X.set_scores(sets, pair_weights(ch), ch.groupBy("q", "doc").agg(F.max("score").alias("score")), covered, hubs)
    return scored.withColumn("value", F.round("value", 5))


@R.add("k13_beam_search")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    best = top_k(ch.groupBy("q", "doc").agg(F.max("score").alias("score")), ["q"], [F.desc("score"), "doc"], 12).select("q", "doc", "score")
    pairs = pair_weights(ch)
    own = best.select("q", F.col("doc").alias("left")).join(best.select("q", F.col("doc").alias("right")), "q").where("left < right").join(pairs, ["left", "right"])
    tokens = best.select("q", "doc", F.explode(F.array(F.col("doc") % 5, 5 + F.col("doc") % 3)).alias("token")).withColumn("idf", 1 + F.col("token") / 8)
    priors = best.select("q", "doc", (F.col("doc") % 4 / 4).alias("channel"), (F.col("doc") % 6 == 0).alias("support"), (F.col("doc") % 3).alias("hubs"))
    return X.beam_sets(best, own, tokens, priors)


IDFS = f"""ei AS (SELECT e, ln(((SELECT count(DISTINCT doc) FROM nx) + 1) / (count(DISTINCT doc) + 0.5::DOUBLE)) + 1 AS idf FROM (SELECT doc, unnest([s, o]) AS e FROM nx) GROUP BY e), qs AS (SELECT n_nationkey AS q, 'where is ' || n_name || ' and customer ' || n_nationkey AS text FROM nation),
    qt AS (SELECT q, unnest({TOK.format('text')}) AS token FROM qs), mt AS (SELECT n_nationkey AS q, {NORM.format('n_name')} AS e FROM nation WHERE n_nationkey % 2 = 0)"""


@R.add("p10_fact_seed_distribution", f"""
    WITH {WORLD}, {IDFS}, fe AS (SELECT DISTINCT fact, unnest([s, o]) AS e FROM nx), fi AS (SELECT fact, fe.e, coalesce(idf, 1) AS idf FROM fe LEFT JOIN ei ON ei.e = fe.e), ex AS (SELECT q, fact, sum(idf) AS w, 0 AS tier FROM mt JOIN fi USING (e) GROUP BY q, fact),
    ft AS (SELECT DISTINCT fact, unnest(string_split(e, ' ')) AS token FROM fe), sh AS (SELECT q, fact, count(*)::DOUBLE AS mass FROM qt JOIN ft USING (token) GROUP BY ALL), lo AS (SELECT q, sh.fact, mass * m AS w, 1 AS tier FROM sh JOIN (SELECT fact, avg(idf) AS m FROM fi GROUP BY fact) USING (fact)),
    al AS (SELECT * FROM ex UNION ALL SELECT * FROM lo), k AS (SELECT * FROM al WHERE tier = (SELECT min(tier) FROM al z WHERE z.q = al.q)) SELECT q, fact, round(w / sum(w) OVER (PARTITION BY q), 6) AS weight FROM k
""")
def _(t: Tables) -> DataFrame:
    from lanternfold.functions.text import normalised

    facts = world(t)[0]
    each = facts.select("doc", F.explode(F.array("s", "o")).alias("e"))
    n = facts.agg(F.countDistinct("doc").alias("n"))
    idf = each.groupBy("e").agg(F.countDistinct("doc").alias("d")).crossJoin(F.broadcast(n)).select("e", L.unit_idf(F.col("d"), F.col("n")).alias("idf"))
    text = F.concat(F.lit("where is "), F.col("n_name"), F.lit(" and customer "), F.col("n_nationkey").cast("string"))
    asked = L.token_rows(t.nation.select(F.col("n_nationkey").alias("q"), text.alias("text")), ["q"]).drop("n")
    matched = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("q"), normalised(F.col("n_name")).alias("e"))
    no_idf = t.nation.limit(0).select(F.col("n_name").alias("token"), F.lit(1.0).alias("idf"))
    return X.fact_seeds(facts, asked, idf, no_idf, matched).withColumn("weight", F.round("weight", 6))


@R.add("p13_endpoint_expansion", f"""
    WITH {WORLD}, {ENDS}, sw AS (SELECT n_regionkey AS q, md5(lower(n_name) || '|in region|' || lower(r_name)) AS fact, 1.0 / (1 + n_nationkey) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey), fe AS (SELECT DISTINCT fact, unnest([s, o]) AS e FROM nx)
    SELECT q, doc, round(sum(weight / d), 6) AS score FROM sw JOIN fe USING (fact) JOIN ed2 ON ed2.e = fe.e AND d <= {CAP} JOIN en ON en.e = fe.e GROUP BY ALL
""")
def _(t: Tables) -> DataFrame:
    seeds = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_regionkey").alias("q"), F.md5(F.concat_ws("|", F.lower("n_name"), F.lit("in region"), F.lower("r_name")).cast("binary")).alias("fact"), (1.0 / (1 + F.col("n_nationkey"))).alias("weight"))
    return X.endpoint_expansion(world(t)[0], seeds, CAP).withColumn("score", F.round("score", 6))


@R.add("f28_query_router", """
    WITH s AS (SELECT item_id AS q, CASE item_id % 4 WHEN 0 THEN 'why is ' WHEN 1 THEN 'what is part of ' ELSE '' END || text AS text, 1 + (item_id % 7) / 7.0 AS ec, 1 + (item_id % 5) / 5.0 AS hc, 1 + (item_id % 3) / 1.5 AS pc FROM benchmark),
    t AS (SELECT *, lower(text) AS lo, len(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS n FROM s),
    y AS (SELECT *, CASE WHEN regexp_matches(lo, 'why|how|cause|reason|effect|impact|mechanism') THEN 'explanatory' WHEN regexp_matches(lo, 'which county|part of|related to|connected to|before|after|whose|where was') OR (n > 12 AND hc >= ec) THEN 'multi_hop' ELSE 'factoid' END AS query_type FROM t),
    b AS (SELECT *, CASE query_type WHEN 'factoid' THEN 0.45::DOUBLE WHEN 'explanatory' THEN 0.20 ELSE 0.28 END AS e0, CASE query_type WHEN 'factoid' THEN 0.20::DOUBLE WHEN 'explanatory' THEN 0.48 ELSE 0.45 END AS h0, CASE query_type WHEN 'factoid' THEN 0.35::DOUBLE WHEN 'explanatory' THEN 0.32 ELSE 0.27 END AS p0,
      CASE query_type WHEN 'factoid' THEN 0.45::DOUBLE WHEN 'explanatory' THEN 0.70 ELSE 0.65 END AS d0, pc > greatest(ec, hc) * 1.25::DOUBLE AS c1, hc > ec * 1.1::DOUBLE AS c2, ec > pc * 1.15::DOUBLE AND n <= 10 AS c3 FROM y),
    c AS (SELECT q, query_type, e0 - CASE WHEN c2 THEN 0.04 ELSE 0 END + CASE WHEN c3 THEN 0.08 ELSE 0 END AS e, h0 - CASE WHEN c1 THEN 0.05 ELSE 0 END + CASE WHEN c2 THEN 0.08 ELSE 0 END AS h, p0 + CASE WHEN c1 THEN 0.1 ELSE 0 END - CASE WHEN c2 THEN 0.04 ELSE 0 END - CASE WHEN c3 THEN 0.05 ELSE 0 END AS p,
      CASE query_type WHEN 'factoid' THEN 0.32::DOUBLE WHEN 'explanatory' THEN 0.18 ELSE 0.27 END + CASE WHEN c2 THEN 0.03 ELSE 0 END + CASE WHEN c3 THEN 0.04 ELSE 0 END AS geh,
      CASE query_type WHEN 'factoid' THEN 0.10::DOUBLE WHEN 'explanatory' THEN 0.32 ELSE 0.33 END - CASE WHEN c1 THEN 0.04 ELSE 0 END + CASE WHEN c2 THEN 0.05 ELSE 0 END - CASE WHEN c3 THEN 0.03 ELSE 0 END AS ghh,
      CASE query_type WHEN 'factoid' THEN 0.28::DOUBLE WHEN 'explanatory' THEN 0.30 ELSE 0.20 END AS ghp, CASE query_type WHEN 'factoid' THEN 0.10::DOUBLE WHEN 'explanatory' THEN 0.07 ELSE 0.12 END AS gee,
      CASE query_type WHEN 'factoid' THEN 0.20::DOUBLE WHEN 'explanatory' THEN 0.13 ELSE 0.08 END + CASE WHEN c1 THEN 0.04 ELSE 0 END - CASE WHEN c2 THEN 0.04 ELSE 0 END AS gep,
      CASE query_type WHEN 'factoid' THEN 0.28::DOUBLE WHEN 'explanatory' THEN 0.18 ELSE 0.24 END + CASE WHEN c3 THEN 0.05 ELSE 0 END AS pe, CASE query_type WHEN 'factoid' THEN 0.24::DOUBLE WHEN 'explanatory' THEN 0.47 ELSE 0.46 END - CASE WHEN c1 THEN 0.06 ELSE 0 END AS ph,
      CASE query_type WHEN 'factoid' THEN 0.48::DOUBLE WHEN 'explanatory' THEN 0.35 ELSE 0.30 END + CASE WHEN c1 THEN 0.06 ELSE 0 END - CASE WHEN c3 THEN 0.05 ELSE 0 END AS pp,
      CASE WHEN c1 THEN greatest(0.4, d0 - 0.08) ELSE d0 END AS d1, c2 FROM b)
    SELECT q, query_type, round(greatest(e, 0) / (e + h + p), 6) AS entity, round(greatest(h, 0) / (e + h + p), 6) AS hyperedge, round(greatest(p, 0) / (e + h + p), 6) AS passage,
      round(geh / (geh + ghh + ghp + gee + gep), 6) AS gate_entity_hyperedge, round(ghh / (geh + ghh + ghp + gee + gep), 6) AS gate_hyperedge_hyperedge, round(ghp / (geh + ghh + ghp + gee + gep), 6) AS gate_hyperedge_passage,
      round(gee / (geh + ghh + ghp + gee + gep), 6) AS gate_entity_entity, round(gep / (geh + ghh + ghp + gee + gep), 6) AS gate_entity_passage,
      round(pe / (pe + ph + pp), 6) AS prior_entity, round(ph / (pe + ph + pp), 6) AS prior_hyperedge, round(pp / (pe + ph + pp), 6) AS prior_passage,
      round(least(greatest(CASE WHEN c2 THEN least(0.8, d1 + 0.05) ELSE d1 END, 0.35), 0.85), 6) AS damping FROM c
""")
def _(t: Tables) -> DataFrame:
    i = F.col("item_id")
    cue = F.when(i % 4 == 0, "why is ").when(i % 4 == 1, "what is part of ").otherwise("")
    rows = t.benchmark.select(i.alias("q"), F.concat(cue, F.col("text")).alias("text"), (1 + (i % 7) / 7.0).alias("entity_conc"), (1 + (i % 5) / 5.0).alias("hyperedge_conc"), (1 + (i % 3) / 1.5).alias("passage_conc"))
    out = router.routed(rows)
    shares = ["entity", "hyperedge", "passage", *[f"gate_{x}" for x in router.GATES], "prior_entity", "prior_hyperedge", "prior_passage"]
    return out.select("q", "query_type", *[F.round(c, 6).alias(c) for c in (*shares, "damping")])


@R.add("o8_shared_fact_filter", f"""
    WITH {W.CH}, tp AS (SELECT DISTINCT q, channel, doc, min(rank) AS rank FROM ch WHERE rank <= 5 GROUP BY ALL), kp AS (SELECT DISTINCT q, doc FROM tp WHERE (doc * 3 + q) % 4 <> 0), pj AS (SELECT tp.q, channel, tp.doc, rank, true AS kept FROM tp JOIN kp USING (q, doc)),
    fb AS (SELECT q, channel, doc, rank, false AS kept FROM tp WHERE rank = (SELECT min(rank) FROM tp z WHERE z.q = tp.q AND z.channel = tp.channel) AND NOT EXISTS (SELECT 1 FROM pj WHERE pj.q = tp.q AND pj.channel = tp.channel)) SELECT q, channel, doc, rank, kept FROM pj UNION ALL SELECT * FROM fb
""")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    decided = ch.where("rank <= 5").select("q", "doc").distinct().where("(doc * 3 + q) % 4 <> 0")
    return retrieval.shared_filter(ch, decided, 5)


CHANNELS_SQL = f"""rl AS (SELECT vec_id AS q, unnest(['r0', 'r1', 'r2']) AS role, unnest([0, 1, 2]) AS cpos FROM embeddings WHERE {W.VEC_Q}), rv AS (SELECT rl.q, role, cpos, e.embedding FROM rl JOIN embeddings e ON e.vec_id = (rl.q + cpos * 7) % (SELECT count(*) FROM embeddings)),
    sc AS (SELECT rv.q, role, cpos, k.vec_id AS doc, {W.DOT.format('rv', 'k')} AS score FROM rv CROSS JOIN embeddings k), rk AS (SELECT *, row_number() OVER (PARTITION BY q, role ORDER BY round(score, 9) DESC, doc) AS rank FROM sc),
    fu AS (SELECT q, doc, round(sum(1.0 / (60 + rank)), 9) AS score, min(cpos * 1000000 + rank) AS seen FROM rk WHERE rank <= 50 GROUP BY ALL), fp AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, seen, doc) AS pos FROM fu)"""


@R.add("o10_role_channel_retrieve", f"WITH {CHANNELS_SQL} SELECT q, doc, round(score, 6) AS score, pos FROM fp WHERE pos <= 20")
def _(t: Tables) -> DataFrame:
    _, keys = sides(t)
    n = t.embeddings.agg(F.count("*").alias("n"))
    roles = t.embeddings.where(W.VEC_Q).select(F.col("vec_id").alias("q"), F.posexplode(F.array(F.lit("r0"), F.lit("r1"), F.lit("r2"))).alias("cpos", "role")).crossJoin(F.broadcast(n))
    wanted = roles.select("q", "role", "cpos", ((F.col("q") + F.col("cpos") * 7) % F.col("n")).alias("id")).join(keys, "id").select("q", "role", "cpos", "v")
    return retrieval.role_channels(wanted, keys, 50, 20).withColumn("score", F.round("score", 6))


