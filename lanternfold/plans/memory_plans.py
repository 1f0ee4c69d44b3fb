"""Queries of stores, continual memory, support indexes and candidate channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.operators import channels as C
from lanternfold.operators import memory as M
from lanternfold.operators.ranking import ranked
from lanternfold.operators.shared import kept
from lanternfold.plans import worlds as W
from lanternfold.plans.graph_plans import PLACES, _checkpoints, places
from lanternfold.registry import Registry, Tables
from lanternfold.sources import stores as S

R = Registry()
TR = W.TRIPLES


@R.add("s3_insert_if_absent", """
    WITH st AS (SELECT DISTINCT 'chunk-' || md5(text) AS hash_id FROM documents WHERE lang <> 'en'), nw AS (SELECT DISTINCT 'chunk-' || md5(text) AS hash_id FROM documents)
    SELECT hash_id, false AS is_new FROM st UNION ALL SELECT hash_id, true FROM nw WHERE hash_id NOT IN (SELECT hash_id FROM st)
""")
def _(t: Tables) -> DataFrame:
    store = S.hashed(t.documents.where("lang <> 'en'").withColumnRenamed("text", "content"), "chunk").withColumn("is_new", F.lit(False))
    rows = S.hashed(t.documents.withColumnRenamed("text", "content"), "chunk").withColumn("is_new", F.lit(True))
    return S.inserted(store, rows).select("hash_id", "is_new")


@R.add("s4_delete_by_id", "SELECT doc_id, source FROM documents WHERE lang <> 'de'")
def _(t: Tables) -> DataFrame:
    return S.deleted(t.documents, t.documents.where("lang = 'de'").select("doc_id"), "doc_id").select("doc_id", "source")


@R.add("s5_multi_get", "WITH w AS (SELECT item_id AS pos, (item_id * 7) % 500 AS vec_id FROM benchmark) SELECT pos, vec_id, label FROM w JOIN embeddings USING (vec_id)")
def _(t: Tables) -> DataFrame:
    wanted = t.benchmark.select(F.col("item_id").alias("pos"), ((F.col("item_id") * 7) % 500).alias("vec_id"))
    return S.fetched(t.embeddings, wanted, "vec_id").select("pos", "vec_id", "label")


@R.add("s6_record_upsert", """
    WITH st AS (SELECT doc_id, source, n_chars FROM documents), nw AS (SELECT doc_id, 'label' || quality AS source, toxic::BIGINT AS n_chars FROM labels),
    u AS (SELECT * FROM nw UNION ALL SELECT * FROM st WHERE doc_id NOT IN (SELECT doc_id FROM nw)) SELECT doc_id, source, n_chars FROM u
""")
def _(t: Tables) -> DataFrame:
    store = S.record_rows(t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    new = S.record_rows(t.labels.select("doc_id", F.concat(F.lit("label"), F.col("quality").cast("string")).alias("source"), F.col("toxic").cast("long").alias("n_chars")), "doc_id")
    return S.records(S.upserted(store, new, "doc_id"), "doc_id", "source string, n_chars long")


@R.add("s7_missing_extractions", "SELECT DISTINCT 'chunk-' || md5(text) AS hash_id FROM documents WHERE md5(text) NOT IN (SELECT md5(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id)")
def _(t: Tables) -> DataFrame:
    have = S.hashed(t.documents.join(t.labels, "doc_id", "left_semi").withColumnRenamed("text", "content"), "chunk")
    return S.missing(have, S.hashed(t.documents.withColumnRenamed("text", "content"), "chunk")).select("hash_id")


@R.add("s8_extraction_statistics", f"WITH {TR}, e AS (SELECT DISTINCT passage, unnest([s, o]) AS e FROM tr) SELECT round(avg(length(e)), 4) AS avg_ent_chars, round(avg(len(string_split(e, ' '))), 4) AS avg_ent_words FROM e")
def _(t: Tables) -> DataFrame:
    docs = W.triples(t).groupBy("passage").agg(F.array_distinct(F.flatten(F.collect_list(F.array("s", "o")))).alias("entities"))
    return S.extraction_statistics(docs)


@R.add("s10_rank_cache", f"WITH {W.CH}, r AS (SELECT q, channel AS role, row_number() OVER (PARTITION BY q, channel ORDER BY rank) AS rank, doc, round(score, 4) AS score FROM ch WHERE rank <= 5) SELECT * FROM r")
def _(t: Tables) -> DataFrame:
    top = W.channels(t).where("rank <= 5").groupBy("q", "channel").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", F.round("score", 4).alias("score")))).alias("x"))
    lists = top.select("q", "channel", F.struct(F.transform("x", lambda v: v["doc"]).alias("doc_indices"), F.transform("x", lambda v: v["score"]).alias("doc_scores")).alias("v"))
    by_query = lists.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("channel", "v"))).alias("roles"))
    named = F.map_from_entries(F.array(F.struct(F.col("q").cast("string"), F.col("roles"))))
    wrapped = F.to_json(F.struct(named.alias("role_rankings_by_query")))
    bare = F.to_json(named)
    even = by_query.select(F.when(F.col("q") % 2 == 0, wrapped).otherwise(bare).alias("value"))
    return S.rank_cache(even)


@R.add("s10_compatibility_cache", f"WITH {W.CH} SELECT q, channel AS role, doc, round(max(score), 4) AS score FROM ch GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    best = W.channels(t).groupBy("q", "channel", "doc").agg(F.round(F.max("score"), 4).alias("score"))
    docs = best.groupBy("q", "channel").agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc").cast("string"), F.col("score")))).alias("docs"))
    roles = docs.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("channel", "docs"))).alias("roles"))
    return S.compatibility_cache(roles.select(F.to_json(F.struct(F.map_from_entries(F.array(F.struct(F.col("q").cast("string"), F.col("roles")))).alias("scores_by_query"))).alias("value")))


@R.add("s12_title_index", r"WITH t AS (SELECT doc_id AS doc, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\s+', ' ', 'g')) AS title FROM documents) SELECT title, min(doc) AS doc FROM t WHERE title <> '' GROUP BY title")
def _(t: Tables) -> DataFrame:
    return S.title_index(t.documents.select(F.col("doc_id").alias("doc"), F.substring_index("text", "\n", 1).alias("title"))).select("title", "doc")


@R.add("s13_text_index_conflicts", "SELECT md5(text) AS text_hash, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return S.text_index(t.documents.select(F.col("doc_id").alias("doc"), "text"))[1].select(F.md5(F.col("text").cast("binary")).alias("text_hash"), "n")


@R.add("s14_resumable_questions", "SELECT DISTINCT user_id AS q FROM events WHERE event_id % 3 = 0 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click')")
def _(t: Tables) -> DataFrame:
    config = {"rrf_k": 60, "top_k": 5}
    mark = F.when(F.col("event_id") % 3 == 0, S.fingerprint(config)).otherwise(S.fingerprint(config | {"top_k": 6}))
    wanted = t.events.where("event_type = 'click'").select(F.col("user_id").alias("q")).distinct()
    return S.resumable(t.events.select(F.col("user_id").alias("q"), mark.alias("fingerprint")), config, wanted)


@R.add("s15_uncached_requests", "SELECT item_id FROM benchmark WHERE text NOT IN (SELECT text FROM benchmark WHERE item_id % 4 = 1)")
def _(t: Tables) -> DataFrame:
    asked = t.benchmark.select("item_id", S.cache_key(F.col("text")).alias("key"))
    cache = t.benchmark.where("item_id % 4 = 1").select(S.cache_key(F.col("text")).alias("key"), F.lit("x").alias("answer")).distinct()
    return S.cached(asked, cache)[1].select("item_id")


@R.add("s16_referential_audit", f"""
    WITH {TR}, hy AS (SELECT s || '|' || r || '|' || o AS h, list(DISTINCT passage) AS src FROM tr GROUP BY s, r, o), kn AS (SELECT DISTINCT s AS id FROM tr),
    a AS (SELECT DISTINCT 'passage_entity' AS kind, passage AS owner, unnest([s, o]) AS missing FROM tr), b AS (SELECT DISTINCT 'hyperedge_entity' AS kind, s || '|' || r || '|' || o AS owner, unnest([s, o]) AS missing FROM tr)
    SELECT kind, count(*) AS n, count(DISTINCT missing) AS names FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE missing NOT IN (SELECT id FROM kn) GROUP BY kind
""")
def _(t: Tables) -> DataFrame:
    tr = W.triples(t).withColumn("h", F.concat_ws("|", "s", "r", "o"))
    passages = tr.groupBy("passage").agg(F.array_distinct(F.flatten(F.collect_list(F.array("s", "o")))).alias("entity_ids"), F.collect_set("h").alias("proposition_ids"))
    hyper = tr.groupBy("h").agg(F.array_distinct(F.flatten(F.collect_list(F.array("s", "o")))).alias("participant_ids"), F.collect_set("passage").alias("source_ids"))
    found = S.audit(passages, hyper, tr.select(F.col("s").alias("id")).distinct())
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("missing").alias("names"))


@R.add("j16_common_question_ids", "SELECT DISTINCT user_id AS q FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE value > 90")
def _(t: Tables) -> DataFrame:
    q = lambda where: t.events.where(where).select(F.col("user_id").alias("q"))
    return q("event_type = 'click'").distinct().join(q("event_type = 'purchase'"), "q", "left_semi").join(q("value > 90"), "q", "left_semi")


STEP = "ob AS (SELECT 'k' || CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS entity, user_id AS source, date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE) AS step, 1 AS n FROM events)"


def observations(t: Tables) -> DataFrame:
    first = t.events.agg(F.min("ts").alias("first"))
    rows = t.events.crossJoin(F.broadcast(first))
    return rows.select(F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("entity"), F.col("user_id").alias("source"), F.datediff("ts", "first").cast("long").alias("step"), F.lit(1).cast("long").alias("n"))


@R.add("a6_record_merge", f"WITH {STEP} SELECT entity, count(DISTINCT source) AS sources, count(*) AS support, min(step) AS first_seen, max(step) AS last_seen FROM ob GROUP BY entity")
def _(t: Tables) -> DataFrame:
    return M.merged_records(observations(t))


@R.add("a6_incremental_upsert", f"WITH {STEP} SELECT entity, count(DISTINCT source) AS sources, count(*) AS support, max(step) AS last_seen FROM ob GROUP BY entity")
def _(t: Tables) -> DataFrame:
    ob = observations(t)
    part = lambda where: ob.where(where).groupBy("entity").agg(F.collect_set("source").alias("sources"), F.sum("n").alias("support"), F.max("step").alias("last_seen"))
    state = M.upsert(M.upsert(part("step < 5"), part("step >= 5 and step < 12")), part("step >= 12"))
    return state.select("entity", F.size("sources").cast("long").alias("sources"), "support", "last_seen")


@R.add("a5_proposition_merge", f"""
    WITH {STEP}, s AS (SELECT entity AS h, source, step, n AS support, 'note ' || (source % 4) AS snippet FROM ob), f AS (SELECT h, snippet, min(step * 1000000 + source) AS o FROM s GROUP BY ALL),
    sn AS (SELECT h, string_agg(snippet, '|' ORDER BY o, snippet) AS snippets FROM f GROUP BY h) SELECT s.h, count(DISTINCT source) AS sources, count(*) AS support, max(step) AS last_seen, any_value(snippets) AS snippets FROM s JOIN sn ON sn.h = s.h GROUP BY s.h
""")
def _(t: Tables) -> DataFrame:
    ob = observations(t)
    return M.merged_propositions(ob.select(F.col("entity").alias("h"), "source", "step", F.col("n").alias("support"), F.concat(F.lit("note "), (F.col("source") % 4).cast("string")).alias("snippet")))


@R.add("a7_deletion_cascade", f"WITH {STEP} SELECT entity AS id, count(DISTINCT source) AS support FROM ob WHERE source NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 80) GROUP BY entity")
def _(t: Tables) -> DataFrame:
    gone = t.events.where("event_type = 'error' and value > 80").select(F.col("user_id").alias("source")).distinct()
    return M.after_deletion(observations(t).withColumnRenamed("entity", "id"), gone)


FACT = "fc AS (SELECT md5(s || '|' || r || '|' || o) AS fact, passage, s, r, o FROM pl)"


def place_facts(t: Tables) -> DataFrame:
    return places(t).withColumn("fact", F.md5(F.concat_ws("|", "s", "r", "o").cast("binary")))


IDX = """ix AS (SELECT kind, k1, k2, k3, count(DISTINCT passage) AS n, min(passage) AS first_passage FROM (SELECT passage, 'fact' AS kind, s AS k1, r AS k2, o AS k3 FROM tr UNION ALL SELECT passage, 'pair', s, r, '' FROM tr UNION ALL SELECT passage, 'pair', o, r, '' FROM tr
    UNION ALL SELECT passage, 'anchor', 'subject', r, s FROM tr UNION ALL SELECT passage, 'target', 'object', r, o FROM tr UNION ALL SELECT passage, 'entity', s, '', '' FROM tr UNION ALL SELECT passage, 'entity', o, '', '' FROM tr UNION ALL SELECT passage, 'relation', r, '', '' FROM tr) GROUP BY ALL)"""


@R.add("a17_support_index", f"WITH {TR}, {IDX} SELECT * FROM ix")
def _(t: Tables) -> DataFrame:
    return M.support_index(W.triples(t))


@R.add("h3_slot_support_tiers", f"""
    WITH {TR}, {PLACES}, {FACT}, {IDX.replace('tr ', 'pl ').replace('tr)', 'pl)')}, sl AS (SELECT DISTINCT fact, r, 'anchor' AS slot, s AS entity FROM fc UNION SELECT DISTINCT fact, r, 'target', o FROM fc)
    SELECT fact, slot, entity, a.n AS exact, p.n AS pair, e.n AS entity_support FROM sl LEFT JOIN ix a ON a.kind = sl.slot AND a.k2 = sl.r AND a.k3 = sl.entity LEFT JOIN ix p ON p.kind = 'pair' AND p.k1 = sl.entity AND p.k2 = sl.r LEFT JOIN ix e ON e.kind = 'entity' AND e.k1 = sl.entity
""")
def _(t: Tables) -> DataFrame:
    return M.slot_support(place_facts(t))


#: bridges with hubs of more than 60 facts left out; the smallest graph that still has both kinds
BR = """en AS (SELECT DISTINCT fact, unnest([s, o]) AS entity FROM fc), le AS (SELECT * FROM en WHERE entity IN (SELECT entity FROM en GROUP BY entity HAVING count(*) <= 60)), pf AS (SELECT DISTINCT fact, passage FROM fc),
    lp AS (SELECT * FROM pf WHERE passage IN (SELECT passage FROM pf GROUP BY passage HAVING count(*) <= 60)), ep AS (SELECT a.fact AS l, b.fact AS r, count(*) AS eo FROM le a JOIN le b ON a.entity = b.entity AND a.fact < b.fact GROUP BY ALL),
    sp AS (SELECT a.fact AS l, b.fact AS r, count(*) AS so FROM lp a JOIN lp b ON a.passage = b.passage AND a.fact < b.fact GROUP BY ALL), br AS (SELECT coalesce(ep.l, sp.l) AS l, coalesce(ep.r, sp.r) AS r, coalesce(eo, 0) AS eo, coalesce(so, 0) AS so FROM ep FULL JOIN sp ON ep.l = sp.l AND ep.r = sp.r),
    fr AS (SELECT DISTINCT fact, r FROM fc), ty AS (SELECT br.l, br.r, CASE WHEN eo > 0 AND a.r = b.r THEN 'relation_continuation' WHEN so > 0 THEN 'same_source_chain' ELSE 'shared_entity_bridge' END AS kind, eo, so FROM br JOIN fr a ON a.fact = br.l JOIN fr b ON b.fact = br.r),
    bo AS (SELECT *, l AS owner, r AS other FROM ty UNION ALL SELECT *, r, l FROM ty), bk AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY eo DESC, so DESC, other) AS k FROM bo), pa AS (SELECT DISTINCT l, r, kind, eo, so FROM bk WHERE k <= 6)"""


def kept_facts(t: Tables) -> DataFrame:
    """``place_facts`` by the 16 bytes of their ids, which sort like the ids; the triples, in the order of their passages, are kept small."""
    _checkpoints(t)
    return kept(places(t)).withColumn("fact", F.unhex(F.md5(F.concat_ws("|", "s", "r", "o").cast("binary"))))


def _named(c: Column) -> Column:
    return F.lower(F.hex(c))


def bridges(t: Tables) -> M.Bridges:
    return M.Bridges(kept_facts(t), 60, 6, shown=_named)


@R.add("h4_bridge_paths", f'WITH {TR}, {PLACES}, {FACT}, {BR} SELECT l AS "left", r AS "right", kind, eo AS entity_overlap, so AS source_overlap FROM pa')
def _(t: Tables) -> DataFrame:
    return bridges(t).paths()


TRL = """bt AS (SELECT l AS a, r AS b, eo, so FROM pa UNION ALL SELECT r, l, eo, so FROM pa), sk AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY so = 0, eo DESC, b) AS k FROM bt), st AS (SELECT * FROM sk WHERE k <= 4),
    tw AS (SELECT x.a AS s0, x.b AS m0, y.b AS e0, x.k AS k1, y.k AS k2 FROM st x JOIN st y ON y.a = x.b WHERE x.a <> y.b), tk AS (SELECT *, row_number() OVER (PARTITION BY s0 ORDER BY k1, k2) AS place FROM tw), tl AS (SELECT * FROM tk WHERE place <= 8)"""


@R.add("h5_support_trails", f'WITH {TR}, {PLACES}, {FACT}, {BR}, {TRL} SELECT s0 AS "start", m0 AS middle, e0 AS "end", place FROM tl')
def _(t: Tables) -> DataFrame:
    return bridges(t).trails()


@R.add("h6_trail_membership", f"""
    WITH {TR}, {PLACES}, {FACT}, {BR}, {TRL}, ow AS (SELECT s0 || '>' || m0 || '>' || e0 AS trail, unnest([s0, m0, e0]) AS fact, [s0, m0, e0] AS al FROM tl), mm AS (SELECT trail, fact, unnest(al) AS member FROM ow)
    SELECT mm.fact, count(DISTINCT trail) AS trails, count(DISTINCT member) AS facts, count(DISTINCT passage) AS passages FROM mm JOIN (SELECT DISTINCT fact, passage FROM fc) f ON f.fact = mm.member GROUP BY mm.fact
""")
def _(t: Tables) -> DataFrame:
    return bridges(t).trail_membership()


@R.add("h6_trail_endpoints", f"WITH {TR}, {PLACES}, {FACT}, {BR}, {TRL} SELECT fact, other, count(*) AS trails FROM (SELECT s0 AS fact, e0 AS other FROM tl UNION ALL SELECT e0, s0 FROM tl) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return bridges(t).trail_endpoints()


#: a region asks; its activated facts are its suppliers' by balance, its entities its nations, its dense ranking all places by id
ACT = """ac AS (SELECT * FROM (SELECT n_regionkey AS q, md5(lower(s_name) || '|in nation|' || lower(n_name)) AS fact, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS frank FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE frank <= 8),
    en_q AS (SELECT n_regionkey AS q, lower(n_name) AS entity FROM nation WHERE n_nationkey < 15), de AS (SELECT * FROM (SELECT r_regionkey AS q, passage, row_number() OVER (PARTITION BY r_regionkey ORDER BY md5(passage || r_regionkey)) AS drank FROM (SELECT DISTINCT passage FROM pl) CROSS JOIN region) WHERE drank <= 16)"""


def activation(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("long")
    fact = F.md5(F.concat_ws("|", F.lower("s_name"), F.lit("in nation"), F.lower("n_name")).cast("binary"))
    act = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("q"), fact.alias("fact"), rank.alias("frank")).where("frank <= 8")
    entities = t.nation.where("n_nationkey < 15").select(F.col("n_regionkey").alias("q"), F.lower("n_name").alias("entity"))
    every = places(t).select("passage").distinct().crossJoin(F.broadcast(t.region.select(F.col("r_regionkey").alias("q"))))
    keyed = every.withColumn("key", F.md5(F.concat("passage", F.col("q").cast("string")).cast("binary")))
    return act, entities, ranked(keyed, ["q"], ["key"], "drank").where("drank <= 16").select("q", "passage", "drank")


def activated(t: Tables) -> DataFrame:
    """The activated facts, eight a region, by the 16 bytes of their ids."""
    return F.broadcast(kept(activation(t)[0].withColumn("fact", F.unhex("fact"))))


EV = """bf AS (SELECT q, passage, count(DISTINCT ac.fact) AS n_fact, min(frank) AS best_fact FROM ac JOIN fc USING (fact) GROUP BY ALL), nm AS (SELECT DISTINCT passage, unnest([s, o]) AS entity FROM fc), be AS (SELECT q, passage, count(*) AS n_entity FROM en_q JOIN nm USING (entity) GROUP BY ALL)"""


def _top_sql(order: str, k: int = 20) -> str:
    return f"rk AS (SELECT q, passage, row_number() OVER (PARTITION BY q ORDER BY {order}, passage DESC) AS rank FROM ro) SELECT * FROM rk WHERE rank <= {k}"


@R.add("h7_query_activation", f"WITH {TR}, {PLACES}, {ACT} SELECT q, 'fact' AS kind, fact AS id, frank AS rank FROM ac UNION ALL SELECT q, 'passage', passage, drank FROM de")
def _(t: Tables) -> DataFrame:
    act, _, dense = activation(t)
    return act.select("q", F.lit("fact").alias("kind"), F.col("fact").alias("id"), F.col("frank").alias("rank")).unionByName(dense.select("q", F.lit("passage").alias("kind"), F.col("passage").alias("id"), F.col("drank").alias("rank")))


@R.add("h8_coverage_channel", f"""
    WITH {TR}, {PLACES}, {FACT}, {ACT}, {EV}, ky AS (SELECT q, passage FROM bf UNION SELECT q, passage FROM be UNION SELECT q, passage FROM de),
    ro AS (SELECT ky.q, ky.passage, coalesce(n_fact, 0) AS nf, coalesce(n_entity, 0) AS ne, coalesce(drank, 1073741824) AS dr FROM ky LEFT JOIN bf USING (q, passage) LEFT JOIN be USING (q, passage) LEFT JOIN de USING (q, passage)), {_top_sql('nf = 0, nf DESC, ne = 0, ne DESC, dr')}
""")
def _(t: Tables) -> DataFrame:
    return C.coverage(*activation(t), place_facts(t), 20)


@R.add("h9_support_channel", f"""
    WITH {TR}, {PLACES}, {FACT}, {ACT}, {EV}, aq AS (SELECT DISTINCT q, frank, s, r, o FROM ac JOIN fc USING (fact)), pq AS (SELECT q, e, r, min(frank) AS frank FROM (SELECT q, frank, s AS e, r FROM aq UNION SELECT q, frank, o, r FROM aq) GROUP BY ALL),
    ph AS (SELECT passage, s AS e, r FROM fc UNION SELECT passage, o, r FROM fc), bp AS (SELECT q, passage, count(*) AS np, min(frank) AS bp FROM pq JOIN ph USING (e, r) GROUP BY ALL), ky AS (SELECT q, passage FROM bp UNION SELECT q, passage FROM bf UNION SELECT q, passage FROM be),
    ro AS (SELECT ky.q, ky.passage, coalesce(np, 0) AS np, coalesce(bp, 1073741824) AS bp, coalesce(n_entity, 0) AS ne, coalesce(best_fact, 1073741824) AS bfr, coalesce(drank, 1073741824) AS dr FROM ky LEFT JOIN bp USING (q, passage) LEFT JOIN bf USING (q, passage) LEFT JOIN be USING (q, passage) LEFT JOIN de USING (q, passage)),
    {_top_sql('np DESC, bp, ne DESC, bfr, dr')}
""")
def _(t: Tables) -> DataFrame:
    return C.support(*activation(t), place_facts(t), 20)


@R.add("h10_slot_tier_channel", f"""
    WITH {TR}, {PLACES}, {FACT}, {ACT}, aq AS (SELECT DISTINCT q, s, r, o FROM ac JOIN fc USING (fact)), sx AS (SELECT DISTINCT passage, s, r, o FROM fc),
    t1 AS (SELECT q, passage, count(*) AS n FROM (SELECT DISTINCT q, r, o FROM aq) JOIN (SELECT DISTINCT passage, r, o FROM sx) USING (r, o) GROUP BY ALL), t2 AS (SELECT q, passage, count(*) AS n FROM aq JOIN sx USING (s, r, o) GROUP BY ALL),
    t3 AS (SELECT q, passage, count(*) AS n FROM (SELECT DISTINCT q, s, r FROM aq) JOIN (SELECT DISTINCT passage, s, r FROM sx) USING (s, r) GROUP BY ALL), ky AS (SELECT q, passage FROM t1 UNION SELECT q, passage FROM t2 UNION SELECT q, passage FROM t3),
    ro AS (SELECT ky.q, ky.passage, coalesce(t1.n, 0) AS a, coalesce(t2.n, 0) AS b, coalesce(t3.n, 0) AS c, coalesce(drank, 1073741824) AS dr FROM ky LEFT JOIN t1 USING (q, passage) LEFT JOIN t2 USING (q, passage) LEFT JOIN t3 USING (q, passage) LEFT JOIN de USING (q, passage)), {_top_sql('a DESC, b DESC, c DESC, dr')}
""")
def _(t: Tables) -> DataFrame:
    act, _, dense = activation(t)
    return C.slot_tier(act, dense, place_facts(t), 20)


@R.add("h12_bridge_path_channel", f"""
    WITH {TR}, {PLACES}, {FACT}, {BR}, {ACT}, bb AS (SELECT l AS fact, r AS far, eo, so FROM pa UNION ALL SELECT r, l, eo, so FROM pa),
    ro AS (SELECT q, passage, count(*) AS n, count(DISTINCT ac.fact) AS nf, sum(eo) AS ent, sum(so) AS src, min(frank) AS best FROM ac JOIN bb ON bb.fact = ac.fact JOIN (SELECT DISTINCT fact, passage FROM fc) f ON f.fact = bb.far GROUP BY ALL), {_top_sql('n DESC, nf DESC, ent DESC, src DESC, best')}
""")
def _(t: Tables) -> DataFrame:
    facts, act = kept_facts(t), activated(t)
    return C.bridge_path(act, M.Bridges(facts, 60, 6, act.select("fact")).paths(), facts, 20)


@R.add("h13_support_trail_channel", f"""
    WITH {TR}, {PLACES}, {FACT}, {BR}, {TRL}, {ACT}, mb AS (SELECT s0, m0, e0, unnest([s0, m0, e0]) AS fact FROM tl),
    ro AS (SELECT q, passage, count(DISTINCT s0 || m0 || e0) AS n, count(DISTINCT mb.fact) AS nf, min(frank) AS best FROM ac JOIN mb ON mb.s0 = ac.fact JOIN (SELECT DISTINCT fact, passage FROM fc) f ON f.fact = mb.fact GROUP BY ALL), {_top_sql('n DESC, nf DESC, best')}
""")
def _(t: Tables) -> DataFrame:
    facts, act = kept_facts(t), activated(t)
    return C.support_trail(act, M.Bridges(facts, 60, 6, act.select("fact")).trails(), facts, 20)


HEAD = "hd AS (SELECT q, passage FROM de WHERE drank <= 4)"


@R.add("h14_route_channel", f"""
    WITH {TR}, {PLACES}, {FACT}, {ACT}, {HEAD}, nm AS (SELECT DISTINCT passage, unnest([s, o]) AS entity FROM fc), he AS (SELECT DISTINCT q, entity FROM hd JOIN nm USING (passage)), be AS (SELECT q, passage, count(*) AS ne FROM he JOIN nm USING (entity) GROUP BY ALL),
    bf AS (SELECT q, passage, count(DISTINCT ac.fact) AS nf FROM ac JOIN fc USING (fact) GROUP BY ALL), ro AS (SELECT be.q, be.passage, coalesce(nf, 0) AS nf, ne, coalesce(drank, 1073741824) AS dr FROM be LEFT JOIN bf USING (q, passage) LEFT JOIN de USING (q, passage)), {_top_sql('nf DESC, ne DESC, dr')}
""")
def _(t: Tables) -> DataFrame:
    act, _, dense = activation(t)
    return C.route(act, dense.where("drank <= 4").select("q", "passage"), dense, place_facts(t), 20)


@R.add("h15_deficit_facts", f"WITH {TR}, {PLACES}, {FACT}, {ACT}, hx AS (SELECT q, passage FROM de), sx AS (SELECT DISTINCT q, fact FROM hx JOIN fc USING (passage)), op AS (SELECT q, fact, 1.0 / frank AS w FROM ac WHERE NOT EXISTS (SELECT 1 FROM sx WHERE sx.q = ac.q AND sx.fact = ac.fact)) SELECT q, fact, round(w / sum(w) OVER (PARTITION BY q), 6) AS weight FROM op")
def _(t: Tables) -> DataFrame:
    act, _, dense = activation(t)
    return C.deficits(act, dense.select("q", "passage"), place_facts(t)).withColumn("weight", F.round("weight", 6))


@R.add("h16_local_subgraph", f"""
    WITH {TR}, {PLACES}, {FACT}, {ACT}, ca AS (SELECT q, 's' || s_suppkey AS passage FROM supplier CROSS JOIN (SELECT DISTINCT q FROM ac))
    SELECT DISTINCT q, 'fact_passage' AS edge_type, fact AS src, passage AS dst FROM ca JOIN fc USING (passage) JOIN ac USING (q, fact) UNION SELECT DISTINCT q, 'fact_entity', fact, unnest([s, o]) FROM ac JOIN fc USING (fact)
""")
def _(t: Tables) -> DataFrame:
    act = activation(t)[0]
    docs = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("passage")).crossJoin(act.select("q").distinct())
    return C.local_subgraph(docs, act, place_facts(t))
