"""Queries of excerpts, model surfaces with their defaults, reranking, repairs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.functions import excerpts as E
from lanternfold.functions import surfaces as U
from lanternfold.operators import fusion
from lanternfold.operators import graph as G
from lanternfold.operators.ranking import min_max_zero_safe, ranked, top_k
from lanternfold.plans import worlds as W
from lanternfold.plans.graph_plans import places
from lanternfold.plans.text_plans import NORM
from lanternfold.registry import Registry, Tables

R = Registry()


@R.add("f7_source_spans")
def _(t: Tables) -> DataFrame:
    spans = t.documents.select("doc_id", F.posexplode(E.source_spans(F.col("text"))).alias("pos", "span"))
    return spans.select("doc_id", "pos", F.length("span").alias("n_chars"), F.md5(F.col("span").cast("binary")).alias("span"))


@R.add("f11_focused_excerpt")
def _(t: Tables) -> DataFrame:
    asked = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return asked.join(answers, ["conv_id", "turn"]).select("conv_id", "turn", E.focused_excerpt(F.col("text"), F.col("question"), 80).alias("excerpt"))


@R.add("f20_json_repair", """
    SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE '{"a": ' || user_id || ', "b": "' || event_type || '"}' END AS object FROM events
""")
def _(t: Tables) -> DataFrame:
    a, b = F.col("user_id").cast("string"), F.col("event_type")
    good = F.concat(F.lit('{"b": "'), b, F.lit('", "a": '), a, F.lit("}"))
    wrapped = F.concat(F.lit("Sure:\n"), good, F.lit("\nDone"))
    broken = F.concat(F.lit('{"b": "'), b, F.lit('"\n "a": '), a, F.lit("}"))
    n = F.col("event_id") % 4
    return t.events.select("event_id", E.json_object(F.when(n == 0, good).when(n == 1, wrapped).when(n == 2, broken).otherwise("none here")).alias("object"))


@R.add("f23_extraction_sanitising", "SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '' ELSE ',k' || user_id END AS entities FROM events")
def _(t: Tables) -> DataFrame:
    more = F.when(F.col("event_id") % 2 == 0, F.lit('"..."')).otherwise(F.concat(F.lit('"k'), F.col("user_id").cast("string"), F.lit('"')))
    response = F.concat(F.lit('text {"named_entities": ["'), "event_type", F.lit('", " ", '), more, F.lit(', "'), "event_type", F.lit('"]} end'))
    return t.events.select("event_id", F.array_join(E.sanitised_entities(response), ",").alias("entities"))


@R.add("u1_hashed_embeddings")
def _(t: Tables) -> DataFrame:
    v = t.benchmark.select("item_id", U.embedded("text").alias("v"))
    return v.select("item_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@R.add("u3_extracted_triples", r"""
    WITH h AS (SELECT doc_id AS passage, ltrim(unnest(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z ]', '|', 'g'), ' [a-z]+ (?:is|was|has|in|of|by) [a-z]+'))) AS x FROM documents)
    SELECT DISTINCT passage, split_part(x, ' ', 1) AS s, split_part(x, ' ', 2) AS r, split_part(x, ' ', 3) AS o FROM h
""")
def _(t: Tables) -> DataFrame:
    return U.extracted_triples(t.documents.select(F.col("doc_id").alias("passage"), "text"))


@R.add("o11_fallback_roles", r"WITH c AS (SELECT item_id AS q, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM benchmark) SELECT q, 0::BIGINT AS pos, 'r0' AS role_id, 'answer_bearing' AS role_type, 'Find evidence that directly answers: ' || x AS description FROM c")
def _(t: Tables) -> DataFrame:
    return U.fallback_roles(t.benchmark.select(F.col("item_id").alias("q"), "text"))


@R.add("u6_extractive_reader")
def _(t: Tables) -> DataFrame:
    asked = t.benchmark.select("item_id", F.col("text").alias("question"))
    return asked.select("item_id", U.read_answer(F.concat_ws(" ", F.lit("Before all."), "question", F.lit("After all.")), F.col("question"), 60).alias("answer"))


@R.add("u7_verifier_scores", f"""
    WITH w AS (SELECT item_id, list_distinct(list_filter(string_split({NORM.format('text')}, ' '), lambda x: length(x) >= 3)) AS t FROM benchmark), p AS (SELECT a.item_id AS q, b.item_id AS doc, len(list_intersect(a.t, b.t)) / greatest(len(a.t), 1) AS share FROM w a JOIN w b ON b.item_id // 10 = a.item_id // 10)
    SELECT q, doc, CASE WHEN share >= 0.5 THEN 1.0::DOUBLE WHEN share > 0 THEN 0.5 ELSE 0 END AS score FROM p
""")
def _(t: Tables) -> DataFrame:
    a = t.benchmark.select(F.col("item_id").alias("q"), F.col("text").alias("role"), F.expr("item_id div 10").alias("g"))
    b = t.benchmark.select(F.col("item_id").alias("doc"), "text", F.expr("item_id div 10").alias("g"))
    return a.join(b, "g").select("q", "doc", U.verifier_score(F.col("text"), F.col("role")).alias("score"))


@R.add("u8_reader_prompt", """
    WITH c AS (SELECT conv_id, string_agg('[' || k || '] ' || text, chr(10) ORDER BY k) AS body, max(CASE WHEN k = 1 THEN text END) AS question FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id)
    SELECT conv_id, md5(body || chr(10) || 'Question: ' || question || chr(10) || 'Answer:') AS prompt FROM c
""")
def _(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    texts = F.transform("x", lambda v: v["text"])
    return rows.select("conv_id", F.md5(U.reader_prompt(F.col("x")[0]["text"], texts).cast("binary")).alias("prompt"))


@R.add("h1_proposition_ids", f"WITH {W.TRIPLES} SELECT s, r, o, count(DISTINCT passage) AS support, md5('{{\"object\": \"' || o || '\", \"relation\": \"' || r || '\", \"subject\": \"' || s || '\"}}') AS h FROM tr GROUP BY s, r, o")
def _(t: Tables) -> DataFrame:
    text = F.format_string('{"object": "%s", "relation": "%s", "subject": "%s"}', "o", "r", "s")
    return W.triples(t).groupBy("s", "r", "o").agg(F.countDistinct("passage").alias("support")).withColumn("h", F.md5(text.cast("binary")))


@R.add("h2_proposition_texts", f"""
    WITH {W.TRIPLES}, g AS (SELECT s, r, o, count(DISTINCT passage) AS n FROM tr GROUP BY ALL)
    SELECT s, o, 'Proposition: ' || s || ' ' || r || ' ' || o || chr(10) || 'Relation: ' || r || chr(10) || 'Subject: ' || s || chr(10) || 'Object: ' || o || chr(10) || 'Support Count: ' || n || chr(10) || 'Evidence:' || chr(10) || '1. ' || s || ' says' AS text FROM g
""")
def _(t: Tables) -> DataFrame:
    g = places(t).groupBy("s", "r", "o").agg(F.countDistinct("passage").alias("n"))
    snippets = F.array(F.concat(F.col("s"), F.lit("  says ")), F.lit(" "), F.concat(F.col("s"), F.lit(" says")))
    return g.select("s", "o", U.proposition_text(F.col("s"), F.col("r"), F.col("o"), F.col("n"), snippets).alias("text"))


RERANK = "k AS (SELECT q, doc, sum(score) AS s FROM ch GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, doc) AS pos FROM k), m AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY (doc * 11 + q) % 13, doc) - 1 AS rr FROM c WHERE pos <= 8)"


@R.add("r11_rerank_mix", f"""
    WITH {W.CH}, {RERANK}, x AS (SELECT k.q, k.doc, CASE WHEN max(k.s) OVER w > min(k.s) OVER w THEN (k.s - min(k.s) OVER w) / (max(k.s) OVER w - min(k.s) OVER w) ELSE 1 END AS base, coalesce(1 - 0.75::DOUBLE * rr / 7, 0) AS sig FROM k LEFT JOIN m ON m.q = k.q AND m.doc = k.doc WINDOW w AS (PARTITION BY k.q)),
    y AS (SELECT q, doc, 0.4::DOUBLE * base + 0.6::DOUBLE * sig AS z FROM x) SELECT q, doc, round(CASE WHEN max(z) OVER v > min(z) OVER v THEN (z - min(z) OVER v) / (max(z) OVER v - min(z) OVER v) ELSE 1 END, 6) AS score FROM y WINDOW v AS (PARTITION BY q)
""")
def _(t: Tables) -> DataFrame:
    from lanternfold.operators.ranking import min_max

    sums = W.channels(t).groupBy("q", "doc").agg(F.sum("score").alias("s"))
    head = top_k(sums, ["q"], [F.desc(F.round("s", 9)), "doc"], 8, "pos")
    order = ranked(head.withColumn("key", (F.col("doc") * 11 + F.col("q")) % 13), ["q"], ["key", "doc"], "place").select("q", "doc", (1 - 0.75 * (F.col("place") - 1) / 7).alias("sig"))
    base = sums.withColumn("base", min_max(F.col("s"), ["q"])).join(order, ["q", "doc"], "left")
    mixed = base.withColumn("z", 0.4 * F.col("base") + 0.6 * F.coalesce("sig", F.lit(0.0)))
    return mixed.withColumn("score", F.round(min_max_zero_safe(F.col("z"), ["q"]), 6)).select("q", "doc", "score")


@R.add("r12_query_view_weights", """
    WITH v AS (SELECT conv_id AS q, lower(trim(text)) AS view, role, (1 + turn % 5) / 5.0 AS conf FROM conversations), b AS (SELECT q, view, max(conf) AS conf, arg_max(role, conf) AS role FROM (SELECT * FROM v ORDER BY q) GROUP BY q, view),
    w AS (SELECT q, view, greatest(0.35::DOUBLE, least(conf, 1)) AS w FROM b) SELECT q, md5(view) AS view, round(w / sum(w) OVER (PARTITION BY q), 6) AS weight FROM w
""")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    views = t.conversations.groupBy(F.col("conv_id").alias("q"), F.lower(F.trim("text")).alias("view")).agg(F.max((1 + F.col("turn") % 5) / 5.0).alias("conf"))
    w = F.greatest(F.lit(0.35), F.least("conf", F.lit(1.0)))
    return views.withColumn("w", w).select("q", F.md5(F.col("view").cast("binary")).alias("view"), F.round(F.col("w") / F.sum("w").over(Window.partitionBy("q")), 6).alias("weight"))


@R.add("a13_title_counts", r"WITH t AS (SELECT lower(trim(split_part(text, ' ', 1))) AS title FROM documents) SELECT title, count(*) AS n FROM t WHERE title <> '' GROUP BY title")
def _(t: Tables) -> DataFrame:
    return t.documents.select(F.lower(F.trim(F.substring_index("text", " ", 1))).alias("title")).where("title <> ''").groupBy("title").agg(F.count("*").alias("n"))


@R.add("g15_missing_entities", f"WITH {W.TRIPLES}, k AS (SELECT DISTINCT lower(n_name) AS e FROM nation) SELECT x AS entity, count(DISTINCT passage) AS passages FROM (SELECT passage, unnest([s, o]) AS x FROM tr) WHERE x NOT IN (SELECT e FROM k) GROUP BY x")
def _(t: Tables) -> DataFrame:
    known = t.nation.select(F.lower("n_name").alias("entity")).distinct()
    return G.mentions(places(t)).join(known, "entity", "left_anti").groupBy("entity").agg(F.countDistinct("passage").alias("passages"))


@R.add("p7_role_projection", f"""
    WITH {W.CH}, h AS (SELECT q, doc, max(score) AS s FROM ch GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, doc) AS k FROM h)
    SELECT q, doc % 12 AS passage, round(max(s), 6) AS score FROM t WHERE k <= 12 GROUP BY ALL
""")
def _(t: Tables) -> DataFrame:
    best = W.channels(t).groupBy("q", "doc").agg(F.max("score").alias("s"))
    return top_k(best, ["q"], [F.desc(F.round("s", 9)), "doc"], 12).groupBy("q", (F.col("doc") % 12).alias("passage")).agg(F.round(F.max("s"), 6).alias("score"))


@R.add("c13_admission_dispatch", f"WITH {W.CH}, {W.pool_sql('a', 12)}, {W.pool_sql('b', 8)} SELECT 'deep' AS policy, q, count(*) AS n FROM a GROUP BY q UNION ALL SELECT 'shallow', q, count(*) FROM b GROUP BY q")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    sizes = lambda name, depth: fusion.candidate_pool(ch, "balanced", depth=depth).groupBy("q").agg(F.count("*").alias("n")).select(F.lit(name).alias("policy"), "q", "n")
    return sizes("deep", 12).unionByName(sizes("shallow", 8))


@R.add("j13_candidate_channel_coverage", f"WITH {W.CH}, {W.pool_sql('pool')} SELECT p.q, p.doc, count(DISTINCT channel) AS channels FROM pool p JOIN ch ON ch.q = p.q AND ch.doc = p.doc AND ch.rank <= 12 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    return fusion.balanced_pool(ch).join(ch.where("rank <= 12").select("q", "doc", "channel"), ["q", "doc"]).groupBy("q", "doc").agg(F.countDistinct("channel").alias("channels"))


@R.add("stream_record_upserts", "SELECT 'k' || CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS entity, count(DISTINCT user_id) AS sources, count(*) AS support, max(event_id) AS last_seen FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from lanternfold.plans.graph_plans import _checkpoints
    from lanternfold.streaming import continual

    _checkpoints(t)
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{t.sf_dir}/events*.parquet")
    rows = stream.select(F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("entity"), F.col("user_id").alias("source"), F.col("event_id").alias("step"), F.lit(1).cast("long").alias("n"))
    return continual.run_to_end(rows, f"{t.spark.conf.get('spark.checkpoint.dir').rstrip('/')}/lanternfold")


@R.add("stream_windowed_activity", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    from lanternfold.streaming import continual

    return continual.windowed_activity(t.events).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


