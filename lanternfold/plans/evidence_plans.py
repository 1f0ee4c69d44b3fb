"""Queries of endpoint ranking, fact filters, reading order, and of graphs and reports on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.operators import evidence as E
from lanternfold.operators import fusion
from lanternfold.operators import graph as G
from lanternfold.operators.ranking import top_k
from lanternfold.plans import worlds as W
from lanternfold.plans.graph_plans import FE, _checkpoints
from lanternfold.registry import Registry, Tables
from lanternfold.sources import graphs

R = Registry()


def _folder(t: Tables) -> str:
    """A new path in the folder that the session shares."""
    _checkpoints(t)
    return f"{t.spark.conf.get('spark.checkpoint.dir').rstrip('/')}/lanternfold/{uuid.uuid4().hex[:12]}"


@R.add("r7_endpoint_documents", f"""
    WITH {W.TRIPLES}, en AS (SELECT DISTINCT passage, unnest([s, o]) AS e FROM tr), n AS (SELECT count(DISTINCT passage) AS n FROM en), ei AS (SELECT e, ln((n + 1) / (count(*) + 0.5::DOUBLE)) + 1 AS idf FROM en, n GROUP BY e, n),
    et AS (SELECT e, unnest(list_distinct(string_split(e, ' '))) AS token FROM (SELECT DISTINCT e FROM en)), dt AS (SELECT DISTINCT passage, token FROM en JOIN et USING (e)), ti AS (SELECT token, ln((n + 1) / (count(*) + 0.5::DOUBLE)) + 1 AS idf FROM dt, n GROUP BY token, n),
    qs AS (SELECT n_nationkey AS q, unnest(list_distinct(string_split(lower(n_name), ' '))) AS token FROM nation), hit AS (SELECT DISTINCT q, e FROM qs JOIN et USING (token)),
    al AS (SELECT q, passage, idf FROM hit JOIN en USING (e) JOIN ei USING (e) UNION ALL SELECT q, passage, idf FROM qs JOIN dt USING (token) JOIN ti USING (token)),
    sc AS (SELECT q, passage, round(sum(idf), 9) AS score FROM al GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, passage) AS rank FROM sc)
    SELECT q, passage AS doc, round(score, 5) AS score, rank FROM k WHERE rank <= 20
""")
def _(t: Tables) -> DataFrame:
    endpoints = G.mentions(W.triples(t)).select(F.col("passage").alias("doc"), F.col("entity").alias("endpoint"))
    tokens = endpoints.select("endpoint").distinct().select("endpoint", F.explode(F.array_distinct(F.split("endpoint", " "))).alias("token"))
    asked = t.nation.select(F.col("n_nationkey").alias("q"), F.explode(F.array_distinct(F.split(F.lower("n_name"), " "))).alias("token"))
    return E.endpoint_documents(asked, endpoints, tokens).withColumn("score", F.round("score", 5))


#: five facts a question by score, and what a filter says of them: some names are misspelt, every third question gets none
CANDIDATES = """sc AS (SELECT q, doc, max(score) AS score FROM ch GROUP BY ALL), ca AS (SELECT q, doc AS fact, 'fact ' || doc AS text, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS place FROM sc QUALIFY place <= 5),
    na AS (SELECT q, 6 - place AS ord, CASE WHEN fact % 4 = 0 THEN text ELSE replace(text, 'fact', 'fakt') END AS text FROM ca WHERE q % 3 <> 0 AND fact % 2 = 0)"""
FILTERED = """ne AS (SELECT ca.q, ord, arg_min(fact, levenshtein(ca.text, {0}.text) * 100 + place) AS fact FROM ca JOIN {0} USING (q) GROUP BY ca.q, ord), o AS (SELECT q, fact, min(ord) AS ord, false AS fallback FROM ne GROUP BY ALL),
    al AS (SELECT * FROM o UNION ALL SELECT q, fact, place, true FROM ca WHERE q NOT IN (SELECT q FROM o)), fi AS (SELECT q, fact, row_number() OVER (PARTITION BY q ORDER BY ord, fact) AS rank, fallback FROM al QUALIFY rank <= 5)"""


def _filter_request(t: Tables) -> tuple[DataFrame, DataFrame]:
    scored = W.channels(t).groupBy("q", "doc").agg(F.max("score").alias("score"))
    candidates = top_k(scored, ["q"], [F.desc("score"), "doc"], 5, "place").select("q", F.col("doc").alias("fact"), F.concat(F.lit("fact "), F.col("doc").cast("string")).alias("text"), "place")
    said = F.when(F.col("fact") % 4 == 0, F.col("text")).otherwise(F.replace("text", F.lit("fact"), F.lit("fakt")))
    return candidates, candidates.where("q % 3 <> 0 and fact % 2 = 0").select("q", (6 - F.col("place")).alias("at"), said.alias("text"))


@R.add("r9_fact_filter", f"WITH {W.CH}, {CANDIDATES}, {FILTERED.format('na')} SELECT * FROM fi")
def _(t: Tables) -> DataFrame:
    return E.filtered_facts(*_filter_request(t))


@R.add("r10_cached_fact_filter", f"WITH {W.CH}, {CANDIDATES}, hc AS (SELECT * FROM na WHERE q % 2 = 0), {FILTERED.format('hc')} SELECT fi.*, q IN (SELECT q FROM hc) AS cached FROM fi")
def _(t: Tables) -> DataFrame:
    candidates, named = _filter_request(t)
    questions = candidates.select("q").distinct().withColumn("question", F.concat(F.lit("question "), F.col("q").cast("string")))
    # a cache that an earlier run wrote for the even questions
    cache = E.filter_keys(questions.where("q % 2 = 0"), candidates).join(named, "q").select("key", "at", "text")
    return E.filtered_facts_cached(questions, candidates, cache)


@R.add("k17_reading_order", f"""
    WITH {W.CH}, {W.pool_sql('pool')}, {W.GOLD}, sc AS (SELECT q, doc, max(score) AS score FROM ch GROUP BY ALL), an AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY doc) AS rank FROM gold),
    x AS (SELECT pool.q, pool.doc, an.rank AS ar, round(1.25::DOUBLE * (pool.doc % 5) + 0.65::DOUBLE * ln(1 + greatest(score, 0)) + 1.15::DOUBLE * ln(1 + pool.doc % 3) + 1.35::DOUBLE * (pool.doc % 2) + 1.05::DOUBLE * (pool.doc % 7) / 7 + 0.75::DOUBLE * (pool.q % 2) + 0.65::DOUBLE * (pool.doc % 4) / 4, 9) AS s
      FROM pool JOIN sc USING (q, doc) LEFT JOIN an USING (q, doc))
    SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY ar NULLS LAST, CASE WHEN ar IS NULL THEN -s END, doc) AS pos FROM x
""")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    d, q = F.col("doc"), F.col("q")
    pool = fusion.balanced_pool(ch).join(ch.groupBy("q", "doc").agg(F.max("score").alias("bm25")), ["q", "doc"])
    rows = pool.select("q", "doc", "bm25", (d % 5).alias("coverage"), (d % 3).alias("link"), (d % 2).alias("anchor"), (d % 7 / 7).alias("specificity"), (q % 2).alias("support"), (d % 4 / 4).alias("neighbourhood"))
    return E.reading_order(rows, top_k(W.gold(ch), ["q"], ["doc"], 1 << 20, "rank"))


@R.add("s9_saved_graph", f"WITH {W.TRIPLES}, {FE} SELECT * FROM fe")
def _(t: Tables) -> DataFrame:
    path = _folder(t)
    graphs.save_graph(G.fact_edges(W.triples(t)), path)
    return graphs.load_graph(t.spark, path)[1]


@R.add("s11_solutions_of_a_report", f"WITH {W.CH}, p AS (SELECT q, channel, row_number() OVER (ORDER BY q, channel) - 1 AS place FROM (SELECT DISTINCT q, channel FROM ch)) SELECT 'question ' || q || ' ' || channel AS question, place, doc, score, rank FROM ch JOIN p USING (q, channel)")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    lists = ch.groupBy("q", "channel").agg(F.sort_array(F.collect_list(F.struct("rank", "doc", "score"))).alias("r"))
    solution = F.struct(F.concat_ws(" ", F.lit("question"), F.col("q").cast("string"), "channel").alias("question"), F.col("r.doc").alias("doc_indices"), F.col("r.score").alias("doc_scores"))
    # a report is one JSON value by its format, so its rankings are one row of the file that is made here
    report = lists.groupBy().agg(F.sort_array(F.collect_list(F.struct("q", "channel", solution.alias("s")))).alias("a")).select(F.col("a.s").alias("query_solutions"), F.array(F.lit("trace")).alias("head_traces"))
    path = _folder(t)
    report.write.json(path)
    return graphs.read_solutions(t.spark, path)
