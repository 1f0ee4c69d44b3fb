"""Queries of dense and lexical retrieval: vectors against vectors, benchmark items against documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.functions import text as T
from lanternfold.operators import lexical as L
from lanternfold.operators import vector as V
from lanternfold.operators.ranking import top_k
from lanternfold.plans import worlds as W
from lanternfold.plans.text_plans import NORM, STOP
from lanternfold.registry import Registry, Tables

R = Registry()

SC = f"sc AS (SELECT q.vec_id AS q, k.vec_id AS id, {W.DOT.format('q', 'k')} AS score FROM embeddings q CROSS JOIN embeddings k WHERE q.{W.VEC_Q})"
MM = "mm AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS norm FROM sc WINDOW w AS (PARTITION BY q))"


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    keys = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return keys.where("id % 100 = 0"), keys


@R.add("j6_dense_scores", f"WITH {SC} SELECT q, id, round(score, 6) AS score FROM sc")
def _(t: Tables) -> DataFrame:
    return V.dense_scores(*sides(t)).withColumn("score", F.round("score", 6))


@R.add("r1_fact_scores", f"WITH {SC}, {MM}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(norm, 9) DESC, id) AS rank FROM mm) SELECT q, id, round(norm, 6) AS norm, rank FROM r WHERE rank <= 5")
def _(t: Tables) -> DataFrame:
    return V.ranking(V.dense_scores(*sides(t)), 5).select("q", "id", F.round("norm", 6).alias("norm"), "rank")


@R.add("r2_dense_passage_retrieval", f"WITH {SC}, {MM}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(norm, 9) DESC, id) AS rank FROM mm) SELECT q, id, round(norm, 6) AS norm, rank FROM r")
def _(t: Tables) -> DataFrame:
    return V.ranking(V.dense_scores(*sides(t)), 1 << 40).select("q", "id", F.round("norm", 6).alias("norm"), "rank")


@R.add("r3_zero_safe_scores", f"WITH {SC}, z AS (SELECT q, id, greatest(score, 0) * (id % 2) AS score FROM sc) SELECT q, id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) WHEN max(score) OVER w = 0 THEN 0 ELSE 1 END, 6) AS norm FROM z WINDOW w AS (PARTITION BY q)")
def _(t: Tables) -> DataFrame:
    scores = V.dense_scores(*sides(t)).withColumn("score", F.greatest("score", F.lit(0.0)) * (F.col("id") % 2))
    return V.normalised_scores(scores, zero_safe=True).select("q", "id", F.round("norm", 6).alias("norm"))


@R.add("r5_knn", f"WITH {SC}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM sc) SELECT q, id, round(score, 5) AS score, rank FROM r WHERE rank <= 10")
def _(t: Tables) -> DataFrame:
    return V.dense_scores(*sides(t), k=10).select("q", "id", F.round("score", 5).alias("score"), "rank")


@R.add("f29_cosine", f"SELECT q.vec_id AS q, k.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings k ON q.label = k.label WHERE q.{W.VEC_Q}")
def _(t: Tables) -> DataFrame:
    q = t.embeddings.where(W.VEC_Q).select(F.col("vec_id").alias("q"), F.col("embedding").alias("a"), "label")
    return q.join(t.embeddings, "label").select("q", F.col("vec_id").alias("id"), F.round(V.cosine(F.col("a"), F.col("embedding")), 6).alias("cosine"))


@R.add("a15_multiview_scores", f"""
    WITH {SC}, l AS (SELECT s.q, s.id, e.label % 3 AS view, s.score FROM sc s JOIN embeddings e ON e.vec_id = s.q), v AS (SELECT q % 300 AS q, q AS view_q, id, score FROM sc),
    w AS (SELECT q, id, max(score) AS most, avg(score) AS mean, sum(score / (1 + view_q // 300)) AS weighted FROM v GROUP BY q, id)
    SELECT q, id, round(most, 6) AS most, round(mean, 6) AS mean, round(0.35::DOUBLE * most + 0.65::DOUBLE * weighted, 6) AS mixed FROM w
""")
def _(t: Tables) -> DataFrame:
    scores = V.dense_scores(*sides(t)).select((F.col("q") % 300).alias("q"), F.expr("q div 300").alias("view"), "id", "score")
    views = scores.select("view").distinct().withColumn("w", 1.0 / (1 + F.col("view")))
    return V.multiview(scores, views).select("q", "id", *[F.round(c, 6).alias(c) for c in ("most", "mean", "mixed")])


TOK = f"list_distinct(list_filter(string_split({NORM.format('{0}')}, ' '), lambda x: length(x) >= 3 AND x NOT IN ({STOP})))"
UNITS = f"""ln AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS unit FROM documents),
    u AS (SELECT doc, unit, unnest({TOK.format('line')}) AS token FROM ln), po AS (SELECT doc, token, count(*) AS tf FROM u GROUP BY ALL), dl AS (SELECT doc, sum(tf) AS dl FROM po GROUP BY doc),
    nn AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM dl), df AS (SELECT token, count(*) AS df, ln(1 + ((SELECT docs FROM nn) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM po GROUP BY token),
    qt AS (SELECT item_id AS q, unnest({TOK.format('text')}) AS token FROM benchmark)"""
BM = "bm AS (SELECT q, po.doc, sum(idf * tf * 2.2::DOUBLE / greatest(tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM nn)), 1e-9)) AS score FROM qt JOIN df USING (token) JOIN po USING (token) JOIN dl ON dl.doc = po.doc GROUP BY ALL)"


def units(t: Tables) -> DataFrame:
    lines = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("unit", "line"))
    return L.token_rows(lines, ["doc", "unit"], "line").drop("n")


def asked(t: Tables) -> DataFrame:
    return L.token_rows(t.benchmark.select(F.col("item_id").alias("q"), "text"), ["q"]).drop("n")


@R.add("a8_corpus_statistics", f"WITH {UNITS} SELECT token, df, round(idf, 6) AS idf, CAST((SELECT sum(tf) FROM po p WHERE p.token = df.token) AS BIGINT) AS units FROM df")
def _(t: Tables) -> DataFrame:
    postings, frequencies, _ = L.corpus_statistics(units(t))
    return frequencies.join(postings.groupBy("token").agg(F.sum("tf").alias("units")), "token").select("token", "df", F.round("idf", 6).alias("idf"), "units")


@R.add("a9_idf_of_covered_tokens", f"WITH {UNITS}, m AS (SELECT q, po.doc, sum(coalesce(idf, 1)) AS mass FROM qt JOIN po USING (token) LEFT JOIN df USING (token) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(mass, 9) DESC, doc) AS rank FROM m) SELECT q, doc, round(mass, 6) AS mass FROM r WHERE rank <= 10")
def _(t: Tables) -> DataFrame:
    postings, frequencies, _ = L.corpus_statistics(units(t))
    mass = L.covered_idf(asked(t), postings.select("doc", "token"), frequencies.select("token", "idf"))
    return top_k(mass, ["q"], [F.desc(F.round("mass", 9)), "doc"], 10).select("q", "doc", F.round("mass", 6).alias("mass"))


@R.add("r4_bm25", f"WITH {UNITS}, {BM}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM bm WHERE score > 0) SELECT q, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def _(t: Tables) -> DataFrame:
    return top_k(L.bm25(asked(t), units(t)), ["q"], [F.desc(F.round("score", 9)), "doc"], 10).select("q", "doc", F.round("score", 6).alias("score"), "rank")


@R.add("r4_bm25_with_title", f"""
    WITH {UNITS}, {BM}, tt AS (SELECT doc, token FROM u WHERE unit = 1), b AS (SELECT q, tt.doc, 1.25::DOUBLE * sum(idf) AS bonus FROM qt JOIN tt USING (token) JOIN df USING (token) GROUP BY ALL),
    s AS (SELECT coalesce(bm.q, b.q) AS q, coalesce(bm.doc, b.doc) AS doc, coalesce(score, 0) + coalesce(bonus, 0) AS score FROM bm FULL JOIN b ON bm.q = b.q AND bm.doc = b.doc),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM s) SELECT q, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10
""")
def _(t: Tables) -> DataFrame:
    u, q = units(t), asked(t)
    scored = L.with_title(L.bm25(q, u), q, u.where("unit = 0").select("doc", "token"), L.query_statistics(q, u)[1])
    return top_k(scored, ["q"], [F.desc(F.round("score", 9)), "doc"], 10).select("q", "doc", F.round("score", 6).alias("score"), "rank")


EP = f"ends AS (SELECT DISTINCT lower(p_type) AS endpoint FROM part UNION SELECT DISTINCT lower(p_name) FROM part UNION SELECT lower(n_name) FROM nation), et AS (SELECT endpoint, unnest({TOK.format('endpoint')}) AS token FROM ends)"
EQ = f"eq AS (SELECT p_partkey AS q, unnest({TOK.format("p_name || ' ' || p_type || ' from ' || n_name")}) AS token FROM part JOIN nation ON n_nationkey = p_partkey % 25)"


@R.add("r8_grounded_endpoints", f"""
    WITH {EP}, {EQ}, sz AS (SELECT endpoint, count(*) AS n FROM et GROUP BY endpoint), hit AS (SELECT q, endpoint, any_value(n) AS n FROM eq JOIN et USING (token) JOIN sz USING (endpoint) GROUP BY q, endpoint HAVING count(*) = any_value(n)),
    ins AS (SELECT h.q, h.endpoint FROM hit h JOIN et a ON a.endpoint = h.endpoint JOIN hit w ON w.q = h.q AND w.n > h.n JOIN et b ON b.endpoint = w.endpoint AND b.token = a.token GROUP BY h.q, h.endpoint, h.n, w.endpoint HAVING count(*) = h.n)
    SELECT q, endpoint, n FROM hit WHERE (q, endpoint) NOT IN (SELECT (q, endpoint) FROM ins)
""")
def _(t: Tables) -> DataFrame:
    ends = t.part.select(F.lower("p_type").alias("endpoint")).union(t.part.select(F.lower("p_name"))).union(t.nation.select(F.lower("n_name"))).distinct()
    tokens = L.token_rows(ends, ["endpoint"], "endpoint").drop("n")
    text = F.concat_ws(" ", "p_name", "p_type", F.lit("from"), "n_name")
    asked_parts = t.part.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("p_partkey") % 25).select(F.col("p_partkey").alias("q"), text.alias("text"))
    return L.grounded_endpoints(L.token_rows(asked_parts, ["q"]).drop("n"), tokens)


@R.add("r6_symbol_candidates", f"""
    WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ({STOP})) AS ws FROM benchmark),
    p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 0) + 1), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))) AS phrase FROM w),
    d AS (SELECT doc_id, length(text) AS n, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ({STOP})) AS ws FROM documents),
    e AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, greatest(len(ws) - 3, 0) + 1), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))) AS phrase FROM d),
    s AS (SELECT item_id AS q, doc_id AS doc, any_value(n) AS n, round(2.5 * count(*), 6) AS score FROM p JOIN e USING (phrase) GROUP BY ALL), r AS (SELECT q, doc, score::DOUBLE AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, n, doc DESC) AS rank FROM s)
    SELECT * FROM r WHERE rank <= 5
""")
def _(t: Tables) -> DataFrame:
    def phrases(df: DataFrame, keep: list[str]) -> DataFrame:
        raw = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) >= 4) & ~x.isin(*T.STOPWORDS))
        grams = F.transform(F.array(raw), lambda ws: F.when(F.size(ws) >= 4, F.transform(F.sequence(F.lit(1), F.size(ws) - 3), lambda i: F.array_join(F.slice(ws, i, F.lit(4)), " "))))[0]
        return df.select(*keep, F.explode(grams).alias("phrase")).distinct()

    asked_phrases = phrases(t.benchmark.withColumnRenamed("item_id", "q"), ["q"])
    held = phrases(t.documents.select(F.col("doc_id").alias("doc"), F.length("text").alias("n"), "text"), ["doc", "n"])
    scored = asked_phrases.join(held, "phrase").groupBy("q", "doc", "n").agg(F.round(2.5 * F.count("*"), 6).alias("score"))
    return top_k(scored, ["q"], [F.desc("score"), "n", F.desc("doc")], 5).select("q", "doc", "score", "rank")
