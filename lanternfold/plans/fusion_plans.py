"""Queries of fusion, candidate pools, selection and evaluation over the channels of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.operators import evaluate, fusion, ranking, roles, selection
from lanternfold.plans import worlds as W
from lanternfold.registry import Registry, Tables

R = Registry()
CH = W.CH
POOL = W.pool_sql("pool")


def pools(t: Tables) -> tuple[DataFrame, DataFrame]:
    ch = W.channels(t)
    return ch, fusion.balanced_pool(ch)


@R.add("w1_unique_preserve_order", f"WITH {CH}, f AS (SELECT *, row_number() OVER (PARTITION BY q, channel, doc ORDER BY rank) AS k FROM ch) SELECT q, channel, doc, row_number() OVER (PARTITION BY q, channel ORDER BY rank) AS pos FROM f WHERE k = 1")
def _(t: Tables) -> DataFrame:
    first = ranking.first_of_each(W.channels(t), ["q", "channel"], ["doc"], ["rank"])
    return ranking.ranked(first, ["q", "channel"], ["rank"], "pos").select("q", "channel", "doc", "pos")


@R.add("w2_top_k", f"WITH {CH} SELECT q, channel, doc, rank FROM ch WHERE rank <= 5")
def _(t: Tables) -> DataFrame:
    ev = t.events.select(F.col("user_id").alias("q"), F.col("event_type").alias("channel"), (F.col("event_id") % 97).alias("doc"), "event_id", "value")
    return ranking.top_k(ev, ["q", "channel"], [F.desc("value"), "event_id"], 5).select("q", "channel", "doc", "rank")


@R.add("w4_rank_prior", f"WITH {CH} SELECT q, channel, doc, rank, round(2.0 / sqrt(rank), 6) AS prior FROM ch")
def _(t: Tables) -> DataFrame:
    return W.channels(t).select("q", "channel", "doc", "rank", F.round(ranking.rank_prior(F.col("rank"), 2.0), 6).alias("prior"))


@R.add("w7_first_exposure", f"WITH {CH}, m AS (SELECT q, doc, min(cpos * 1000000 + rank) AS seen FROM ch GROUP BY q, doc) SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY seen) AS seen_order FROM m")
def _(t: Tables) -> DataFrame:
    seen = W.channels(t).groupBy("q", "doc").agg(F.min(F.struct("cpos", "rank")).alias("seen"))
    return ranking.ranked(seen, ["q"], ["seen"], "seen_order").select("q", "doc", "seen_order")


@R.add("w8_local_neighbours", """
    WITH d AS (SELECT DISTINCT user_id AS q, event_id % 97 AS doc FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY doc) AS p FROM d),
    n AS (SELECT a.q, a.doc, b.doc AS other, abs(a.p - b.p) * 2 - CASE WHEN b.p < a.p THEN 1 ELSE 0 END AS k FROM o a JOIN o b ON a.q = b.q AND a.p <> b.p AND abs(a.p - b.p) <= 2)
    SELECT q, doc, string_agg(CAST(other AS VARCHAR), ',' ORDER BY k) AS neighbours FROM n GROUP BY q, doc
""")
def _(t: Tables) -> DataFrame:
    docs = t.events.select(F.col("user_id").alias("q"), (F.col("event_id") % 97).alias("doc")).distinct()
    w = Window.partitionBy("q").orderBy("doc")
    near = docs.select("q", "doc", F.array_join(F.array(*[f("doc", n).over(w).cast("string") for n in (1, 2) for f in (F.lag, F.lead)]), ",").alias("neighbours"))
    return near.where("neighbours <> ''")


@R.add("w9_best_by_key", f"WITH {CH}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, cpos, rank) AS k FROM ch) SELECT q, channel, doc, round(score, 6) AS score FROM r WHERE k = 1")
def _(t: Tables) -> DataFrame:
    best = W.channels(t).groupBy("q").agg(F.max_by(F.struct("channel", "doc", "score"), F.struct("score", -F.col("cpos"), -F.col("rank"))).alias("b"))
    return best.select("q", "b.channel", "b.doc", F.round("b.score", 6).alias("score"))


@R.add("f25_min_max_normalize", f"""
    WITH {CH}, {W.NORMED}, m AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS mm FROM nm WINDOW w AS (PARTITION BY q, channel))
    SELECT q, channel, rank, round(mm, 6) AS mm, round(norm, 6) AS norm FROM m
""")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    both = ranking.rank_scores(ch, ["q", "channel"], "rank", "score").withColumn("mm", ranking.min_max(F.col("score"), ["q", "channel"]))
    return both.select("q", "channel", "rank", F.round("mm", 6).alias("mm"), F.round("norm", 6).alias("norm"))


@R.add("f27_concentration", f"WITH {CH} SELECT q, channel, round(max(score) / (avg(score) + 1e-8), 6) AS concentration FROM ch WHERE rank <= 5 GROUP BY q, channel")
def _(t: Tables) -> DataFrame:
    return ranking.concentration(W.channels(t), ["q", "channel"], "score").withColumn("concentration", F.round("concentration", 6))


@R.add("c1_reciprocal_rank_fusion", f"""
    WITH {CH}, o AS (SELECT q, cpos, doc, min(rank) AS rank FROM ch GROUP BY ALL),
    f AS (SELECT q, doc, round(sum(1.0 / (60 + rank)), 9) AS score, min(cpos * 1000000 + rank) AS seen FROM o GROUP BY q, doc), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, seen, doc) AS pos FROM f)
    SELECT q, doc, round(score, 6) AS score, pos FROM p WHERE pos <= 50
""")
def _(t: Tables) -> DataFrame:
    return fusion.fuse(W.channels(t), "rrf").withColumn("score", F.round("score", 6))


@R.add("c2_round_robin", f"""
    WITH {CH}, f AS (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY rank, cpos) AS k FROM ch), p AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY rank, cpos) AS pos FROM f WHERE k = 1)
    SELECT q, doc, pos, round(1 - (pos - 1) / count(*) OVER (PARTITION BY q), 6) AS score FROM p WHERE pos <= 20
""")
def _(t: Tables) -> DataFrame:
    return fusion.fuse(W.channels(t), "round_robin", 20).withColumn("score", F.round("score", 6))


@R.add("c3_best_channel_first", f"""
    WITH {CH}, b AS (SELECT *, max(score) OVER (PARTITION BY q, channel) AS best FROM ch), f AS (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY best DESC, cpos, rank) AS k FROM b),
    p AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY best DESC, cpos, rank) AS pos FROM f WHERE k = 1) SELECT * FROM p WHERE pos <= 20
""")
def _(t: Tables) -> DataFrame:
    return fusion.fuse(W.channels(t), "best_channel_first", 20)


@R.add("c4_pointwise_role_score", f"""
    WITH {CH}, {W.NORMED}, f AS (SELECT q, doc, round(sum(norm), 9) AS score, round(max(norm), 9) AS top, min(cpos * 1000000 + rank) AS seen FROM nm GROUP BY q, doc),
    p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, top DESC, seen, doc) AS pos FROM f) SELECT q, doc, round(score, 6) AS score, pos FROM p WHERE pos <= 20
""")
def _(t: Tables) -> DataFrame:
    return fusion.fuse(W.channels(t), "pointwise", 20).withColumn("score", F.round("score", 6))


@R.add("c6_channel_balanced_pool", f"WITH {CH}, {POOL} SELECT q, doc, pos FROM pool")
def _(t: Tables) -> DataFrame:
    return pools(t)[1]


@R.add("c6_seeded_pool", f"""
    WITH {CH}, s AS (SELECT DISTINCT q, doc FROM ch WHERE channel = 'view' AND rank <= 2), so AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY doc) - 1000000 AS rank, -1 AS cpos FROM s),
    a AS (SELECT q, doc, rank, cpos FROM ch WHERE rank <= 12 UNION ALL SELECT * FROM so), f AS (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY rank, cpos) AS k FROM a),
    p AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY rank, cpos) AS pos FROM f WHERE k = 1) SELECT * FROM p WHERE pos <= 24
""")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    seeds = ranking.ranked(ch.where("channel = 'view' and rank <= 2").select("q", "doc").distinct(), ["q"], ["doc"])
    return fusion.candidate_pool(ch, "balanced", seeds=seeds)


@R.add("c7_demand_marginal_pool")
def _(t: Tables) -> DataFrame:
    return fusion.candidate_pool(W.channels(t), "demand_marginal")


def _vectors_sql() -> str:
    cols = ", ".join(f"coalesce(min(CASE WHEN cpos = {c} THEN rank END), 13) AS v{c}" for c in range(5))
    return f"vec AS (SELECT q, doc, {cols}, min(rank * 10 + cpos) AS seen FROM ch WHERE rank <= 12 GROUP BY q, doc)"


DOMINATES = " AND ".join(f"b.v{c} <= a.v{c}" for c in range(5)) + " AND (" + " OR ".join(f"b.v{c} < a.v{c}" for c in range(5)) + ")"


def _layers_sql(n: int) -> str:
    steps = []
    for k in range(n):
        done = "".join(f" AND (a.q, a.doc) NOT IN (SELECT (q, doc) FROM l{j})" for j in range(k))
        rest = f"rest{k} AS MATERIALIZED (SELECT a.* FROM vec a WHERE true{done})"
        steps.append(f"{rest}, l{k} AS MATERIALIZED (SELECT a.* FROM rest{k} a WHERE NOT EXISTS (SELECT 1 FROM rest{k} b WHERE b.q = a.q AND {DOMINATES}))")
    union = " UNION ALL ".join(f"SELECT q, doc, {k} AS layer, seen FROM l{k}" for k in range(n))
    return f"{', '.join(steps)}, un AS ({union})"


@R.add("c8_pareto_frontier_pool", f"WITH {CH}, {_vectors_sql()}, {_layers_sql(14)}, p AS (SELECT q, doc, CAST(layer AS BIGINT) AS layer, row_number() OVER (PARTITION BY q ORDER BY layer, seen) AS pos FROM un) SELECT * FROM p WHERE pos <= 24")
def _(t: Tables) -> DataFrame:
    return fusion.candidate_pool(W.channels(t), "pareto")


@R.add("c9_pareto_repair_pool", f"""
    WITH {CH}, {POOL}, {_vectors_sql()}, bad AS (SELECT DISTINCT a.q, a.doc FROM vec a JOIN vec b ON a.q = b.q AND a.doc <> b.doc WHERE {DOMINATES})
    SELECT p.q, p.doc, row_number() OVER (PARTITION BY p.q ORDER BY bad.doc IS NOT NULL, p.pos) AS pos FROM pool p LEFT JOIN bad ON p.q = bad.q AND p.doc = bad.doc
""")
def _(t: Tables) -> DataFrame:
    return fusion.candidate_pool(W.channels(t), "pareto_repair")


@R.add("c10_cross_channel_pool", f"""
    WITH {CH}, {W.pool_sql('b', 8)}, h AS (SELECT q, doc, count(DISTINCT channel) AS n, min(rank * 10 + cpos) AS seen FROM ch WHERE rank <= 16 GROUP BY q, doc),
    a AS (SELECT q, doc, pos FROM b UNION ALL SELECT h.q, h.doc, 1000000 + seen FROM h WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM b WHERE b.q = h.q AND b.doc = h.doc)),
    p AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY pos) AS pos FROM a) SELECT * FROM p WHERE pos <= 24
""")
def _(t: Tables) -> DataFrame:
    return fusion.candidate_pool(W.channels(t), "cross_channel")


@R.add("c11_terminal_pool", f"""
    WITH {CH}, {W.pool_sql('b', 8)}, h AS (SELECT q, doc, min(rank * 10 + cpos) AS seen FROM ch WHERE rank <= 16 AND channel IN ('purchase', 'view') GROUP BY q, doc),
    e AS (SELECT h.*, row_number() OVER (PARTITION BY q ORDER BY seen) AS k FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.q = h.q AND b.doc = h.doc)),
    a AS (SELECT q, doc, pos FROM b UNION ALL SELECT q, doc, 1000000 + seen FROM e WHERE k <= 4), p AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY pos) AS pos FROM a)
    SELECT * FROM p WHERE pos <= 24
""")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    listed = ch.select("q", F.col("channel").alias("role_id"), F.col("cpos").alias("pos")).distinct()
    links = listed.where("role_id in ('click', 'error', 'signup')").select("q", "role_id", F.lit("purchase").alias("to_id"))
    return fusion.candidate_pool(ch, "terminal", terminals=roles.terminal_roles(listed, links).withColumnRenamed("role_id", "channel"))


@R.add("c12_residual_repair_pool", f"""
    WITH {CH}, {POOL}, {W.SEL}, cov AS (SELECT DISTINCT c.q, c.channel FROM ch c JOIN sel s ON c.q = s.q AND c.doc = s.doc WHERE rank <= 12),
    a AS (SELECT q, doc, 0 AS tier, spos AS o FROM sel UNION ALL SELECT q, doc, 1, cpos FROM ch WHERE rank = 1 AND NOT EXISTS (SELECT 1 FROM cov WHERE cov.q = ch.q AND cov.channel = ch.channel) UNION ALL SELECT q, doc, 2, pos FROM pool),
    f AS (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY tier, o) AS k FROM a), p AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY tier, o) AS pos FROM f WHERE k = 1) SELECT * FROM p WHERE pos <= 24
""")
def _(t: Tables) -> DataFrame:
    ch, pool = pools(t)
    chosen = W.selection(pool).withColumnRenamed("spos", "pos")
    return fusion.residual_repair_pool(chosen, ch, pool)


@R.add("c14_rolewise_pool", f"""
    WITH {CH}, f AS (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY cpos, rank) AS k FROM ch WHERE rank <= 5), p AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY cpos, rank) AS pos FROM f WHERE k = 1)
    SELECT * FROM p WHERE pos <= 24
""")
def _(t: Tables) -> DataFrame:
    return fusion.candidate_pool(W.channels(t), "rolewise")


@R.add("c15_proposal_consensus", f"""
    WITH {CH}, w(channel, w) AS (VALUES ('click', 1.0), ('error', 0.5), ('purchase', 2.0), ('signup', 1.5), ('view', 0.25)), o AS (SELECT q, channel, doc, min(rank) AS rank FROM ch GROUP BY ALL),
    f AS (SELECT q, doc, round(sum(w::DOUBLE / (rank + 1)), 9) AS score, count(*) AS n, min(rank) AS best FROM o JOIN w USING (channel) GROUP BY q, doc),
    p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, n DESC, best, doc) AS pos FROM f) SELECT q, doc, round(score, 6) AS score, pos FROM p WHERE pos <= 20
""")
def _(t: Tables) -> DataFrame:
    w = t.spark.createDataFrame([("click", 1.0), ("error", 0.5), ("purchase", 2.0), ("signup", 1.5), ("view", 0.25)], "channel string, w double")
    return fusion.consensus(W.channels(t), 20, w).withColumn("score", F.round("score", 6))


@R.add("c16_channel_profile", f"""
    WITH {CH}, {POOL}, h AS (SELECT q, doc, channel, cpos, min(rank) AS rank FROM ch WHERE rank <= 12 GROUP BY ALL)
    SELECT p.q, p.doc, p.pos, count(*) AS n, min(rank) AS best, string_agg(channel || ':' || rank, ',' ORDER BY cpos) AS channels FROM pool p JOIN h USING (q, doc) GROUP BY ALL
""")
def _(t: Tables) -> DataFrame:
    ch, pool = pools(t)
    return fusion.provenance(ch, pool)


@R.add("c17_shuffled_profile", f"""
    WITH {CH}, {POOL}, m AS (SELECT q, doc AS other, row_number() OVER (PARTITION BY q ORDER BY sha256('13:' || q || ':' || doc)) AS pos FROM pool) SELECT q, doc, other FROM pool JOIN m USING (q, pos)
""")
def _(t: Tables) -> DataFrame:
    return fusion.shuffled_profile(pools(t)[1], 13).select("q", "doc", "other")


def _final_sql(order: str, extra: str = "") -> str:
    return f"WITH {CH}, {POOL}, {W.SEL}, b AS (SELECT p.q, p.doc, p.pos, s.spos FROM pool p LEFT JOIN sel s ON p.q = s.q AND p.doc = s.doc){extra}, f AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY {order}) AS k FROM b) SELECT q, doc, k AS pos FROM f WHERE k <= 5"


@R.add("k1_selector_stable", _final_sql("spos IS NULL, pos"))
def _(t: Tables) -> DataFrame:
    pool = pools(t)[1]
    return selection.evidence_set(pool, W.selection(pool), "selector_stable")


@R.add("k2_rank_product", _final_sql("coalesce(1.0 / (pos * spos), 0) DESC, pos"))
def _(t: Tables) -> DataFrame:
    pool = pools(t)[1]
    return selection.rank_product(pool, W.selection(pool))


ISR = "round(1.0 / (pos * pos) + coalesce(1.0 / (spos * spos), 0), 9) DESC, pos"


@R.add("k3_isr_fusion", _final_sql(ISR))
def _(t: Tables) -> DataFrame:
    pool = pools(t)[1]
    return selection.isr_fusion(pool, W.selection(pool))


@R.add("k4_isr_stable", f"WITH kept AS ({_final_sql(ISR)}), {CH}, {POOL} SELECT p.q, p.doc, row_number() OVER (PARTITION BY p.q ORDER BY p.pos) AS pos FROM kept JOIN pool p USING (q, doc)")
def _(t: Tables) -> DataFrame:
    pool = pools(t)[1]
    return selection.evidence_set(pool, W.selection(pool), "isr_stable")


@R.add("k5_rank_fusion", _final_sql("round(1.0 / (5 + pos) + coalesce(0.5 / (5 + spos), 0), 9) DESC, pos"))
def _(t: Tables) -> DataFrame:
    pool = pools(t)[1]
    return selection.evidence_set(pool, W.selection(pool), "rank_fusion")


def _greedy_sql(rounds: int) -> str:
    """Rounds of greedy channel coverage as chained common table expressions."""
    bits = "h AS (SELECT p.q, p.doc, p.pos, coalesce(bit_or(CASE WHEN c.cpos IS NULL THEN 0 ELSE 1 << c.cpos END), 0) AS m FROM pool p LEFT JOIN ch c ON p.q = c.q AND p.doc = c.doc AND c.rank <= 12 GROUP BY ALL)"
    parts = [bits, "s0 AS (SELECT DISTINCT q, 0 AS cov, CAST([] AS BIGINT[]) AS docs FROM h)"]
    for k in range(rounds):
        parts.append(f"r{k} AS (SELECT h.q, h.doc, s{k}.cov | h.m AS cov, list_append(s{k}.docs, h.doc) AS docs, row_number() OVER (PARTITION BY h.q ORDER BY bit_count(h.m & ~s{k}.cov) DESC, bit_count(h.m) DESC, h.pos) AS k "
                     f"FROM h JOIN s{k} USING (q) WHERE NOT list_contains(s{k}.docs, h.doc)), s{k + 1} AS (SELECT q, cov, docs FROM r{k} WHERE k = 1 UNION ALL SELECT * FROM s{k} WHERE q NOT IN (SELECT q FROM r{k}))")  # fmt: skip
    return ", ".join(parts) + f" SELECT q, unnest(docs) AS doc, generate_subscripts(docs, 1) AS pos FROM s{rounds}"


@R.add("k7_channel_coverage_greedy", f"WITH {CH}, {POOL}, {_greedy_sql(5)}")
def _(t: Tables) -> DataFrame:
    ch, pool = pools(t)
    return selection.coverage_greedy(ch, pool)


def _scores(t: Tables) -> tuple[DataFrame, DataFrame]:
    ch, pool = pools(t)
    base = pool.withColumn("score", 1.0 / F.col("pos"))
    return base, selection.role_scores_from_ranks(ch, pool)


ROLE = f"{CH}, {POOL}, {W.NORMED}, ro AS (SELECT DISTINCT q, channel FROM ch), ns AS (SELECT q, channel, doc, max(norm) AS s FROM nm GROUP BY ALL), rs AS (SELECT p.q, p.doc, ro.channel AS role, coalesce(ns.s, 0) AS s FROM pool p JOIN ro USING (q) LEFT JOIN ns ON ns.q = p.q AND ns.channel = ro.channel AND ns.doc = p.doc)"


@R.add("k8_role_coverage_greedy")
def _(t: Tables) -> DataFrame:
    base, scores = _scores(t)
    return selection.role_coverage(base, scores)


@R.add("k8_coverage_value", f"""
    WITH {ROLE}, {W.SEL}, m AS (SELECT q, role, max(s) AS m FROM rs JOIN sel USING (q, doc) GROUP BY ALL), c AS (SELECT q, sum(m) AS cover FROM m GROUP BY q), r AS (SELECT q, sum(1.0 / pos) AS rel FROM sel JOIN pool USING (q, doc) GROUP BY q)
    SELECT q, round(coalesce(cover, 0) + 0.1::DOUBLE * rel, 6) AS value FROM r LEFT JOIN c USING (q)
""")
def _(t: Tables) -> DataFrame:
    base, scores = _scores(t)
    return selection.coverage_value(W.selection(base.select("q", "doc", "pos")).select("q", "doc"), scores, base, 0.1).withColumn("value", F.round("value", 6))


@R.add("k9_residual_optimum")
def _(t: Tables) -> DataFrame:
    ch = W.channels(t)
    pool = fusion.balanced_pool(ch, 4, 14)
    return selection.residual_optimum(ch, pool, pool.where("pos <= 5"), 4)


@R.add("k10_pointwise_merge", f"""
    WITH {ROLE}, a AS (SELECT p.q, p.doc, p.pos, 1.0 / p.pos AS b, sum(s) AS total, max(s) AS most FROM pool p JOIN rs USING (q, doc) GROUP BY ALL),
    f AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(total + 0.1::DOUBLE * b, 9) DESC, most DESC, b DESC, pos) AS pos FROM a) SELECT * FROM f WHERE pos <= 5
""")
def _(t: Tables) -> DataFrame:
    base, scores = _scores(t)
    return selection.pointwise_merge(base, scores)


@R.add("k11_role_scores", f"WITH {ROLE} SELECT q, doc, role, round(s, 6) AS s FROM rs")
def _(t: Tables) -> DataFrame:
    return _scores(t)[1].withColumn("s", F.round("s", 6))


@R.add("k21_verifier_shortlist", f"""
    WITH {CH}, {POOL}, b AS (SELECT q, doc, pos, CASE WHEN doc % 3 = 0 THEN 0 ELSE ((doc * 13 + q) % 17) / 17.0 END AS c FROM pool),
    f AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY pos > 3, CASE WHEN pos <= 3 THEN pos ELSE 0 END, round(c, 9) DESC, pos) AS pos FROM b) SELECT * FROM f WHERE pos <= 8
""")
def _(t: Tables) -> DataFrame:
    pool = pools(t)[1]
    compat = pool.where("doc % 3 <> 0").select("q", "doc", (((F.col("doc") * 13 + F.col("q")) % 17) / 17.0).alias("c"))
    return selection.verifier_shortlist(pool, compat)


def _retrieved(t: Tables) -> tuple[DataFrame, DataFrame]:
    ch, pool = pools(t)
    return W.gold(ch), pool


RECALL = """ks(k) AS (VALUES (1), (2), (5), (10), (20)), ev AS (SELECT DISTINCT q FROM (SELECT q FROM pool UNION ALL SELECT q FROM gold)), gn AS (SELECT q, count(*) AS n FROM gold GROUP BY q),
    rc AS (SELECT ev.q, ks.k, coalesce((SELECT count(*) FROM pool p JOIN gold g ON p.q = g.q AND p.doc = g.doc WHERE p.q = ev.q AND p.pos <= ks.k) / gn.n, 0) AS recall FROM ev CROSS JOIN ks LEFT JOIN gn ON gn.q = ev.q)"""


@R.add("e1_recall_at_k", f"WITH {CH}, {POOL}, {W.GOLD}, {RECALL} SELECT CAST(k AS BIGINT) AS k, round(avg(recall), 4) AS recall FROM rc GROUP BY k")
def _(t: Tables) -> DataFrame:
    gold, pool = _retrieved(t)
    return evaluate.pooled_recall(evaluate.recall_at(gold, pool, (1, 2, 5, 10, 20)))


@R.add("e2_exact_match", f"WITH {W.QA} SELECT q, max(CASE WHEN {W.ANS.format('gold')} = {W.ANS.format('prediction')} THEN 1.0::DOUBLE ELSE 0 END) AS em FROM qa GROUP BY q")
def _(t: Tables) -> DataFrame:
    return evaluate.exact_match(W.answers(t))


@R.add("e3_token_f1", f"""
    WITH {W.QA}, w AS (SELECT q, gold_id, list_filter(string_split({W.ANS.format('gold')}, ' '), lambda x: x <> '') AS g, list_filter(string_split({W.ANS.format('prediction')}, ' '), lambda x: x <> '') AS p FROM qa),
    a AS (SELECT q, gold_id, tok, count(*) AS n FROM (SELECT q, gold_id, unnest(g) AS tok FROM w) GROUP BY ALL), b AS (SELECT q, gold_id, tok, count(*) AS n FROM (SELECT q, gold_id, unnest(p) AS tok FROM w) GROUP BY ALL),
    c AS (SELECT q, gold_id, sum(least(a.n, b.n)) AS same FROM a JOIN b USING (q, gold_id, tok) GROUP BY ALL)
    SELECT w.q, round(max(CASE WHEN same > 0 THEN 2.0::DOUBLE * same / (len(g) + len(p)) ELSE 0 END), 6) AS f1 FROM w LEFT JOIN c USING (q, gold_id) GROUP BY w.q
""")
def _(t: Tables) -> DataFrame:
    return evaluate.token_f1(W.answers(t)).withColumn("f1", F.round("f1", 6))


@R.add("e4_recall_at_5", f"WITH {CH}, {POOL}, {W.GOLD}, {RECALL} SELECT q, round(recall, 6) AS recall FROM rc WHERE k = 5")
def _(t: Tables) -> DataFrame:
    gold, pool = _retrieved(t)
    return evaluate.recall_at(gold, pool, (5,)).select("q", F.round("recall", 6).alias("recall"))


@R.add("e5_role_coverage_rate", f"WITH {ROLE}, {W.SEL}, n AS (SELECT q, count(*) AS n FROM ro GROUP BY q), m AS (SELECT q, role, max(s) AS m FROM rs JOIN sel USING (q, doc) GROUP BY ALL) SELECT n.q, round(coalesce(sum(m.m), 0) / any_value(n.n), 6) AS rate FROM n LEFT JOIN m USING (q) GROUP BY n.q")
def _(t: Tables) -> DataFrame:
    base, scores = _scores(t)
    return evaluate.role_coverage_rate(W.selection(base.select("q", "doc", "pos")), scores).withColumn("rate", F.round("rate", 6))


@R.add("e6_lambda_sweep", f"""
    WITH {ROLE}, l(lam) AS (VALUES (0.0::DOUBLE), (0.1), (0.5), (1.0)), a AS (SELECT p.q, p.doc, p.pos, 1.0 / p.pos AS b, sum(s) AS total, max(s) AS most FROM pool p JOIN rs USING (q, doc) GROUP BY ALL),
    f AS (SELECT lam, q, doc, row_number() OVER (PARTITION BY lam, q ORDER BY round(total + lam * b, 9) DESC, most DESC, b DESC, pos) AS pos FROM a CROSS JOIN l), {W.GOLD},
    h AS (SELECT lam, f.q, count(g.doc) AS hits FROM f LEFT JOIN gold g ON g.q = f.q AND g.doc = f.doc WHERE pos <= 5 GROUP BY ALL), n AS (SELECT q, count(*) AS n FROM gold GROUP BY q)
    SELECT lam, round(avg(hits / n), 6) AS recall FROM h JOIN n USING (q) GROUP BY lam
""")
def _(t: Tables) -> DataFrame:
    base, scores = _scores(t)
    gold = W.gold(W.channels(t))
    lam = F.broadcast(t.spark.createDataFrame([(0.0,), (0.1,), (0.5,), (1.0,)], "lam double"))
    summed = base.join(scores.groupBy("q", "doc").agg(F.sum("s").alias("total"), F.max("s").alias("most")), ["q", "doc"]).crossJoin(lam)
    order = [F.desc(F.round(F.col("total") + F.col("lam") * F.col("score"), 9)), F.desc("most"), F.desc("score"), "pos"]
    kept = ranking.top_k(summed, ["lam", "q"], order, 5, "place")
    sizes = gold.groupBy("q").agg(F.count("*").alias("n"))
    hits = kept.join(gold.withColumn("hit", F.lit(1)), ["q", "doc"], "left").groupBy("lam", "q").agg(F.count("hit").alias("hits"))
    return hits.join(sizes, "q").groupBy("lam").agg(F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("recall"))


@R.add("a14_variant_summary", f"""
    WITH {CH}, {POOL}, {W.GOLD}, {RECALL}, v AS (SELECT 'k' || a.k AS variant, a.q, a.recall AS value, b.recall AS base FROM rc a JOIN rc b ON a.q = b.q AND b.k = 5)
    SELECT variant, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value - base), 6) AS delta, count(*) FILTER (value > base) AS improved, count(*) FILTER (value < base) AS worsened, count(*) FILTER (value <> base) AS changed FROM v GROUP BY variant
""")
def _(t: Tables) -> DataFrame:
    gold, pool = _retrieved(t)
    rc = evaluate.recall_at(gold, pool, (1, 2, 5, 10, 20))
    base = rc.where("k = 5").select("q", F.col("recall").alias("base"))
    rows = rc.join(base, "q").select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("variant"), "q", F.col("recall").alias("value"), "base")
    return evaluate.summary(rows).withColumns({"mean": F.round("mean", 6), "delta": F.round("delta", 6)})


@R.add("e7_macro_average", f"WITH {CH}, e AS (SELECT channel AS dataset, avg(score) AS value FROM ch GROUP BY channel) SELECT dataset, round(value, 6) AS value FROM e UNION ALL SELECT 'macro', round(avg(value), 6) FROM e")
def _(t: Tables) -> DataFrame:
    return evaluate.macro(W.channels(t).select(F.col("channel").alias("dataset"), F.col("score").alias("value"))).withColumn("value", F.round("value", 6))


@R.add("a16_usage_sum", "SELECT event_type, CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count("*").alias("n"))


@R.add("flagship_role_channels", f"""
    WITH {CH}, {POOL}, kept AS (SELECT * FROM (WITH {_greedy_sql(5)})), {W.GOLD}, n AS (SELECT q, count(*) AS n FROM gold GROUP BY q)
    SELECT e.q, round(coalesce((SELECT count(*) FROM kept k JOIN gold g ON g.q = k.q AND g.doc = k.doc WHERE k.q = e.q) / n.n, 0), 6) AS recall FROM (SELECT DISTINCT q FROM pool) e LEFT JOIN n USING (q)
""")
def flagship(t: Tables) -> DataFrame:
    """Channels, the balanced pool, greedy selection by channel coverage, recall at 5: the whole role-channel plan."""
    ch, pool = pools(t)
    chosen = selection.coverage_greedy(ch, pool)
    return evaluate.recall_at(W.gold(ch), chosen, (5,)).select("q", F.round("recall", 6).alias("recall"))


