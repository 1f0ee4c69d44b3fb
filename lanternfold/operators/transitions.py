"""Document transition graphs, fact graphs, proposals, slots and set scores of the symbolic retriever.

Facts are long: doc, fact, s, r, o (endpoints normalised); titles: doc, title (normalised); spans: doc, endpoint.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.operators.ranking import top_k

#: The kinds of transition in the order of their strength; the first four are evidence, the others weak.
KINDS = ("sentence", "role_bridge", "same_subject", "same_object", "title_grounding", "source_incidence")
EVIDENCE = KINDS[:4]


def light_units(passages: DataFrame, facts: DataFrame) -> DataFrame:
    """Retrieval units: one for each sentence and one for each fact: doc, unit_type, text, endpoints (joined).

    passages: doc, title, text; facts: doc, s, r, o. A sentence's endpoints are the fact endpoints of its document that it holds.
    """
    sentences = passages.select("doc", "title", F.explode(F.split(F.regexp_replace("text", "([.!?])[ \\n]+", "$1\u0001"), "\u0001")).alias("text")).where("trim(text) <> ''")
    ends = facts.select("doc", F.explode(F.array("s", "o")).alias("e")).distinct()
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), F.lit(" "))
    held = sentences.withColumn("padded", padded).join(ends, "doc", "left").withColumn("e", F.when(F.col("padded").contains(F.concat(F.lit(" "), F.col("e"), F.lit(" "))), F.col("e")))
    spans = held.groupBy("doc", "text").agg(F.array_join(F.array_sort(F.collect_set("e")), "|").alias("endpoints")).select("doc", F.lit("source_span").alias("unit_type"), "text", "endpoints")
    stated = facts.join(passages.select("doc", "title"), "doc").select("doc", F.lit("openie_fact").alias("unit_type"), F.concat_ws(" ", "s", "r", "o").alias("text"), F.array_join(F.array_sort(F.array_distinct(F.array("s", "o", F.lower("title")))), "|").alias("endpoints"))
    return spans.unionByName(stated)


def transition_graph(facts: DataFrame, titles: DataFrame, spans: DataFrame, max_degree: int, title_grounding: bool = True) -> DataFrame:
    """Undirected edges between documents: left, right, kinds (joined, strongest first), best (place of the best kind), endpoints (count).

    Of each endpoint and document one fact counts a side, so an endpoint gives max_degree squared pairs at most; endpoints in
    more documents than that are hubs and are cut before any join.
    """
    subject = facts.select("doc", F.col("s").alias("e")).where("e <> ''").distinct()
    obj = facts.select("doc", F.col("o").alias("e")).where("e <> ''").distinct()
    role = subject.unionByName(obj).distinct()
    low = role.groupBy("e").agg(F.count("*").alias("d")).where(F.col("d") <= max_degree).select("e")
    cut = lambda df: df.join(low, "e", "left_semi")
    other = lambda df: df.select(F.col("doc").alias("doc2"), "e")
    tagged = lambda df, kind: df.where("doc <> doc2").select(F.least("doc", "doc2").alias("left"), F.greatest("doc", "doc2").alias("right"), "e", F.lit(KINDS.index(kind)).alias("kind"))
    grounded = facts.where("s <> '' and o <> ''").join(titles, "doc")
    target = F.when(F.col("s") == F.col("title"), F.col("o")).when(F.col("o") == F.col("title"), F.col("s"))
    sentence = grounded.select("doc", target.alias("e")).where("e is not null").join(titles.select(F.col("doc").alias("doc2"), F.col("title").alias("e")), "e")
    edges = (
        tagged(sentence, "sentence")
        .unionByName(tagged(cut(subject).join(other(subject), "e").where("doc < doc2"), "same_subject"))
        .unionByName(tagged(cut(obj).join(other(obj), "e").where("doc < doc2"), "same_object"))
        .unionByName(tagged(cut(obj).join(other(subject), "e"), "role_bridge"))
    )
    if title_grounding:
        edges = edges.unionByName(tagged(cut(titles.select("doc", F.col("title").alias("e"))).join(other(role), "e"), "title_grounding"))
    span = spans.select("doc", F.col("endpoint").alias("e")).distinct()
    both = span.unionByName(role).distinct().groupBy("e").agg(F.count("*").alias("d")).where(F.col("d") <= max_degree).select("e")
    edges = edges.unionByName(tagged(span.join(both, "e", "left_semi").join(other(role), "e"), "source_incidence"))
    merged = edges.groupBy("left", "right").agg(F.array_sort(F.collect_set("kind")).alias("k"), F.countDistinct("e").alias("endpoints"))
    names = F.transform("k", lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1))
    return merged.select("left", "right", F.array_join(names, ",").alias("kinds"), F.col("k")[0].alias("best"), "endpoints")


def filtered_graph(graph: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """The graph with the allowed kinds only; edges without one drop out."""
    kept = F.filter(F.split("kinds", ","), lambda k: k.isin(*allowed))
    rank = F.transform(F.col("x"), lambda k: F.array_position(F.array(*[F.lit(v) for v in KINDS]), k).cast("int") - 1)
    return graph.withColumn("x", kept).where(F.size("x") > 0).select("left", "right", F.array_join("x", ",").alias("kinds"), F.array_min(rank).alias("best"), "endpoints")


def evidence_tier(best):
    """evidence or weak, by the best kind's place."""
    return F.when(best < len(EVIDENCE), "evidence").otherwise("weak")


def fact_graph(facts: DataFrame, max_degree: int) -> DataFrame:
    """Edges between facts, a < b: shared endpoints of low degree across documents; then pairs in one document of facts that have such an edge."""
    ends = facts.select("doc", "fact", F.explode(F.array("s", "o")).alias("e")).where("e <> ''").distinct()
    low = ends.groupBy("e").agg(F.countDistinct("doc").alias("d")).where(F.col("d") <= max_degree).select("e")
    kept = ends.join(low, "e", "left_semi")
    across = kept.join(kept.select("e", F.col("fact").alias("b"), F.col("doc").alias("doc2")), "e").where("fact < b and doc <> doc2").select(F.col("fact").alias("a"), "b").distinct()
    bearing = across.select(F.explode(F.array("a", "b")).alias("fact")).distinct()
    own = facts.select("doc", "fact").distinct().join(bearing, "fact")
    inside = own.join(own.select("doc", F.col("fact").alias("b")), "doc").where("fact < b").select(F.col("fact").alias("a"), "b")
    return across.unionByName(inside).distinct()


def fact_seeds(facts: DataFrame, queries: DataFrame, endpoint_idf: DataFrame, token_idf: DataFrame, matched: DataFrame) -> DataFrame:
    """A question's reset over facts: q, fact, weight, from the first of three tiers that gives any.

    Exact endpoints (matched: q, e): the sum of their idf. Else tokens shared with endpoints: their idf times the mean endpoint
    idf. facts: fact, s, o; queries: q, token; endpoint_idf: e, idf; token_idf: token, idf. Weights sum to 1.
    """
    ends = facts.select("fact", F.explode(F.array("s", "o")).alias("e")).distinct().join(endpoint_idf, "e", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    exact = matched.join(ends, "e").groupBy("q", "fact").agg(F.sum("idf").alias("w")).withColumn("tier", F.lit(0))
    mean = ends.groupBy("fact").agg(F.avg("idf").alias("spec"))
    tokens = ends.select("fact", F.explode(F.split("e", " ")).alias("token")).distinct()
    shared = queries.join(tokens, "token").join(token_idf.withColumnRenamed("idf", "t"), "token", "left").groupBy("q", "fact").agg(F.sum(F.coalesce("t", F.lit(1.0))).alias("mass"))
    loose = shared.join(mean, "fact").select("q", "fact", (F.col("mass") * F.col("spec")).alias("w"), F.lit(1).alias("tier"))
    rows = exact.unionByName(loose)
    first = rows.groupBy("q").agg(F.min("tier").alias("tier"))
    kept = rows.join(first, ["q", "tier"])
    total = kept.groupBy("q").agg(F.sum("w").alias("t"))
    return kept.join(total, "q").select("q", "fact", (F.col("w") / F.col("t")).alias("weight"))


def endpoint_expansion(facts: DataFrame, seeds: DataFrame, max_degree: int) -> DataFrame:
    """Documents that seed facts' endpoints reach: q, doc, score = the sum of seed weight / degree. facts: doc, fact, s, o; seeds: q, fact, weight."""
    ends = facts.select("doc", "fact", F.explode(F.array("s", "o")).alias("e")).distinct()
    degree = ends.groupBy("e").agg(F.countDistinct("doc").alias("deg")).where(F.col("deg") <= max_degree)
    reach = seeds.join(ends.select("fact", "e").distinct(), "fact").join(degree, "e").join(ends.select("doc", "e").distinct(), "e")
    return reach.groupBy("q", "doc").agg(F.sum(F.col("weight") / F.col("deg")).alias("score"))


def pairwise_emission(anchors: DataFrame, ends: DataFrame, scores: DataFrame, max_degree: int) -> DataFrame:
    """For each anchor its best completion: q, anchor, doc, score.

    score = 0.55 * T + 0.35 * BM25 + 0.2 * ln(1 + shared endpoints), T the idf sum of shared endpoints of low degree.
    anchors: q, doc; ends: doc, e; scores: q, doc, score.
    """
    n = ends.select("doc").distinct().agg(F.count("*").alias("n_docs"))
    idf = ends.groupBy("e").agg(F.count("*").alias("d")).where(F.col("d") <= max_degree).crossJoin(F.broadcast(n)).select("e", (F.log((F.col("n_docs") + 1) / (F.col("d") + 0.5)) + 1).alias("idf"))
    low = ends.join(idf, "e")
    hop = anchors.select("q", F.col("doc").alias("anchor")).join(low.select(F.col("doc").alias("anchor"), "e", "idf"), "anchor").join(low.select("doc", "e"), "e").where("doc <> anchor")
    pairs = hop.groupBy("q", "anchor", "doc").agg(F.sum("idf").alias("t"), F.count("*").alias("n")).join(scores.withColumnRenamed("score", "bm25"), ["q", "doc"], "left")
    value = F.round(0.55 * F.col("t") + 0.35 * F.coalesce("bm25", F.lit(0.0)) + 0.2 * F.log1p("n"), 9)
    return top_k(pairs.withColumn("score", value), ["q", "anchor"], [F.desc("score"), "doc"], 1).select("q", "anchor", "doc", "score")


def neighbourhood(anchors: DataFrame, ends: DataFrame, scores: DataFrame, max_degree: int, limit: int) -> DataFrame:
    """Documents near the anchors: q, doc, score (shared low-degree endpoints + ln(1 + BM25)), rank."""
    low = ends.join(ends.groupBy("e").agg(F.count("*").alias("d")).where(F.col("d") <= max_degree).select("e"), "e", "left_semi")
    hop = anchors.select("q", F.col("doc").alias("anchor")).join(low.select(F.col("doc").alias("anchor"), "e"), "anchor").join(low, "e").where("doc <> anchor")
    near = hop.groupBy("q", "doc").agg(F.countDistinct("e").alias("n")).join(scores.withColumnRenamed("score", "bm25"), ["q", "doc"], "left")
    value = F.round(F.col("n") + F.log1p(F.coalesce("bm25", F.lit(0.0))), 9)
    return top_k(near.withColumn("score", value), ["q"], [F.desc("score"), "doc"], limit).select("q", "doc", "score", "rank")


def role_units(records: DataFrame) -> DataFrame:
    """Proposal records by document: q, doc, roles (joined), most, best, n. records: q, role, doc, score, rank."""
    return records.groupBy("q", "doc").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.max("score").alias("most"), F.min("rank").alias("best"), F.count("*").alias("n"))


def covered_units(units: DataFrame, chosen: DataFrame) -> DataFrame:
    """How many units of each role lie wholly in the chosen set: q, role, n. units: q, unit, role, doc; chosen: q, doc."""
    size = units.groupBy("q", "unit", "role").agg(F.count("*").alias("size"))
    have = units.join(chosen, ["q", "doc"], "left_semi").groupBy("q", "unit", "role").agg(F.count("*").alias("have"))
    return size.join(have, ["q", "unit", "role"]).where("have = size").groupBy("q", "role").agg(F.count("*").alias("n"))


def slot_links(slots: DataFrame, units: DataFrame) -> DataFrame:
    """Units that share a token with a slot: q, slot, unit, shared. slots: q, slot, token; units: unit, token."""
    return slots.join(units, "token").groupBy("q", "slot", "unit").agg(F.countDistinct("token").alias("shared"))


def slot_coverage(links: DataFrame, doc_units: DataFrame, chosen: DataFrame) -> DataFrame:
    """Distinct slots that the chosen documents' units cover: q, slots. doc_units: doc, unit."""
    return links.join(doc_units, "unit").join(chosen, ["q", "doc"], "left_semi").groupBy("q").agg(F.countDistinct("slot").alias("slots"))


def support_priors(records: DataFrame) -> DataFrame:
    """Per document the best ln(1 + score) / sqrt(rank): q, doc, prior. records: q, doc, score, rank."""
    return records.groupBy("q", "doc").agg(F.max(F.log1p("score") / F.sqrt("rank")).alias("prior"))


def set_scores(sets: DataFrame, pairs: DataFrame, scores: DataFrame, covered: DataFrame, hubs: DataFrame) -> DataFrame:
    """The value of document sets: q, set_id, value.

    utility 0.6 * sum of ln(1 + BM25) + 1.75 * covered idf; support 1.75 * the n - 1 greatest ln(1 + pair weight); cost 2.2 * the
    missing ones + 0.18 * hub endpoints + 0.2 * documents over two. sets: q, set_id, doc; pairs: left, right, w (left < right);
    covered: q, set_id, mass; hubs: doc, n.
    """
    size = sets.groupBy("q", "set_id").agg(F.count("*").alias("n"))
    lex = sets.join(scores, ["q", "doc"], "left").groupBy("q", "set_id").agg(F.sum(F.log1p(F.coalesce("score", F.lit(0.0)))).alias("lex"))
    hub = sets.join(hubs.withColumnRenamed("n", "h"), "doc", "left").groupBy("q", "set_id").agg(F.sum(F.coalesce("h", F.lit(0))).alias("hub"))
    a, b = sets.select("q", "set_id", F.col("doc").alias("left")), sets.select("q", "set_id", F.col("doc").alias("right"))
    linked = a.join(b, ["q", "set_id"]).where("left < right").join(pairs, ["left", "right"])
    tree = top_k(linked, ["q", "set_id"], [F.desc(F.round("w", 9)), "left", "right"], 1 << 20, "at").join(size, ["q", "set_id"]).where("at <= n - 1").groupBy("q", "set_id").agg(F.sum(F.log1p("w")).alias("tree"), F.count("*").alias("edges"))
    rows = size.join(lex, ["q", "set_id"]).join(hub, ["q", "set_id"]).join(tree, ["q", "set_id"], "left").join(covered, ["q", "set_id"], "left").fillna(0, ["tree", "edges", "mass"])
    value = 0.6 * F.col("lex") + 1.75 * F.col("mass") + 1.75 * F.col("tree") - 2.2 * (F.col("n") - 1 - F.col("edges")) - 0.18 * F.col("hub") - 0.2 * F.greatest(F.col("n") - 2, F.lit(0))
    return rows.select("q", "set_id", value.alias("value"))


def beam_sets(scores: DataFrame, pairs: DataFrame, tokens: DataFrame, priors: DataFrame, size: int = 5, beam: int = 12) -> DataFrame:
    """A beam search for a connected set of documents: q, docs (joined, in the order added), score.

    A document's priority for a set: 2.25 * idf of question tokens that the set does not cover + 1.35 * ln(1 + weight to the set)
    + 0.75 * channel prior + 0.35 * ln(1 + BM25) - 0.75 where nothing links + 0.25 with a support prior. Each set of a level is
    grown by its ``beam`` best documents, and the ``beam`` best sets go on. A set's score is that of ``set_scores``; order: score,
    missing tree edges, covered tokens, documents.
    scores: q, doc, score (a question's candidates, a bounded list); pairs: q, left, right, w; tokens: q, doc, token, idf (question
    tokens that a document covers); priors: q, doc, channel, support, hubs.
    """
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        docs = np.sort(rows["doc"].unique())
        at = {d: k for k, d in enumerate(docs)}
        pick = lambda kind, *cols: rows.loc[rows["kind"] == kind, list(cols)]
        lex, channel, support, hubs = (np.zeros(len(docs)) for _ in range(4))
        for d, x in pick("score", "doc", "x").itertuples(index=False):
            lex[at[d]] = np.log1p(max(x, 0.0))
        for d, x, y, z in pick("prior", "doc", "x", "y", "other").itertuples(index=False):
            channel[at[d]], support[at[d]], hubs[at[d]] = x, y, z
        w = np.zeros((len(docs), len(docs)))
        for a, b, x in pick("pair", "doc", "other", "x").itertuples(index=False):
            if a in at and b in at:
                w[at[a], at[b]] = w[at[b], at[a]] = x
        held = pick("token", "doc", "other", "x")
        names = {y: k for k, y in enumerate(sorted(held["other"].unique()))}
        covers, idf = np.zeros((len(docs), len(names)), bool), np.zeros(len(names))
        for d, y, x in held.itertuples(index=False):
            covers[at[d], names[y]], idf[names[y]] = True, x

        def order(chosen: tuple[int, ...]) -> tuple:
            ids, n = list(chosen), len(chosen)
            covered = covers[ids].any(0)
            strong = np.sort(w[np.ix_(ids, ids)][np.triu_indices(n, 1)])[::-1][: n - 1]
            strong = strong[strong > 0]
            missing = n - 1 - len(strong)
            value = 0.6 * lex[ids].sum() + 1.75 * idf[covered].sum() + 1.75 * np.log1p(strong).sum() - 2.2 * missing - 0.18 * hubs[ids].sum() - 0.2 * max(n - 2, 0)
            return -round(float(value), 9), missing, -int(covered.sum()), tuple(int(docs[k]) for k in ids)

        def grown(chosen: tuple[int, ...]) -> list[tuple[int, ...]]:
            ids = list(chosen)
            link = w[:, ids].sum(1)
            new = (covers & ~covers[ids].any(0)) @ idf
            priority = 2.25 * new + 1.35 * np.log1p(link) + 0.75 * channel + 0.35 * lex - np.where(link > 0, 0.0, 0.75 if ids else 0.0) + 0.25 * (support > 0)
            best = np.lexsort((docs, -priority.round(9)))
            return [(*chosen, int(k)) for k in best[~np.isin(best, ids)][:beam]]

        level: list[tuple[int, ...]] = [()]
        for _ in range(min(size, len(docs))):
            # one order of adding for each set of documents
            sets = {frozenset(x): x for x in sorted((y for chosen in level for y in grown(chosen)), key=order, reverse=True)}
            level = sorted(sets.values(), key=order)[:beam]
        first = order(level[0])
        return pd.DataFrame({"q": [rows["q"].iloc[0]], "docs": [",".join(map(str, first[3]))], "score": [-first[0]]})

    part = lambda df, kind, doc, other, x, y: df.select("q", F.lit(kind).alias("kind"), F.col(doc).cast("long").alias("doc"), other.cast("long").alias("other"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0)
    rows = part(scores, "score", "doc", zero, F.col("score"), zero).unionByName(part(pairs, "pair", "left", F.col("right"), F.col("w"), zero))
    only = lambda df: df.join(scores.select("q", "doc"), ["q", "doc"], "left_semi")
    rows = rows.unionByName(part(only(tokens), "token", "doc", F.col("token"), F.col("idf"), zero)).unionByName(part(only(priors), "prior", "doc", F.col("hubs"), F.col("channel"), F.col("support").cast("int")))
    return rows.groupBy("q").applyInPandas(search, "q long, docs string, score double")


def closure(graph: DataFrame, seeds: DataFrame, hops: int = 2, most: int = 120) -> DataFrame:
    """The documents within ``hops`` of a question's seeds in the transition graph, nearest and strongest edges first: q, doc, hop, pos.

    graph: left, right, best; seeds: q, doc, rank.
    """
    both = graph.select(F.col("left").alias("a"), F.col("right").alias("b"), "best").unionByName(graph.select(F.col("right").alias("a"), F.col("left").alias("b"), "best"))
    seen = seeds.select("q", "doc", F.lit(0).alias("hop"), F.lit(0).alias("best"), F.col("rank").cast("long").alias("at"))
    front = seen
    for hop in range(1, hops + 1):
        step = front.select("q", F.col("doc").alias("a"), "at").join(both, "a").groupBy("q", F.col("b").alias("doc")).agg(F.min(F.struct("best", "at")).alias("x"))
        front = step.join(seen.select("q", "doc"), ["q", "doc"], "left_anti").select("q", "doc", F.lit(hop).alias("hop"), "x.best", "x.at")
        seen = seen.unionByName(front)
    return top_k(seen, ["q"], ["hop", "best", "at", "doc"], most, "pos").select("q", "doc", "hop", "pos")
