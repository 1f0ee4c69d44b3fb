"""Graph queries on all triples: those of parts are there, and PageRank agrees with plain Python."""

from collections import defaultdict

import oracle
from lanternfold import catalog
from lanternfold.plans import graph_plans
from lanternfold.plans import worlds as W
from lanternfold.registry import Tables

SF = f"{oracle.DATA}/sf0.001"


def test_graph_queries_leave_no_triples_out(spark):
    assert not [n for n, x in catalog.oracle_sql().items() if "<> 'supplied by'" in x]
    assert graph_plans.places(Tables(spark, SF)).count() == W.triples(Tables(spark, SF)).count()


def test_pagerank_on_all_triples(spark):
    t = Tables(spark, SF)
    triples = [tuple(r) for r in W.triples(t).select("passage", "s", "o").collect()]
    weight = defaultdict(float)
    for a, b in {(p, x) for p, s, o in triples for x in (s, o)}:
        weight[a, b] += 1
        weight[b, a] += 1
    for _, s, o in triples:
        if s != o:
            weight[s, o] += 1
            weight[o, s] += 1
    out = defaultdict(float)
    for (a, _), w in weight.items():
        out[a] += w
    reset = defaultdict(dict)
    for r in graph_plans.reset(t).collect():
        reset[r["q"]][r["node"]] = r["weight"]
    got = catalog.queries()["p3_personalised_pagerank"](spark, SF).collect()
    for q, start in reset.items():
        p = dict(start)
        for _ in range(10):
            lost = sum(v for n, v in p.items() if n not in out)
            step = defaultdict(float, {n: v * (0.5 + 0.5 * lost) for n, v in start.items()})
            for (a, b), w in weight.items():
                if a in p:
                    step[b] += 0.5 * p[a] * w / out[a]
            p = step
        rows = [r for r in got if r["q"] == q]
        assert len(rows) == 50 and all(abs(r["p"] - p[r["node"]]) < 2e-6 for r in rows)
        rest = set(p) - {r["node"] for r in rows}
        assert max(p[n] for n in rest if n[0] in "csnp" and n[1:].isdigit()) <= min(r["p"] for r in rows) + 2e-6
