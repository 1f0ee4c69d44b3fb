"""Pairs of hyperedges against every pair, and that no table has them all."""

import random
from hashlib import md5

import pytest

from lanternfold.operators import graph as G


def brute(triples, max_degree):
    ends, passages = {}, {}
    for p, *fact in triples:
        h = "prop-" + md5("|".join(x for x in fact if x is not None).encode()).hexdigest()
        for e, role in ((fact[0], 1), (fact[2], 2)):
            if e is not None:
                ends.setdefault(h, {}).setdefault(e, set()).add(role)
        if None not in fact:
            passages.setdefault(h, set()).add(p)
    hubs = lambda of: {x for x in set().union(*of.values()) if sum(x in v for v in of.values()) > max_degree}
    hub_ends, hub_passages, out = hubs(ends), hubs(passages), []
    for a in ends:
        found = []
        for b in ends:
            both = sorted((set(ends[a]) & set(ends[b])) - hub_ends)
            if a != b and both:
                context = bool((passages.get(a, set()) & passages.get(b, set())) - hub_passages)
                weight = round(0.35 * len(both) + 0.2 * bool(ends[a][both[-1]] & ends[b][both[-1]]) + 0.2 * context, 9)
                if weight >= 0.4:
                    found.append((-weight, b))
        out += [(a, b, -w) for w, b in sorted(found)[:8]]
    return sorted(out)


@pytest.mark.parametrize("entities, bar", [(6, ""), (25, ""), (80, ""), (25, "|")])
def test_hyperedge_pairs_are_those_of_all_pairs(spark, entities, bar):
    rng = random.Random(entities)
    name = lambda: rng.choice([f"e{rng.randrange(entities)}", f"e{rng.randrange(entities)}", "hub"])
    triples = [(f"p{rng.randrange(40)}", name(), rng.choice("rst"), name()) for _ in range(160)]
    triples += [(f"own{k % 3}", f"part{k % 3}", "by", f"sup{k}") for k in range(36)] + [("n", None, "r", "e1"), ("n", "e1", "r", "e2"), ("n", "e2", "r", "e2")]
    triples += [("n", f"e1{bar}r", "s", "e2"), ("n", "e1", f"r{bar}s", "e2")] if bar else []
    got = G.hyperedge_pairs(spark.createDataFrame(triples, "passage string, s string, r string, o string"), 12).collect()
    assert sorted(map(tuple, got)) == brute(triples, 12)


def test_pairs_stay_inside_their_groups(spark):
    rows = [(f"p{k // 30}", f"part{k // 30}", "by", f"sup{k % 30}") for k in range(300)]
    pairs = G.hyperedge_pairs(spark.createDataFrame(rows, "passage string, s string, r string, o string"), 40)
    assert pairs.count() == 300 * 8
    assert "FullOuter" not in pairs._jdf.queryExecution().analyzed().toString()
