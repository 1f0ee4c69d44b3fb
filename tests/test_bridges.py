"""Bridges between facts on random facts, against every pair."""

import random

from lanternfold.operators import channels as C
from lanternfold.operators import memory as M


def brute(facts, max_degree, per_fact):
    of = {}
    for fact, passage, _, s, o in facts:
        for key in ((0, s), (0, o), (1, passage)):
            if key[1] is not None:
                of.setdefault(key, set()).add(fact)
    rel = {f[0]: f[2] for f in facts}
    found = {}
    for (by, _), held in of.items():
        for a in held if len(held) <= max_degree else ():
            for b in held - {a}:
                found.setdefault(a, {}).setdefault(b, [0, 0])[by] += 1
    out = set()
    for a, others in found.items():
        for b in sorted(others, key=lambda b: (-others[b][0], -others[b][1], b))[:per_fact]:
            eo, so = others[b]
            kind = "relation_continuation" if eo and rel[a] == rel[b] else "same_source_chain" if so else "shared_entity_bridge"
            out.add((min(a, b), max(a, b), kind, eo, so))
    return sorted(out)


def random_facts(rng, entities):
    ids = [(rng.choice(entities), rng.choice("rst"), rng.choice([*entities, None])) for _ in range(120)]
    return [("|".join(map(str, x)), f"p{rng.randint(0, 30)}", x[1], x[0], x[2]) for x in ids for _ in range(rng.randint(1, 2))]


def test_bridges_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    for entities, per_fact in ((range(8), 2), (range(60), 3), (range(400), 32)):
        facts = random_facts(rng, [f"e{x}" for x in entities])
        for passage in range(40, 43):  # facts of one passage and one entity: one group
            facts += [(f"own{passage}-{k}", f"p{passage}", "r", f"part{passage}", f"hub{k % 2}") for k in range(9)]
        got = M.bridges(spark.createDataFrame(facts, "fact string, passage string, r string, s string, o string"), 12, per_fact)
        assert sorted(map(tuple, got.collect())) == brute(facts, 12, per_fact)


def test_no_join_has_all_pairs_of_facts(spark):
    facts = [(f"f{k}", "p", "r", "s", f"o{k}") for k in range(40)]
    plan = M.bridges(spark.createDataFrame(facts, "fact string, passage string, r string, s string, o string"), 60, 6)
    assert plan.count() == sum(39 - k for k in range(6))
    assert "FullOuter" not in plan._jdf.queryExecution().analyzed().toString()


SCHEMA = "fact string, passage string, r string, s string, o string"


def mixed_facts(rng):
    """Passages of their own, with entities of one passage and hubs, and passages that share facts and entities; some facts repeat."""
    rows = []
    for p in range(25):
        own = p % 3 > 0
        for _ in range(rng.randint(1, 11)):
            s = f"own{p}-{rng.randrange(3)}" if own else f"e{rng.randrange(12)}"
            o = rng.choice([f"hub{rng.randrange(2)}", f"own{p}-{rng.randrange(3)}", None] if own else [f"hub{rng.randrange(2)}", f"e{rng.randrange(12)}", None])
            rows.append((f"p{p}", rng.choice("rt"), s, o))
    rows += [(f"big{k % 2}", "r", f"big{k % 2}-{k % 5}", f"x{k}") for k in range(40)] + [(None, "r", "e1", "own1-0"), ("alone", "r", "alone", "hub0")]
    rows += rng.sample(rows, 15) + [("p90", *x[1:]) for x in rng.sample(rows, 5)]
    return [(f"{s}|{r}|{o}", p, r, s, o) for p, r, s, o in rows]


def test_units_and_joins_give_the_bridges_of_all_pairs(spark):
    rng = random.Random(11)
    for per_fact in (2, 5, 40):
        rows = mixed_facts(rng)
        found = M.Bridges(spark.createDataFrame(rows, SCHEMA), 12, per_fact)
        assert not found.none_open and {r["home"] for r in found.units.collect()} - {r["home"] for r in found.open.collect()}
        assert sorted(map(tuple, found.paths().collect())) == brute(rows, 12, per_fact)


def test_a_unit_takes_one_shuffle(spark):
    rows = [(f"{p}-{k}", f"p{p}", "r", f"s{p}", f"o{k}") for p in range(20) for k in range(14)]
    paths = M.bridges(spark.createDataFrame(rows, SCHEMA), 15, 6)
    plan = paths._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "Window" not in plan
    assert sorted(map(tuple, paths.collect())) == brute(rows, 15, 6)


def test_membership_of_units_is_that_of_the_joins(spark):
    facts = spark.createDataFrame(mixed_facts(random.Random(13)), SCHEMA)
    found = M.Bridges(facts, 12, 4)
    assert sorted(map(tuple, found.trail_membership(3, 6).collect())) == sorted(map(tuple, M.trail_membership(M.trails(found.paths(), 3, 6), facts).collect()))


def asked(spark, rows):
    """Two questions with six facts each, of units and of others."""
    ids = sorted({x[0] for x in rows})
    return spark.createDataFrame([(q, fact, k) for q in (0, 1) for k, fact in enumerate(random.Random(q).sample(ids, 6))], "q long, fact string, frank long")


def test_bridges_from_wanted_facts_are_whole(spark):
    rows = mixed_facts(random.Random(15))
    facts, act = spark.createDataFrame(rows, SCHEMA), asked(spark, rows)
    some, every = M.Bridges(facts, 12, 4, act.select("fact")), M.Bridges(facts, 12, 4)
    assert 0 < some.units.count() < every.units.count()
    assert C.bridge_path(act, some.paths(), facts, 20).collect() == C.bridge_path(act, every.paths(), facts, 20).collect() != []


def test_trails_of_units_are_those_of_the_joins(spark):
    rng = random.Random(12)
    for per_fact, neighbours, per_start in ((3, 4, 8), (40, 2, 3)):
        facts = spark.createDataFrame(mixed_facts(rng), SCHEMA)
        found = M.Bridges(facts, 12, per_fact)
        assert sorted(map(tuple, found.trails(neighbours, per_start).collect())) == sorted(map(tuple, M.trails(M.bridges(facts, 12, per_fact), neighbours, per_start).collect()))


def test_trails_from_wanted_facts_are_whole(spark):
    rows = mixed_facts(random.Random(16))
    facts, act = spark.createDataFrame(rows, SCHEMA), asked(spark, rows)
    some, every = M.Bridges(facts, 12, 4, act.select("fact")), M.Bridges(facts, 12, 4)
    assert C.support_trail(act, some.trails(), facts, 20).collect() == C.support_trail(act, every.trails(), facts, 20).collect() != []


def test_endpoints_of_units_are_those_of_the_joins(spark):
    facts = spark.createDataFrame(mixed_facts(random.Random(14)), SCHEMA)
    found = M.Bridges(facts, 12, 4)
    assert sorted(map(tuple, found.trail_endpoints(3, 6).collect())) == sorted(map(tuple, M.trail_endpoints(M.trails(found.paths(), 3, 6)).collect()))
