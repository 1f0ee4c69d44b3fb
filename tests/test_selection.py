"""Greedy and beam selections against hand-made cases and plain enumeration."""

import itertools
import math

from lanternfold.operators import fusion
from lanternfold.operators import transitions as X


def channels(spark, lists):
    rows = [(1, f"c{c}", c, d, r + 1) for c, docs in enumerate(lists) for r, d in enumerate(docs)]
    return spark.createDataFrame(rows, "q long, channel string, cpos int, doc long, rank long")


def pool(spark, lists, **options):
    return [r["doc"] for r in fusion.demand_marginal_pool(channels(spark, lists), **options).orderBy("pos").collect()]


def test_demand_marginal_pool(spark):
    assert pool(spark, [[1, 2], [3, 4]], most=3) == [1, 3, 2]
    assert pool(spark, [[1, 2], [1, 3]], depth=1) == [1]
    seeds = spark.createDataFrame([(1, 9, 1), (1, 1, 2)], "q long, doc long, rank long")
    assert pool(spark, [[1, 2], [3, 4]], most=4, seeds=seeds) == [9, 1, 3, 2]


def test_demand_marginal_pool_by_hand(spark):
    lists = [[7, 1, 2, 3], [5, 2, 7, 8], [2, 9, 5]]
    e = {}
    for c, docs in enumerate(lists):
        for r, d in enumerate(docs, 1):
            e.setdefault(d, {})[c] = 1 / math.log2(1 + r)
    seen, cover, out = list(e), [0.0] * 3, []
    while len(out) < 6:
        gain = {d: sum(x * (1 - cover[c]) for c, x in e[d].items()) for d in e if d not in out}
        best = max(gain, key=lambda d: (round(0.35 * max(e[d].values()) + 0.65 * gain[d], 9), round(gain[d], 9), max(e[d].values()), -seen.index(d)))
        out.append(best)
        cover = [max(cover[c], e[best].get(c, 0.0)) for c in range(3)]
    assert pool(spark, lists, most=6) == out


def test_beam_of_all_sets_finds_the_best(spark):
    docs = range(1, 7)
    score = {d: 0.3 * d for d in docs}
    pairs = {(1, 2): 3.0, (2, 3): 1.0, (4, 6): 2.0, (5, 6): 0.5}
    tokens = {d: {d % 3, 3 + d % 2} for d in docs}
    idf = {k: 1 + k / 4 for k in range(5)}
    hubs = {d: d % 2 for d in docs}

    def order(s):
        covered = set().union(*(tokens[d] for d in s))
        strong = sorted((w for (a, b), w in pairs.items() if a in s and b in s), reverse=True)[: len(s) - 1]
        missing = len(s) - 1 - len(strong)
        value = 0.6 * sum(math.log1p(score[d]) for d in s) + 1.75 * sum(idf[k] for k in covered) + 1.75 * sum(map(math.log1p, strong)) - 2.2 * missing - 0.18 * sum(hubs[d] for d in s) - 0.2 * max(len(s) - 2, 0)
        return -round(value, 9), missing, -len(covered)

    best = min(itertools.combinations(docs, 3), key=order)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = X.beam_sets(
        frame([(1, d, x) for d, x in score.items()], "q long, doc long, score double"), frame([(1, a, b, w) for (a, b), w in pairs.items()], "q long, left long, right long, w double"),
        frame([(1, d, k, idf[k]) for d in docs for k in tokens[d]], "q long, doc long, token long, idf double"), frame([(1, d, 0.0, False, hubs[d]) for d in docs], "q long, doc long, channel double, support boolean, hubs long"), size=3, beam=200,
    ).first()
    assert sorted(map(int, got["docs"].split(","))) == list(best) and abs(got["score"] + order(best)[0]) < 1e-6
