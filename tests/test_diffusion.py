"""PageRank whose edges are kept once for all questions, on numbered nodes."""

import random

from pyspark.sql import functions as F

from lanternfold.operators import diffusion as D
from lanternfold.operators import graph as G


def test_edges_weighed_in_the_rounds_are_those_of_each_question(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(30), rng.randrange(40)): (rng.choice("xy"), rng.choice("uv"), rng.random() * 50) for _ in range(200)}
    edges = spark.createDataFrame([(*k, *v) for k, v in edges.items()], "src long, dst long, edge_type string, dst_type string, weight double")
    gates = spark.createDataFrame([(q, x, 0.1 + q) for q in (0, 1) for x in "xy"], "q long, edge_type string, gate double")
    priors = spark.createDataFrame([(q, x, 0.2 + ord(x) % 3) for q in (0, 1) for x in "uv"], "q long, dst_type string, prior double")
    reset = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (1, 3, 0.9), (1, 99, 0.1)], "q long, node long, weight double")
    matches = reset.withColumnRenamed("weight", "match")
    weigh = lambda rows: D.conditioned_edges(rows, gates, priors, matches)
    got = {(r["q"], r["node"]): r["p"] for r in D.pagerank(edges, reset, 0.45, 4, weigh).collect()}
    want = {(r["q"], r["node"]): r["p"] for r in D.pagerank(weigh(edges), reset, 0.45, 4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert all(abs(sum(p for (q, _), p in got.items() if q == k) - 1) < 1e-9 for k in (0, 1))


def test_each_round_is_kept(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    p = D.pagerank(edges, spark.createDataFrame([(0, 1, 1.0)], "q long, node long, weight double"), 0.5, 3)
    assert "Join" not in p._jdf.queryExecution().analyzed().toString()


def test_numbers_are_one_for_each_name(spark):
    rows = spark.createDataFrame([(f"p{k}", f"a{k % 7}") for k in range(50)] + [(None, "a1")], "passage string, s string")
    more = spark.createDataFrame([("lone",)], "node string")
    got, names = G.numbered(rows, ["passage", "s"], more, lambda c: c.rlike("^p[0-9]+$"))
    of = {r["node"]: r["id"] for r in names.collect()}
    assert len(of) == len(set(of.values())) == 58 and all(of[n] % 2 == (n[0] == "p") for n in of)
    assert got.where(F.col("passage").isNull()).count() == 1 and {r["s"] for r in got.collect()} == {of[f"a{k}"] for k in range(7)}
