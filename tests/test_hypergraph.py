"""Edges of the hypergraph: each once, without a shuffle of all of them."""

from lanternfold.operators import graph as G


def test_edges_are_once_whatever_passages_are_called(spark):
    rows = [("p1", "a", "r", "b"), ("p1", "a", "r", "b"), ("p2", "a", "r", "b"), ("p2", "c", "r", "c"), ("prop-x", "a", "q", "c")]
    h = G.hyperedges(spark.createDataFrame(rows, "passage string, s string, r string, o string")).collect()
    rows += [("p3", "x|y", "z", "w"), ("p3", "x", "y|z", "w")]  # two triples of one id
    rows += [(x["h"], "a", "r", "b") for x in h] + [(x["h"], "c", "r", "c") for x in h]
    triples = spark.createDataFrame(rows, "passage string, s string, r string, o string")
    edges = G.hypergraph_edges(triples)
    got = sorted(map(tuple, edges.collect()))
    assert got == sorted(map(tuple, G.deduplicated(edges).select(*edges.columns).collect()))
    roles = {r["weight"] for r in edges.where("edge_type = 'entity_hyperedge'").collect()}
    assert roles == {1.1, 1.2}
    assert edges.count() == edges.select("src", "dst", "edge_type").distinct().count()
    # the edges of both ways pass no aggregate together
    top = edges._jdf.queryExecution().analyzed().toString().splitlines()[0]
    assert top.startswith("Union")


def test_edges_of_facts_with_an_id_each_pass_no_aggregate(spark):
    rows = [("p1", "a", "r", "b"), ("p1", "a", "r", "b"), ("p2", "a", "r", "b"), ("p2", "c", "r", "c"), ("p3", "a", "q", "c")]
    triples = spark.createDataFrame(rows, "passage string, s string, r string, o string")
    edges = G.hypergraph_edges(triples)
    plan = edges._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Aggregate" in x and ("edge_type" in x or "src" in x)]
    rounded = lambda df: sorted((x["src"], x["dst"], x["edge_type"], round(x["weight"], 9), x["support"]) for x in df.collect())
    assert rounded(edges) == rounded(G.deduplicated(G._edges_made_distinct(triples)))
