"""Hand-made inputs with exact expected lists."""

import pytest
from pyspark.sql import functions as F

from lanternfold.functions import text as T
from lanternfold.operators import fusion, selection
from lanternfold.operators.ranking import rank_scores
from lanternfold.operators.roles import terminal_roles, valid_roles


def channels(spark, *lists, scores=None):
    rows = [(0, f"r{c}", c, k + 1, d, float(scores[c][k]) if scores else float(-k)) for c, docs in enumerate(lists) for k, d in enumerate(docs)]
    return spark.createDataFrame(rows, "q long, channel string, cpos int, rank long, doc long, score double")


def docs(df):
    return [r["doc"] for r in df.orderBy("pos").collect()]


def test_reciprocal_rank_fusion_counts_raw_positions(spark):
    got = fusion.reciprocal_rank_fusion(channels(spark, [1, 2, 2], [3, 1]), k=0, top=3).orderBy("pos").collect()
    assert [r["doc"] for r in got] == [1, 3, 2] and [r["score"] for r in got] == [1.5, 1.0, 0.5]


def test_round_robin(spark):
    assert docs(fusion.round_robin(channels(spark, [1, 2], [3, 1, 4]), 4)) == [1, 3, 2, 4]


def test_best_channel_first(spark):
    assert docs(fusion.best_channel_first(channels(spark, [1, 2], [3, 1], scores=[[0.5, 0.2], [0.9, 0.1]]), 3)) == [3, 1, 2]


def test_pointwise_score(spark):
    got = fusion.pointwise_score(channels(spark, [1, 2], [2, 3], scores=[[0.9, 0.1], [0.8, 0.4]]), 3).orderBy("pos").collect()
    assert [r["doc"] for r in got] == [1, 2, 3] and [r["score"] for r in got][:2] == [1.0, 1.0]


def test_rank_scores(spark):
    given = channels(spark, [10, 11, 12], scores=[[0.2, 0.6, 1.0]])
    assert [round(r["norm"], 6) for r in rank_scores(given, ["q"], "rank", "score").orderBy("rank").collect()] == [0, 0.5, 1]
    flat = channels(spark, [10, 11, 12], scores=[[0.0, 0.0, 0.0]])
    assert [r["norm"] for r in rank_scores(flat, ["q"], "rank", "score").orderBy("rank").collect()] == [1, 0.5, 0]


def test_pools(spark):
    ch = channels(spark, [1, 2, 3], [2, 4, 5])
    assert docs(fusion.balanced_pool(ch, 2)) == [1, 2, 4]
    seeds = spark.createDataFrame([(0, 9, 1)], "q long, doc long, rank long")
    assert docs(fusion.balanced_pool(ch, 2, seeds=seeds)) == [9, 1, 2, 4]
    deep = channels(spark, [1, 2, 3, 9], [4, 2, 5, 9], [6, 7, 8, 9])
    assert docs(fusion.cross_channel_pool(deep, base=1, deep=4, support=3)) == [1, 4, 6, 9]
    terminal = spark.createDataFrame([(0, "r1")], "q long, channel string")
    assert docs(fusion.terminal_pool(channels(spark, [1, 2, 3], [4, 5, 6]), terminal, base=1, deep=3, limit=2)) == [1, 4, 5, 6]
    assert docs(fusion.rolewise_pool(channels(spark, [4, 1], [5, 4]), 2, 5)) == [4, 1, 5]


def test_terminal_roles(spark):
    listed = spark.createDataFrame([(0, 0, "r0"), (0, 1, "r1")], "q long, pos long, role_id string")
    one_way = spark.createDataFrame([(0, "r0", "r1")], "q long, role_id string, to_id string")
    both = spark.createDataFrame([(0, "r0", "r1"), (0, "r1", "r0")], "q long, role_id string, to_id string")
    for links in (one_way, both):
        assert [r["role_id"] for r in terminal_roles(listed, links).collect()] == ["r1"]


def test_valid_roles(spark):
    given = spark.createDataFrame([(0, 0, "r0", "a"), (0, 1, "r0", "b"), (0, 2, "r1", "  "), (0, 3, "", "d")], "q long, pos long, role_id string, description string")
    assert [r["role_id"] for r in valid_roles(given).orderBy("pos").collect()] == ["r0", "r3"]


@pytest.mark.parametrize(("weight", "base", "scores", "k", "expected"), [
    (0.1, {0: 1.0, 1: 0.95, 2: 0.9}, {0: {"g": 1.0}, 1: {"g": 0.95}, 2: {"a": 1.0}}, 2, [0, 2]),
    (10.0, {0: 1.0, 1: 0.95, 2: 0.2}, {0: {"g": 1.0}, 1: {"g": 0.95}, 2: {"a": 1.0}}, 2, [0, 1]),
    (0.0, {0: 0.0, 1: 0.0}, {1: {"answer": 0.8}}, 1, [1]),
])
def test_role_coverage(spark, weight, base, scores, k, expected):
    frame = spark.createDataFrame([(0, d, p + 1, s) for p, (d, s) in enumerate(base.items())], "q long, doc long, pos long, score double")
    roles = spark.createDataFrame([(0, d, r, s) for d, m in scores.items() for r, s in m.items()], "q long, doc long, role string, s double")
    assert docs(selection.role_coverage(frame, roles, k, weight)) == expected


def test_pointwise_merge(spark):
    frame = spark.createDataFrame([(0, d, d + 1, 0.0) for d in range(3)], "q long, doc long, pos long, score double")
    roles = spark.createDataFrame([(0, 0, "r0", 1.0), (0, 0, "r1", 1.0), (0, 1, "r0", 1.0), (0, 1, "r1", 0.0), (0, 2, "r0", 0.0), (0, 2, "r1", 1.0)], "q long, doc long, role string, s double")
    assert docs(selection.pointwise_merge(frame, roles, 2)) == [0, 1]


def test_role_query_and_selector_answer(spark):
    row = spark.range(1).select(T.role_query(F.lit("Who wrote X?"), F.lit("identify the writer")).alias("q"), T.selected_ids(F.lit('x {"selected_ids": [3, 1, 3, 99]} y'), 10, 5).alias("ids")).first()
    assert row["q"] == "Question: Who wrote X?\nEvidence role: identify the writer" and row["ids"] == [3, 1]


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        fusion.candidate_pool(channels(spark, [1]), "no_such_policy")
    with pytest.raises(ValueError):
        selection.evidence_set(None, None, "no_such_construction")
    assert fusion.mainline_violations(dict(fusion.MAINLINE)) == [] and len(fusion.mainline_violations({})) == len(fusion.MAINLINE)
