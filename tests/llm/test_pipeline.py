"""The corpus pipeline on the smallest tables, stage by stage against plain Python."""

import re

import corpus_pipeline
from lanternfold.llm import toxicity
from lanternfold.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialise(stage(spark, docs, SF), f"test-{k}")
        if k < 4:
            assert after.columns == columns
        left = {r["doc_id"] for r in after.collect()}
        assert left <= set(before)
        if name == "exact dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]+", " ", before[i]) for i in left]
            assert len(texts) == len(set(texts))
        if name == "benchmark decontamination":
            assert not [i for i in left if any(x in before[i] for x in items)]
            assert {i for i in before if not any(x in before[i] for x in items)} <= left
        before = {i: before[i] for i in left}
        docs = after
    assert after.where("n_tokens < 2").count() == 0
    assert 0 < toxicity.THRESHOLD < 1
