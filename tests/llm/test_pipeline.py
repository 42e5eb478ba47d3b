"""The corpus pipeline, stage by stage, against what each stage has to do."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from harrow.llm import chosenpath, mixing, toxicity
from tests.llm.test_operators import DOCS, ODD, brute_jaccard, brute_removed, check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        steps[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
        assert name == "packing" or docs.columns == columns

    before, after = steps["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if model.score(r["text"]) < 0.5}

    before, after = steps["ngram_jaccard_join"]
    local = before.orderBy("doc_id").collect()
    _, roots = brute_jaccard([r["text"] for r in local])
    assert {r["doc_id"] for r in after.collect()} == {local[i]["doc_id"] for i in set(roots)}

    before, after = steps["suffix_array_dedup"]
    local = before.orderBy("doc_id").collect()
    want = brute_removed([r["text"] for r in local], 200)
    kept = {r["doc_id"]: r for r in after.collect()}
    for r, (size, removed, _, _) in zip(local, want, strict=True):
        assert kept[r["doc_id"]]["n_chars"] == len(kept[r["doc_id"]]["text"])
        if not removed:
            assert kept[r["doc_id"]]["text"] == r["text"]
        assert len(kept[r["doc_id"]]["text"].encode()) <= size - removed

    before, after = steps["mixing"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({d: n for d, n in plan.items() if n})

    before, after = steps["packing"]
    check_packing(spark, before, after.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "mixing", "packing"]


def test_stages_take_odd_and_empty_tables(spark):
    odd = spark.createDataFrame(ODD, DOCS).withColumn("_row", F.lit(1))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0 and (name == "packing" or out.columns == docs.columns)
    assert np.isfinite(chosenpath.runs_needed())
