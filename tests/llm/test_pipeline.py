"""The pipeline's stages on the small tables, each held against what it got."""

import os

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_in_order(spark, tmp_path):
    from .test_text_operators import WORD, brute_components, brute_strip

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        seen[name] = before, after
        assert set(after) <= set(before)
        assert docs.columns[: len(columns)] == columns
        if name != "mix":
            assert docs.columns == columns
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontaminate", "mix"]
    before, after = seen["quality_rules"]
    assert all(len(WORD.findall(before[i] or "")) >= 50 for i in after)
    before, after = seen["near_dedup"]
    want = brute_components(list(before.items()), pipeline.SHINGLE, pipeline.SIMILAR)
    assert set(after) == {i for i, (_, low) in want.items() if i == low}
    before, after = seen["substring_dedup"]
    for i, (n, gone, rest) in zip(before, brute_strip(list(before.values()), 35)):
        assert (i not in after) if gone and gone == n else after[i] == (rest if gone else before[i])
    items = [WORD.findall(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = seen["decontaminate"]
    for i, t in before.items():
        line = " ".join(WORD.findall((t or "").lower()))
        assert (i not in after) == any(" ".join(w) in line for w in items)
    assert docs.where(F.col("rate") <= 0).count() == 0
