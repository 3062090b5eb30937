"""The pipeline's second and third stage on repeated rows, rows without id, and ids with two texts."""

import pytest

from .test_text_operators import DOCS, prose

pipeline = pytest.importorskip("corpus_pipeline")


def test_one_row_of_each_class_stays(spark, tmp_path):
    a, b, c, d, e = (prose(20 + i, 90) for i in range(5))
    near = a.split()
    near[40] = "changed"
    rows = [(5, a), (5, a), (None, a), (9, " ".join(near)), (None, b), (None, b), (5, c), (7, d), (3, d), (7, e)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), "", True) for i, t in rows], DOCS)
    for name in ("near_dedup", "substring_dedup"):
        dict(pipeline.STAGES)[name](spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        assert got == sorted([(5, a), (None, b), (5, c), (3, d), (7, e)], key=str), name
