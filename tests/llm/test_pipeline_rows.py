"""Each stage of the pipeline, in sequence, on odd rows: nulls, empty texts, repeated rows, columns with clashing names."""

import collections

import pytest

from .test_text_operators import prose

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "kept_text string, doc_id long, n_words long, text string, source string, n_removed string, rate int, _row int, _host string, h int, item_id long, length int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    leak = prose(70, 30) + " planted end of item"
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    whole = prose(1, 80)
    run = prose(90, 45)
    rows = [
        (1, whole, "a"), (1, whole, "a"), (None, whole, None), (2, prose(2, 80), None), (2, prose(2, 80), None),
        (3, None, "a"), (4, "", "a"), (None, None, None), (5, prose(3, 60) + " " + run, "b"), (6, prose(4, 60) + " " + run, "b"),
        (7, prose(5, 70) + "\n" + leak.upper() + "\n" + prose(6, 60), "a"), (8, " ".join(f"long{i}" for i in range(30_000)), "c"), (9, "\x0b\t \n" * 50, "a"),
        (10, "short text", "a"), (None, prose(11, 90), "c"),
    ]
    return at, spark.createDataFrame([("k", i, -5, t, s, "gone", 3, 4, "host", 5, 6, 7) for i, t, s in rows], SCHEMA), leak, run


def test_stages_on_odd_rows(spark, tables, tmp_path):
    at, docs, leak, run = tables
    seen = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "mix":
            assert docs.columns == COLUMNS
            assert all((r["kept_text"], r["n_words"], r["n_removed"], r["rate"], r["_row"], r["_host"], r["h"], r["item_id"], r["length"]) == ("k", -5, "gone", 3, 4, "host", 5, 6, 7) for r in seen[name])
    ids = {k: collections.Counter(r["doc_id"] for r in v) for k, v in seen.items()}
    assert ids["quality_rules"] == {1: 2, None: 2, 2: 2, 5: 1, 6: 1, 7: 1, 8: 1}
    assert ids["near_dedup"] == {1: 1, 2: 1, 5: 1, 6: 1, 7: 1, 8: 1, None: 1}
    assert ids["substring_dedup"] == ids["near_dedup"]
    assert all(run not in r["text"] for r in seen["substring_dedup"])
    assert sorted(len(r["text"].split()) for r in seen["substring_dedup"] if r["doc_id"] in (5, 6)) == [60, 60]
    assert ids["decontaminate"] == {k: v for k, v in ids["near_dedup"].items() if k != 7}
    assert all(r["rate"] > 0 and r["n_tokens"] > 0 for r in seen["mix"]) and ids["mix"] == ids["decontaminate"]


@pytest.mark.filterwarnings("ignore:domain targets")
def test_stages_on_an_empty_table(spark, tables, tmp_path):
    at, docs, _, _ = tables
    docs = docs.limit(0)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(stage(spark, docs, at).schema).parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
