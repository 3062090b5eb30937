"""What the fits of op6 and op9 learn from: no row of its own fold, and all learning rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spoor.llm import language, toxicity
from spoor.llm.linear import labelled_sample

from .test_text_operators import docs, empty, labelled, prose, rows_of  # noqa: F401


def test_a_row_does_not_bear_on_its_own_probability(spark, labelled):  # noqa: F811
    table, labels = labelled
    rows = labelled_sample(table, labels, toxicity.default_chain()).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(toxicity.FOLDS)).cast("int"))
    plain = rows.withColumn("leave", F.lit(1)).toArrow().combine_chunks()
    fold = plain["fold"].to_numpy()
    mine, other = np.flatnonzero(fold == 1), np.flatnonzero(fold != 1)
    assert len(mine) and len(other)

    def told(flip):
        y = plain["low_quality"].to_numpy().copy()
        y[flip] = 1 - y[flip]
        at = plain.schema.get_field_index("low_quality")
        out = toxicity._fit_fold("low_quality", ())(plain.set_column(at, "low_quality", pa.array(y, plain.schema.field(at).type)))
        return dict(zip(out["id"].to_pylist(), out["p"].to_pylist(), strict=True))

    p = told([])
    assert set(p) == {str(i) for i in plain["id"].take(pa.array(mine)).to_pylist()}
    assert told(mine) == p  # its labels and those of its fold don't matter
    assert told(other) != p  # the others' do


def test_out_of_fold_probabilities_cover_every_row(spark, labelled):  # noqa: F811
    table, labels = labelled
    rows = labelled_sample(table, labels, toxicity.default_chain()).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(toxicity.FOLDS)).cast("int"))
    each = rows.withColumn("leave", F.explode(F.sequence(F.lit(0), F.lit(toxicity.FOLDS))))
    got = each.groupBy("leave").applyInArrow(toxicity._fit_fold("low_quality", ()), "id string, p double, model binary")
    assert sorted(r["id"] for r in rows_of(got.where("model IS NULL"))) == sorted(str(r["id"]) for r in rows_of(rows))
    assert got.where("model IS NOT NULL").count() == 1


@pytest.fixture(scope="module")
def spoken(spark):
    return spark.createDataFrame([(f"l{i % 3}", " ".join("abc"[i % 3] * (2 + (i * 7 + k) % 5) + "xyz"[k % 3] for k in range(12))) for i in range(90)], "lang string, text string")


def test_document_frequencies_are_of_all_learning_rows(spoken):
    model = language.fit(spoken.unionByName(spoken), per_language=5)
    texts = pa.array([r["text"] for r in spoken.collect()] * 2)
    df = (language.counts(texts) > 0).sum(0)
    assert np.allclose(model.attrs["idf"], np.log((180 + 1) / (df + 1)) + 1, rtol=1e-6)


def test_centroids_are_means_of_their_members_and_floors_of_their_cosines(spoken):
    model = language.fit(spoken, per_language=1000, clusters=2, reject_quantile=0.0)
    idf = model.attrs["idf"]
    for lang, own in model.groupby("lang"):
        x = language.weighted(language.counts(pa.array(sorted({r["text"] for r in spoken.where(F.col("lang") == lang).collect()}))), idf)
        c = np.stack(own["centroid"].to_list())
        assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-4)
        nearest = (x @ c.T).argmax(1)
        for j in range(len(c)):
            members = x[nearest == j]
            mean = members.mean(0)
            assert np.linalg.norm(c[j] - mean / np.linalg.norm(mean)) < 0.05
            assert np.isclose((members @ c[j]).min(), own["floor"].iloc[j], atol=1e-3)


def test_far_texts_are_rejected(spark, spoken):
    model = language.fit(spoken, per_language=1000)
    rows = [(i, r["text"]) for i, r in enumerate(spoken.limit(30).collect())] + [(100, "qqqq wwww vvvv rrrr"), (101, prose(3, 30))]
    told = {r["doc_id"]: r for r in rows_of(language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model))}
    assert told[100]["rejected"] and told[101]["rejected"]
    # a centroid rejects little of its own: at most its farthest text
    assert sum(told[i]["rejected"] for i in range(30)) <= 12 and all(told[i]["lang_pred"] == f"l{i % 3}" for i in range(30))
