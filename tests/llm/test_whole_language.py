"""Language centroids are learnt from distinct texts, whatever the copies."""

from spoor.llm import language

from .test_text_operators import prose


def test_every_language_is_learnt_and_copies_are_one_row(spark):
    copies = [f"der hund und die katze {i} {prose(i, 5)}" for i in range(3)]
    many = [f"le chat et le chien {prose(i, 8)} {i}" for i in range(300)]
    rows = [("de", t) for t in copies] * 1000 + [("fr", t) for t in many] + [("fr", many[7])] * 5000 + [("it", "abc"), ("it", "12")]
    train = spark.createDataFrame(rows, "lang string, text string")
    drawn = {}
    for r in language._drawn(train, 30).collect():
        assert (r["lang"], r["text"]) not in drawn
        drawn[r["lang"], r["text"]] = r["weight"]
    assert {k[1]: v for k, v in drawn.items() if k[0] == "de"} == dict.fromkeys(copies, 1000)
    assert drawn["fr", many[7]] == 5001
    assert 1 < sum(k[0] == "fr" for k in drawn) <= 80
    model = language.fit(train, per_language=30)
    assert set(model["lang"]) == {"de", "fr", "it"}
    out = language.predict(spark.createDataFrame([(0, copies[0]), (1, many[5])], "doc_id long, text string"), model)
    assert [r["lang_pred"] for r in out.orderBy("doc_id").collect()] == ["de", "fr"]
