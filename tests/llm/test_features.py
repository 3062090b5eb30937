"""The features of the classifiers cost a few times what their words do, and are those of plain Python."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest

from spoor.llm import common, linear, mixing, toxicity

from .test_text_operators import WORD, rows_of


@pytest.fixture(scope="module")
def texts():
    g = np.random.default_rng(5)
    vocabulary = np.array(["".join(chr(97 + c) for c in g.integers(0, 26, g.integers(2, 11))) for _ in range(20_000)])
    return pa.array([" ".join(vocabulary[(g.random(g.integers(50, 600)) ** 3 * 20_000).astype(int)]) + " A9%\n|!" * (i % 4) for i in range(2_000)])


@pytest.fixture(scope="module")
def models(texts):
    row, slot, dense = linear.features(texts)
    y = np.bincount(row, weights=slot < linear.DIMS // 20, minlength=len(texts))
    return [linear.fit(row, slot, dense, (y > np.quantile(y, q)).astype(float), rounds=20) for q in (0.3, 0.5, 0.7)]


def least_seconds(f):
    took = []
    for _ in range(5):
        began = time.process_time()
        f()
        took.append(time.process_time() - began)
    return min(took)


def test_posteriors_take_a_few_times_as_long_as_the_words(texts, models):
    domains = mixing.Domains(["a", "b", "c"], models)
    assert min(len(m.slots) for m in models) > 100
    base = least_seconds(lambda: common.words(texts))
    assert least_seconds(lambda: domains.posteriors(texts)) < 5 * base
    assert least_seconds(lambda: linear.features(texts)) < 5 * base


def test_features_are_those_of_plain_python(texts):
    odd = pa.array(["", None, "  ", "One one ONE", "À À! 12%|\n#", *texts.slice(0, 30).to_pylist(), ""])[1:]
    row, slot, plain = linear.features(odd)
    got = {i: set() for i in range(len(odd))}
    for r, s in zip(row.tolist(), slot.tolist(), strict=True):
        got[r].add(s)
    assert len(row) == sum(map(len, got.values())) and (np.diff(row * linear.DIMS + slot) > 0).all()
    for i, t in enumerate(odd.to_pylist()):
        raw = (t or "").encode()
        found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
        hashes = common.words(pa.array([b" ".join(found).lower().decode()])).hash
        assert got[i] == set((hashes >> np.uint64(46)).tolist())
        share = [len(re.findall(p, raw)) / max(1, len(raw)) for p in (rb"[A-Z]", rb"[#*$%&<>]", rb"[0-9]", rb"!", rb"\|", rb"\n")]
        assert plain[i].tolist() == [np.log1p(len(found)), *share, max(1, len(raw)) / max(1, len(found)) / 10]


def test_slots_that_no_model_weighs_do_not_matter(texts, models):
    every, few = linear.features(texts), linear.features(texts, linear.used_slots(models))
    assert len(few[0]) < len(every[0])
    for m in [*models, linear.blank(linear.PLAIN)]:
        assert np.array_equal(m.logits(*every), m.logits(*few))


def test_predictions_use_only_weighed_slots(spark, texts, models):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts.slice(0, 50).to_pylist())], "doc_id long, text string")
    row, slot, dense = linear.features(texts.slice(0, 50))
    p = linear.sigmoid(models[0].logits(row, slot, dense))
    got = {r["doc_id"]: r["p_a"] for r in rows_of(toxicity.predict(rows, {"a": models[0]}))}
    assert [got[i] for i in range(50)] == p.tolist()


def test_word_counts_are_those_of_the_words(texts):
    odd = pa.array([None, "", " a\tb\x0b ", "À b", "x", "y", *texts.slice(0, 20).to_pylist(), "\n"])
    assert common.word_counts(odd[1:]).tolist() == [len(WORD.findall(t or "")) for t in odd.to_pylist()[1:]]
    assert common.word_counts(pa.array(["", None])).tolist() == [0, 0]
