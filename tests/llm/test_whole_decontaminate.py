"""Scores of decontamination are those of the whole benchmark, however the index is cut."""

import collections
import math

import pytest

from spoor.llm import decontaminate

from .test_text_operators import prose


def test_scores_do_not_depend_on_the_cut(spark, monkeypatch):
    items = [f"{prose(i, 20)} rare{i} word{i % 7} {prose(i + 100, 8)}? {prose(i + 200, 6)} end{i % 5}" for i in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    partial = [t.replace(f" rare{i}", "") for i, t in enumerate(items)]
    docs = spark.createDataFrame(list(enumerate(partial)), "doc_id long, text string")
    score = lambda: {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find_leaks(docs, bench, threshold=0.3).collect()}
    whole = score()
    words = [t.replace("?", "").split() for t in items]
    df = collections.Counter(w for t in words for w in set(t))
    mean = sum(map(len, words)) / len(words)

    def weight(w, t):
        tf = t.count(w)
        return math.log1p((len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))

    for i, t in enumerate(words):
        have = set(partial[i].replace("?", "").split())
        assert whole[i, i] == pytest.approx(sum(weight(w, t) for w in set(t) & have) / sum(weight(w, t) for w in set(t)), abs=1e-5)
    for index, group in ((8, 4096), (8, 20)):
        monkeypatch.setattr(decontaminate, "INDEX", index)
        monkeypatch.setattr(decontaminate, "GROUP", group)
        cut = score()
        assert cut == pytest.approx(whole, abs=1e-5)
