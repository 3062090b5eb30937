"""Mixing, decontamination, toxicity and languages against plain Python, and what their rules for odd rows say."""

import collections
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.llm import decontaminate, language, linear, minhash, mixing, toxicity

from .test_text_operators import docs, empty, labelled, prose, rows_of  # noqa: F401


def nonnegative_least_squares(a, b):
    """Lawson and Hanson's active set, with plain least squares: an independent solver."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    w = a.T @ (b - a @ x)
    while (~passive).any() and w[~passive].max() > 1e-12:
        passive[np.flatnonzero(~passive)[w[~passive].argmax()]] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if not passive.any() or s[passive].min() > 0:
                break
            low = passive & (s <= 0)
            x = x + (x[low] / (x[low] - s[low])).min() * (s - x)
            passive &= x > 1e-15
            x[~passive] = 0
        x = s
        w = a.T @ (b - a @ x)
    return x


def plain_measure(w, p):
    return lambda descent, function: function(descent.rates(p), w, p) / w.sum()


def test_every_attainable_target_is_met():
    g = np.random.default_rng(0)
    for trial in range(500):
        n, k = int(g.integers(5, 200)), int(g.integers(2, 5))
        p = g.dirichlet(np.ones(k) * g.choice([0.1, 0.3, 1, 5]), n)
        w = g.integers(1, 2000, n).astype(float)
        rate = np.where(g.random(n) < g.choice([0.1, 0.5, 0.9]), g.exponential(1, n), 0)
        if not rate.any():
            rate[0] = 1
        share = mixing.totals(rate, w, p)
        share /= share.sum()
        descent, reached, converged = mixing.descend(plain_measure(w, p), share)
        got = mixing.totals(descent.rates(p), w, p) / w.sum()
        assert converged and np.allclose(got, reached) and (np.abs(got - share) <= 1.01e-4 * share).all(), trial
        assert descent.rates(p).min() >= 0
        if trial % 25 == 0:
            a = (p * w[:, None] / w.sum()).T
            assert np.linalg.norm(a @ nonnegative_least_squares(a, share) - share) < 1e-8


def test_targets_out_of_reach_end_at_the_least_squares():
    g = np.random.default_rng(2)
    for _ in range(40):
        n, k = int(g.integers(5, 60)), int(g.integers(2, 5))
        p, w = g.dirichlet(np.ones(k) * 5, n), g.integers(1, 2000, n).astype(float)
        share = np.full(k, 1e-3)
        share[0] = 1 - 1e-3 * (k - 1)
        _, reached, converged = mixing.descend(plain_measure(w, p), share)
        a = (p * w[:, None] / w.sum()).T
        least = np.linalg.norm(a @ nonnegative_least_squares(a, share) - share)
        assert not converged and np.linalg.norm(reached - share) <= least * 1.01 + 1e-9


def test_one_domain_short_of_a_large_share():
    g = np.random.default_rng(3)
    p, w = g.dirichlet([4, 2, 0.2], 400), g.integers(10, 3000, 400).astype(float)
    share = np.array([0.6, 0.39, 0.01])
    assert mixing.descend(plain_measure(w, p), share)[2]
    best = p[p[:, 0].argmax()]
    assert mixing.descend(plain_measure(w, p), best * 0.999 + 0.001 * p.mean(0))[2]


def test_rates_of_rows_equal_plain_descent(spark, labelled):  # noqa: F811
    table, labels = labelled
    targets = {"good": 0.7, "rough": 0.28, "toxic": 0.02}
    out = mixing.mix(table.unionByName(table.where("doc_id < 5")), labels.unionByName(labels), targets, strict=True)
    rows = rows_of(out.rows)
    w = np.array([r["n_tokens"] for r in rows], float)
    p = np.array([[r[f"p_{k}"] for k in targets] for r in rows])
    r = np.array([x["rate"] for x in rows])
    assert out.fit.converged and r.min() >= 0
    assert np.allclose(r, out.fit.descent.rates(p), atol=1e-9)
    for j, k in enumerate(targets):
        assert math.isclose((w * r) @ p[:, j], out.fit.target[k], rel_tol=2e-4)
        assert math.isclose(out.fit.reached[k], out.fit.target[k], rel_tol=2e-4)
    assert math.isclose(sum(out.fit.target.values()), w.sum())


def test_targets_out_of_reach_are_told(spark):
    half = spark.createDataFrame([(i, prose(i, 30)) for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        out = mixing.mix(half, none, {"good": 0.9, "toxic": 0.1})  # without labels every posterior is a half
    assert not out.fit.converged and any("reached" in str(w.message) for w in told)
    assert min(r["rate"] for r in rows_of(out.rows)) >= 0


def brute_leaks(texts, items, threshold):
    """BM25 of every passage and entry by plain sums, then the overlaps."""
    import re

    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    entries = []
    for i, t in items:
        w = norm(t)
        n = max(1, -(-len(w) // decontaminate.ENTRY))
        cuts = [len(x) for x in np.array_split(np.arange(len(w)), n)]
        at = 0
        for c in cuts:
            if c:
                entries.append((i, w[at : at + c]))
            at += c
    df = collections.Counter(x for _, w in entries for x in set(w))
    mean = sum(len(w) for _, w in entries) / len(entries)

    def weight(x, w):
        tf = w.count(x)
        return math.log1p((len(entries) - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))

    runs = lambda w: set(zip(w, w[1:], w[2:]))
    best = {}
    for d, t in texts:
        w = norm(t)
        for s in range(0, len(w), decontaminate.STRIDE):
            have = set(w[s : s + decontaminate.PASSAGE])
            for i, e in entries:
                score = sum(weight(x, e) for x in set(e) & have) / sum(weight(x, e) for x in set(e))
                if score < threshold:
                    continue
                raw = next(x for j, x in items if j == i)
                q, a = (set(norm(x)) for x in decontaminate.question_and_answer(raw))
                three = runs(norm(raw))
                near = w[max(0, s - decontaminate.ENTRY) : s + decontaminate.PASSAGE + max(decontaminate.ENTRY, len(three))]
                part = lambda x, y: len(x & y) / len(x) if x else 1.0
                if min(part(q, set(near)), part(a, set(near))) >= decontaminate.PARTS_OVERLAP and part(three, runs(near)) >= decontaminate.RUNS_OVERLAP:
                    best[d, i] = max(score, best.get((d, i), 0))
    return best


def test_leaks_equal_plain_search(spark, monkeypatch):
    items = [(i, f"{prose(500 + i, 12).capitalize()} asked{i % 9}? {prose(600 + i, 9)} end{i % 4}.") for i in range(20)]
    items += [(50, prose(900, 150)), (51, items[3][1]), (52, "Only question?"), (53, "?? !!"), (54, "one")]
    texts = [(k, prose(k, 60) + " " + items[k][1] + " " + prose(k + 40, 50)) for k in range(0, 12, 2)]
    for k in (1, 3, 5):  # partial leaks: some words lost or changed
        w = items[k][1].split()
        texts.append((100 + k, prose(k, 40) + " " + " ".join(x for j, x in enumerate(w) if j % (k + 2))))
    texts += [(200, items[20][1]), (201, None), (202, ""), (203, prose(7, 900)), (204, items[5][1]), (204, items[5][1])]
    bench = spark.createDataFrame([(*x, "clash") for x in items] + [(90, None, "x")], "item_id long, text string, score string")
    table = spark.createDataFrame([(*x, 0.5, "y") for x in texts], "doc_id long, text string, score double, item_id string")
    want = brute_leaks(texts, items, decontaminate.THRESHOLD)
    for index, group in ((256, 4096), (8, 16)):
        monkeypatch.setattr(decontaminate, "INDEX", index)
        monkeypatch.setattr(decontaminate, "GROUP", group)
        got = rows_of(decontaminate.find_leaks(table.select("doc_id", "text"), bench))
        assert {(r["doc_id"], r["item_id"]) for r in got} == set(want) and want
        assert all(math.isclose(r["score"], want[r["doc_id"], r["item_id"]], abs_tol=1e-5) for r in got)
    kept = decontaminate.decontaminate(table, bench)
    assert kept.columns == table.columns
    assert collections.Counter(r["doc_id"] for r in rows_of(kept)) == collections.Counter(d for d, _ in texts if d not in {x for x, _ in want})


def test_toxicity_of_repeated_rows(spark, labelled):  # noqa: F811
    table, labels = labelled
    many = table.where("doc_id < 4")
    for _ in range(4):
        many = many.unionByName(many)
    clash = labels.where("doc_id < 4").unionByName(spark.createDataFrame([(1, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int"))
    sample = rows_of(linear.labelled_sample(many, clash, toxicity.default_chain()))
    assert sorted((r["id"], r["low_quality"], r["toxic"]) for r in sample) == [("0", 1, 1), ("1", 0, 1), ("2", 0, 0), ("3", 0, 0)]
    named = table.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).withColumn("toxic", F.lit("clash")).withColumn("p_toxic", F.lit(1))
    models = toxicity.train(named, labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert len(models["toxic"].slots) and 0 < models["toxic"].mean[-1] < 1  # the mean of a probability
    twice = named.unionByName(named).unionByName(spark.createDataFrame([(None, None, "", 0), ("long", "nasty vile words " + prose(3, 60_000), "", 0)], named.schema))
    out = collections.defaultdict(set)
    for r in rows_of(toxicity.predict(twice, models)):
        out[r["doc_id"]].add((r["p_low_quality"], r["p_toxic"], r["toxic"]))
    assert all(len(v) == 1 for v in out.values()) and len(out) == 402
    assert all(next(iter(out[f"d{i}"]))[2] == (i % 5 == 0) for i in range(300, 400))


def test_chain_equals_a_plain_forward_pass(spark, labelled):  # noqa: F811
    table, labels = labelled
    models = toxicity.train(table, labels)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    import pyarrow as pa

    for r in rows_of(toxicity.predict(table.where("doc_id > 390"), models)):
        text = next(x["text"] for x in rows_of(table) if x["doc_id"] == r["doc_id"])
        _, slot, plain = linear.features(pa.array([text]))
        dense, p = list(plain[0]), None
        for m in models.values():
            weight = dict(zip(m.slots.tolist(), m.weights.tolist(), strict=True))
            z = sum(weight.get(s, 0.0) for s in slot.tolist()) + m.bias
            z += sum(min(5, max(-5, (x - a) / b)) * c for x, a, b, c in zip(dense, m.mean, m.scale, m.dense, strict=True))
            p = sigmoid(z)
            dense.append(p)
        assert math.isclose(p, r["p_toxic"], rel_tol=1e-9)


def test_languages_equal_the_nearest_centroid(spark, docs):  # noqa: F811
    langs = {"aa": "the and with from", "bb": "der die und nicht", "cc": "les des avec pour"}
    rows = [(k, (f"{v} " * 6) + prose(i, 4)) for i in range(30) for k, v in langs.items()]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    texts = [(1, "Der Hund UND die Katze", "x"), (1, "Der Hund UND die Katze", "x"), (2, "les chats avec des chiens", "y"), (None, "the end", None), (3, "the " * 30_000, "z"), (4, "été", "z"), (5, "a", "z")]
    table = spark.createDataFrame(texts, "doc_id long, text string, lang_pred string")
    got = rows_of(language.predict(table, model, ("doc_id", "text")))
    idf = model.attrs["idf"]
    M = (1 << 32) - 1
    for r in got:
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in r["text"].encode())
        data = [b if 97 <= b <= 122 or b >= 128 else 32 for b in data]
        found = collections.Counter()
        for n in (2, 3):
            for i in range(len(data) - n + 1):
                if data[i] == data[i + 1] == 32:
                    continue
                pair = (data[i] * 0x9E3779B1 + data[i + 1] * 0x85EBCA77) & M
                code = pair * 0x85EBCA77 & M if n == 2 else ((pair + data[i + 2] * 0xC2B2AE3D) & M) * 0x9E3779B1 & M
                found[code >> 20] += 1
        v = np.zeros(language.DIMS)
        if len(data) >= 3:
            for k, c in found.items():
                v[k] = math.log1p(c) * idf[k]
        v /= np.linalg.norm(v) or 1
        cos = np.stack(model["centroid"].to_list()) @ v
        assert abs(max(cos) - r["score"]) < 1e-4
        best = {model["lang"][i] for i in np.flatnonzero(cos > max(cos) - 1e-5)}
        assert r["lang_pred"] in best
    assert len(got) == len(texts)


def test_a_full_sketch_splits_no_short_list(spark):
    """As many documents as make every slot of the sketch look long: postings of short lists are not copied."""
    posts = [(k // 3, k, k, 10, 0, 0, 0, 5_000_000) for k in range(9)]
    table = spark.createDataFrame(posts, f"{minhash.POSTING}, often int")
    met = minhash._met(table, np.full(minhash.SKETCH, 5_000_000, np.int32), False, 80)
    assert {tuple(r) for r in met.collect()} == {(a, b) for a in range(9) for b in range(9) if a < b and a // 3 == b // 3}
    assert "length" not in met._jdf.queryExecution().executedPlan().toString()  # nothing goes to pairs of blocks


def test_collisions_decide(spark):
    a = np.arange(2 * minhash.K, dtype=np.uint32).reshape(2, -1)
    b = a.copy()
    b[0, : minhash.K - minhash.T] += 1
    b[1, : minhash.K - minhash.T + 1] += 1
    assert minhash.collisions(a, b).tolist() == [minhash.T, minhash.T - 1]


@pytest.mark.parametrize("size", [2, 5])
def test_recall_of_pairs_just_over_the_threshold(spark, size):
    """Pairs that share from 80 to 85 percent of their shingles are linked, those just below are not."""
    rows, want = [], {}
    for k in range(40):
        w = [f"w{k}x{j}" for j in range(100)]
        cut = 7 + k % 5 if k % 2 else 14
        other = w[: 100 - cut] + [f"v{k}x{j}" for j in range(cut)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
        n = 100 - size + 1
        same = n - cut
        want[2 * k + 1] = 2 * k if 100 * same >= 80 * (2 * n - same) else 2 * k + 1
    got = {r["doc_id"]: r["component_id"] for r in rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size).rows)}
    assert {k: got[k] for k in want} == want and 5 < sum(k != v for k, v in want.items()) < 40
