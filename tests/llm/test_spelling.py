"""op11 against plain Python."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from spoor.llm import query_spelling, spelling
from spoor.llm.fm_index import WaveletMatrix


def brute(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return variants({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})


def variants(n):
    gaps = collections.defaultdict(set)  # deletion neighbourhoods
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :], True].add(w)
            if w[:i] + w[i + 1 :] in n:
                gaps["shorter", w, False].add(w[:i] + w[i + 1 :])
    near = collections.defaultdict(set)
    for (_, w, equal), group in gaps.items():
        if equal:
            for x in group:
                near[x] |= group - {x}
        else:
            near[w] |= group
            for x in group:
                near[x].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def random_words(seed, count):
    r = random.Random(seed)
    letters = "abé"
    out = {"".join(r.choice(letters) for _ in range(r.randint(5, 8))) for _ in range(count)}
    out |= {"internationali" + "".join(r.choice("stz") for _ in range(4)) for _ in range(60)} | {"aaaaaa", "aaaaaaa", "ÿÀ×÷ß", "ÿÀ×÷", "x" * 300, "x" * 299 + "y"}
    return {w: r.choice([3, 3, 4, 6, 7, 12, 50]) for w in sorted(out) if len(w) >= 5}


def test_texts_equal_plain_python(spark):
    r = random.Random(3)
    vocab = list(random_words(1, 120))
    rows = [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(vocab, k=r.randint(0, 90))) + ("1x-" if i % 3 else "")) for i in range(60)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (None, None), (61, ""), (62, "12 .. 34"), (63, ("Wörter, größer! " * 400) + "y" * 50_000)]
    table = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, word string")
    got = rows_of(spelling.group_variants(spelling.vocabulary(spelling.runs(table))))
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("shard,hot", [(100_000, 100_000), (5, 4), (50, 10)])
def test_dictionary_equals_plain_python(spark, monkeypatch, shard, hot):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "AT_ONCE", 7)
    n = random_words(2, 400)
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = rows_of(spelling.group_variants(table, hot=hot))
    assert len(got) == len(n) and set(got) == variants(n)


def test_shards_are_cut_between_keys():
    import pyarrow as pa

    keys = list("aaabbbbcdddddd")
    t = pa.table({"c": [5] * 10 + [6] * 4, "lo": [0] * 14, "hi": [2] * 14, "key": keys, "word": [f"w{i}" for i in range(14)], "n": [3] * 14})
    old, spelling.SHARD = spelling.SHARD, 5
    try:
        assert spelling._cuts(t, 14) == ([(0, 3), (3, 8), (8, 10), (10, 14)], 14)
        assert spelling._cuts(t, None) == ([(0, 3), (3, 8), (8, 10)], 10)
    finally:
        spelling.SHARD = old


def test_long_chains_end_at_the_root(spark):
    # each word varies from the next one, with twice the count
    chain = ["aaaaa" + "b" * k for k in range(9)]
    got = {r[0]: r for r in rows_of(spelling.group_variants(spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")))}
    assert all(got[w][2] == chain[-1] for w in chain) and got[chain[-1]][1] is None


def test_empty(spark):
    assert rows_of(spelling.group_variants(spark.createDataFrame([], "word string, n long"))) == []


def test_rectangles(spark):
    rng = np.random.default_rng(5)
    v = rng.permutation(300)
    w = WaveletMatrix(v, 300)
    for a, b, low, high in rng.integers(0, 301, (50, 4)):
        q, s = w.report(*(np.array([x]) for x in (a, max(a, b), low, high)))
        assert sorted(s) == sorted(x for x in v[a : max(a, b)] if low <= x < high)


def test_query_on_whole_table(spark):
    got = rows_of(query_spelling.query(spark, "/root/testdata/sf0.001"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
