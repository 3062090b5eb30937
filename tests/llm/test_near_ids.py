"""op10 where one doc_id has several texts, or rows repeat."""

import random

import pytest

from spoor.llm import minhash

from .test_text_operators import prose


def sets_of(text, size):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size):
    """Component of every doc_id: links between any of its texts and any of another's."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, sets_of(t, size)) for i, t in rows if i is not None]
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in parent}


def check(spark, rows, size):
    got = [(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size).rows.collect()]
    want = brute(rows, size)
    assert sorted(((i, n) for i, _, _, n in got), key=str) == sorted(((i, len(sets_of(t, size))) for i, t in rows), key=str)
    assert all(c == want.get(i) and k == (i is None or i == c) for i, c, k, _ in got)


def test_documents_of_two_texts(spark):
    a, b = prose(1, 60), prose(2, 60)
    check(spark, [(3, b), (5, a), (5, b), (9, a)], 2)
    check(spark, [(5, ""), (5, a), (3, a), (7, ""), (7, None), (8, "  ")], 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_dirty_ids_equal_all_pairs(spark, seed):
    r = random.Random(seed)
    base = [prose(100 * seed + i, r.choice([1, 3, 30, 80])).split() for i in range(25)]

    def changed(w):
        w = list(w)
        for _ in range(r.randint(0, max(1, len(w) // 15))):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        return " ".join(w)

    rows = [(r.choice([None, *range(60)]), r.choice([None, "", changed(r.choice(base)), changed(r.choice(base)), changed(r.choice(base))])) for _ in range(140)]
    check(spark, rows + rows[:20], 2)


def test_one_dirty_id_leaves_the_second_pass_as_it_is(spark, monkeypatch):
    """Somewhat alike documents: no more pairs meet with a doc_id of two texts among them than without."""
    r = random.Random(5)
    common = prose(77, 120).split()
    rows = [(i, " ".join(w if r.random() < 0.8 else f"x{r.randrange(10**6)}" for w in common)) for i in range(150)] + [(200 + i, rows_text) for i, rows_text in enumerate([prose(300, 90)] * 2)]
    counts = []
    plain = minhash.late_pairs

    def counted(*args):
        pairs = plain(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "late_pairs", counted)
    for more in ([], [(0, prose(301, 90)), (400, prose(301, 88))]):
        minhash.near_duplicates(spark.createDataFrame(rows + more, "doc_id long, text string"), 2)
    assert counts[1] <= counts[0] + 2


def test_clashing_columns_and_repeated_rows(spark):
    a, b = prose(4, 70), prose(5, 70)
    rows = [(1, a, 10, "p"), (1, a, 11, "q"), (None, a, 12, "r"), (2, b, 13, None), (None, None, 14, "s"), (3, "", 15, "t")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _row int, `odd.name` string")
    got = minhash.one_of_each(table)
    assert got.columns == table.columns
    assert sorted(r["_row"] for r in got.collect()) in ([10, 13, 14, 15], [11, 13, 14, 15])
