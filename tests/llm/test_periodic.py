"""op12 against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from spoor.llm import periodic, query_periodic
from spoor.llm.periodic import Extensions, RangeMin


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{e},{q}\n" for s, e, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_texts():
    r = random.Random(4)
    out = [None, "", " \t\r\n", "a", "a a a a", "a a a a a", "a a a a a a", "a\tb a b\x0ba b a b", "x a b a b a b a b a", "a a b a a b a a b a a b a a", "           ", "é ü " * 7 + "é"]
    for k in range(120):
        letters = "ab" if k % 2 else "abcd"
        unit = [r.choice(letters) for _ in range(r.randint(1, 7))]
        out.append(" ".join(r.choices(letters, k=r.randint(0, 12)) + unit * r.randint(1, 9) + unit[: r.randint(0, 3)] + r.choices(letters, k=r.randint(0, 30))))
    # squares of squares, and a long text of one word
    out += [" ".join("abaababaabaab" * 6), "w " * 5000, " ".join(f"u{i % 700}" for i in range(4000)), " ".join(f"v{i}" for i in range(30_000))]
    return out


def test_runs_equal_plain_python(monkeypatch):
    texts = [(t or "").split() for t in odd_texts()[:-4]] + [list("abaababaabaab" * 6)]
    ids = np.array([hash(x) for t in texts for x in t])
    offsets = np.cumsum([0] + [len(t) for t in texts])
    want = [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t)]
    for step in (2_000_000, 13):
        monkeypatch.setattr(periodic, "STEP", step)
        assert list(zip(*(x.tolist() for x in periodic.find_runs(ids, offsets)), strict=True)) == want
    assert any(len(brute_runs(t)) > 1 for t in texts)


def test_extensions_and_range_minima():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1000, 333).astype(np.int32)
    lo = rng.integers(0, 333, 500)
    hi = lo + 1 + rng.integers(0, 333, 500) % (333 - lo)
    assert RangeMin(v).of(lo, hi).tolist() == [v[a:b].min() for a, b in zip(lo, hi, strict=True)]
    for sigma, n in ((1, 70), (2, 200), (3, 1), (30, 300)):
        t = rng.integers(0, sigma, n)
        e = Extensions(t)
        x, y = rng.integers(0, n + 1, (2, 300))
        x, y = x[x != y], y[x != y]

        def plain(a, b, t=t, n=n):
            k = 0
            while max(a, b) + k < n and t[a + k] == t[b + k]:
                k += 1
            return k

        assert e.of(x, y).tolist() == [plain(a, b) for a, b in zip(x, y, strict=True)]


def test_query_equals_plain_python(spark, tmp_path):
    rows = list(enumerate(odd_texts()))
    rows += [(i, f"{t} {t}") for i, t in rows[12:60]] + [(None, "a b " * 6), (None, None), (5, "q " * 9), (5, "q " * 9)]
    spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(query_periodic.query(spark, str(tmp_path))) == sorted((brute_row(*r) for r in rows), key=str)


def test_columns_of_the_operator(spark):
    table = spark.createDataFrame([(1, "a b a b a b a b c", 2, "x")], "doc_id long, text string, runs int, `odd.name` string")
    row = periodic.collapse_runs(table).first()
    assert (row["odd.name"], row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("x", 9, [(0, 8, 2)], "a b c")
    assert periodic.collapse_runs(table.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["sf0.001"])
def test_query_on_whole_table(spark, table):
    got = rows_of(query_periodic.query(spark, f"/root/testdata/{table}"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text").collect()]
    want = [brute_row(*r) for r in rows if len((r[1] or "").split()) < 5000]
    assert set(want) <= set(got) and len(got) == len(rows)
