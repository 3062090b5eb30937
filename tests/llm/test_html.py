"""op13: blocks of odd pages, slopes against differences, held-out layouts, and pages whose article is known."""

import numpy as np
import pytest

from spoor.llm import block_labeller, query_html
from spoor.llm.block_labeller import Labeller, extract, features, fit, label_blocks, padded, slopes, train
from spoor.llm.html_blocks import blocks
from spoor.llm.html_layouts import MARK, Layouts, marked

from .test_text_operators import prose


@pytest.mark.parametrize(
    "page,want",
    [
        (None, []),
        ("", []),
        ("plain", ["plain"]),
        ("<p>a<p>b", ["a", "b"]),
        ("<p>a &amp;amp; b&nbsp;c&ampd &am <b>e</b>f</p>", ["a &amp; b c&d &am ef"]),
        ("<div>one<ul><li>two<li>three</ul>four</div>", ["one", "two", "three", "four"]),
        ("a<!-- x --> b<!-- <p> never closed", ["a b"]),
        ("<script>var t='<p>no</p>';</script><style>p{}</style>x<br>y\n\t z", ["x y z"]),
        ("<title>t <b> u</title><p>v", ["t <b> u", "v"]),
        ("<p class='it>x'>y</p><p title=it's>z</p>", ["y", "z"]),
        ("a < b <3 </ p></p><p>&#8364;&#x41;", ["a < b <3", "€A"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", ["1", "2", "3", "4"]),
        ("cut <p clas", ["cut"]),
        ("<script>open", []),
        ("<p> \n </p><p> </p><p>é</p>", ["é"]),
    ],
)
def test_blocks(page, want):
    assert [b[0] for b in blocks(page)] == want


def test_paths():
    a, b, c = blocks('<nav class="Main-Menu"><a href=/>l</a></nav><p>x <a>y</a></p><div><p>z')
    assert a[2] == 1 and 0 < b[2] < 1 and c[2] == 0
    assert set(a[1]).isdisjoint(b[1]) and set(b[1]) < set(c[1])
    deep = blocks("<div>" * 20_000 + "x" + "</div>" * 20_000)
    assert [d[0] for d in deep] == ["x"] and len(deep[0][1]) < 5


def small_layouts(n, seed):
    texts = [prose(i, 5 + 3 * i) for i in range(40)]
    make = Layouts(texts, " ".join(texts).split(), seed)
    return [marked(make.page()) for _ in range(n)]


def test_slopes_equal_differences():
    pages = small_layouts(3, 1)
    found = [blocks(p) for p in pages]
    labels = np.array([float(MARK in b[0]) for x in found for b in x])
    f = features(found)
    model = Labeller({k: v.astype(np.float64) for k, v in Labeller.fresh(3).weights.items()})
    some = np.arange(3)
    _, slope = slopes(model, f, labels, some)
    rng = np.random.default_rng(0)
    for name, w in model.weights.items():
        used = np.flatnonzero(np.abs(slope[name]).ravel() > 1e-6)
        for k in rng.choice(used, min(4, len(used)), replace=False):
            old = w.flat[k]
            loss = []
            for d in (1e-3, -1e-3):
                w.flat[k] = old + d
                loss.append(slopes(model, f, labels, some)[0])
            w.flat[k] = old
            assert np.isclose((loss[0] - loss[1]) / 2e-3, slope[name].flat[k], rtol=0.05, atol=2e-5), name


def test_both_directions_and_padding():
    # a page's labels don't depend on the pages read beside it
    found = [blocks(p) for p in small_layouts(9, 2)] + [[]]
    model = Labeller.fresh(1)
    together = model.probabilities(features(found))
    alone = np.concatenate([model.probabilities(features([x])) for x in found if x])
    assert np.allclose(together, alone, atol=1e-5)
    # the last block bears on the first, and the first on the last
    page = found[0]
    changed = [*page[:-1], ("other words, 9 9 9", (1, 2, 3), 1.0)]
    assert abs(model.probabilities(features([page]))[0] - model.probabilities(features([changed]))[0]) > 1e-6
    where, flip, real = padded(np.array([0, 5]), np.array([5, 2]))
    assert where.T.tolist() == [[0, 1, 2, 3, 4], [5, 6, 5, 5, 5]] and flip.T.tolist() == [[4, 3, 2, 1, 0], [1, 0, 2, 3, 4]] and real.sum() == 7


@pytest.fixture(scope="module")
def learnt():
    return train(small_layouts(500, 5), epochs=6)


def test_layouts_not_seen_in_training(learnt):
    pages = small_layouts(150, 77)
    truth = [MARK in b[0] for p in pages for b in blocks(p)]
    guess = [p >= 0.5 for page in label_blocks(learnt, [p.replace(MARK, "") for p in pages]) for _, p in page]
    assert np.mean(np.array(truth) == np.array(guess)) > 0.95


def test_rows_of_the_operator(spark, learnt):
    article = "".join(f"<p>{prose(i, 40)}</p>" for i in range(3))
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/>News</a></li></ul></nav><article><h1>{prose(9, 6)}</h1>{article}</article><div class='comments'><p>{prose(30, 12)}</p></div><footer>&copy; me</footer>"
    table = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, "v", None, "y"), (3, None, "", None), (None, "w", "<p>" + "long " * 200_000, "z")], "page_id long, url string, html string, text string")
    rows = extract(table, learnt).orderBy("page_id").collect()
    want = "\n".join([prose(9, 6), *(prose(i, 40) for i in range(3))])
    assert [(r.page_id, r.text) for r in rows if r.page_id] == [(1, want), (1, want), (2, ""), (3, "")]
    assert rows[0].page_id is None and rows[0].n_blocks == 1
    assert extract(table.limit(0), learnt).count() == 0


def test_fit_on_an_empty_table(spark, monkeypatch):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert label_blocks(fit(empty, layouts=20), ["<p>a</p>", None])[1] == []


def test_query_finds_every_article(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    want = sorted(con.sql(f"SELECT page_id, url, text, n_chars FROM ({query_html.SQL})").fetchall())
    got = sorted(tuple(r) for r in query_html.query(spark, "/root/testdata/sf0.01").collect())
    assert got == want
    assert block_labeller.HIDDEN == 20
