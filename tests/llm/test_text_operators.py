"""Edge cases and brute-force comparisons of the operators on small tables."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from spoor.llm import chat, decontaminate, language, minhash, mixing, ngram_lm, quality, substring, token_counts, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_2 string, kept boolean"


def vocabulary(n):
    return [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "so", "te") for b in ("ra", "sen", "tiv", "dop", "quu", "bel", "wy")][:n]


def prose(seed, n):
    v, x, out = vocabulary(42), seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(v[(x >> 8) % len(v)])
    return " ".join(out)


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120)
    shared = prose(2, 40)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base, "en", "a"),
        (1, base, "en", "a"),
        (2, " ".join(near), "en", "b"),
        (3, prose(3, 60) + "\n" + shared + " " + prose(4, 50), "fr", "b"),
        (4, prose(5, 30) + " " + shared, "fr", None),
        (5, None, None, "a"),
        (6, "", "en", "b"),
        (7, "word", "en", "a"),
        (8, "WORD", "en", "a"),
        (9, "x y " * 40, "en", "b"),
        (10, "line one two\n" * 8 + "\n\n \n", "en", "b"),
        (11, "é\x0bñ\x1cx  ###$$$ \t日本語", "de", "c"),
        (12, prose(6, 20000), "en", "c"),
        (None, prose(7, 55), "en", "c"),
        (13, prose(8, 55), None, "c"),
        (13, prose(8, 55), None, "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "other", False) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return WORD.findall(text or "")


def test_token_counts_and_cache(spark, docs, empty, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    P = pytest.importorskip("public_tokenizers")
    model = P.path("piece_bpe_32k.model")
    direct = sentencepiece.SentencePieceProcessor(model_file=model)
    cache = f"file://{tmp_path}/cache"
    out = rows_of(token_counts.count_tokens(docs, model, cache))
    texts = [r["text"] or "" for r in rows_of(docs)]
    assert collections.Counter((r["n_bytes"], r["n_tokens"]) for r in out) == collections.Counter((len(t.encode()), len(direct.encode(t))) for t in texts)
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(texts))
    # what is stored is used, not counted again: a changed count comes back
    one = stored.limit(1).collect()[0]
    token_counts.count_tokens(docs.where("doc_id < 3"), model, cache).count()
    assert spark.read.parquet(cache).count() == len(set(texts))
    assert one["tokenizer_digest"] == token_counts.tokenizer_digest(model)
    assert token_counts.count_tokens(empty, model).count() == 0


def test_quality_measures(docs, empty):
    got = rows_of(quality.judge(docs).orderBy("doc_id"))
    want = []
    for r in rows_of(docs):
        w = words(r["text"])
        n = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        want.append((r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r["text"] or ""), len(lines) - len(set(lines)), len(covered)))
    assert collections.Counter((g["doc_id"], g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) for g in got) == collections.Counter(want)
    assert all(g["kept"] == (not g["base_failed"]) for g in got)
    assert quality.judge(empty).count() == 0
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows_of(kept)} == {g["doc_id"] for g in got if g["kept"]}


def test_bad_host_goes_as_a_whole(spark):
    good = [(i, prose(i + 50, 80), f"h{i % 5}") for i in range(100)]
    bad = [(200 + i, "too short", "bad") for i in range(60)] + [(300, prose(999, 80), "bad")]
    out = {r["doc_id"]: r for r in rows_of(quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, source string")))}
    assert out[300]["host_rejected"] and not out[300]["kept"]
    assert all(out[i]["kept"] for i in range(100))


def test_windows_of_texts_whose_hashes_clash(spark, docs, monkeypatch):
    """With no bits of hash left every window clashes, and the words decide."""
    monkeypatch.setattr(quality, "_BITS", 58)
    same = lambda df: collections.Counter((r["doc_id"], r["n_repeat_words"]) for r in rows_of(df))
    few = docs.where("doc_id <> 12")
    hard = same(quality.measures(few))
    monkeypatch.undo()
    assert hard == same(quality.measures(few))


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", r"\### Assistant: </turn> ok"),
        (1, 1, "assistant", "</turn><turn:user>\\l \\b \\"),
        (2, 1, "assistant", "late"),
        (2, 0, "user", None),
        (2, 0, "system", "<>"),
        (3, 0, "assistant", "first"),
        (4, 0, None, None),
        (None, 0, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in rows_of(chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))))}
    for conv, got in out.items():
        want = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(b["role"], b["text"]) for b in got["back"]] == [w[1:] for w in want]
        assert got["loss"] == "".join(w[2] for w in want if w[1] == "assistant")
        assert got["formatted"] == "".join(s["text"] for s in got["segments"])
    assert out[1]["valid"] and out[2]["valid"] and not out[3]["valid"] and not out[4]["valid"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_language(spark, docs, empty):
    langs = {"aa": "the and with from", "bb": "der die und nicht", "cc": "les des avec pour"}
    rows = [(k, (f"{v} " * 6) + prose(i, 4)) for i in range(30) for k, v in langs.items()]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert set(model["lang"]) == set(langs)
    test = spark.createDataFrame([(1, "the cat and the dog with hats from there"), (2, "der hund und die katze nicht"), (3, None), (4, "123 ###"), (5, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in rows_of(language.predict(test, model))}
    assert out[1]["lang_pred"] == "aa" and out[2]["lang_pred"] == "bb"
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (3, 4, 5))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    nothing = language.fit(empty.select("lang", "text"))
    assert {r["lang_pred"] for r in rows_of(language.predict(docs, nothing))} == {"und"}
    assert language.predict(empty, model).count() == 0


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, empty, size):
    base = prose(77, 90).split()
    extra = []
    for k in range(40):  # a large group of near copies, each with edits of its own
        w = list(base)
        for j in range(k % 6):
            w[(k * 13 + j * 17) % 90] = f"edit{k}x{j}"
        extra.append((100 + k, " ".join(w)))
    table = docs.where("doc_id IS NOT NULL").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(minhash.near_duplicates(table, size).rows)}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in rows_of(table)], size, 80)
    lone = rows_of(minhash.near_duplicates(docs, size).rows.where("doc_id IS NULL"))
    assert [(r["component_id"], r["kept"]) for r in lone] == [(None, True)]
    assert minhash.near_duplicates(empty, size).rows.count() == 0


def test_long_lists_are_split_exactly(spark, monkeypatch):
    texts = [(i, prose(5, 40) + f" tail{i} end{i}") for i in range(60)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 10)
    assert {r["component_id"] for r in rows_of(minhash.near_duplicates(table, 2).rows)} == {0}


def brute_strip(texts, window):
    seen = collections.Counter(tuple(w[i : i + window]) for w in map(words, texts) for i in range(len(w) - window + 1))
    out = []
    for t in texts:
        w = words(t)
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("window", "gram", "hot"), [(35, 8, 50_000), (35, 8, 1), (12, 4, 2)])
def test_substring_dedup(docs, empty, window, gram, hot):
    got = rows_of(substring.strip_repeats(docs, window, gram, hot))
    want = brute_strip([r["text"] for r in rows_of(docs)], window)
    assert collections.Counter((g["n_words"], g["n_removed"], g["kept_text"]) for g in got) == collections.Counter(want)
    assert substring.strip_repeats(empty).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, docs, empty, order, monkeypatch):
    """Every score equals that of a plain interpolated model; parts are so small that common words are dealt to several."""
    monkeypatch.setattr(ngram_lm, "PART_TOKENS", 400)
    table = docs.select("doc_id", "text")
    learn = [r["text"] for r in rows_of(table) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    model = ngram_lm.train(table.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)), order=order)
    assert len(model.layout.common)
    tokens = lambda t: [None] * (order - 1) + [*words((t or "").translate(LOWER)), 1]
    grams = lambda t: zip(*(tokens(t)[k:] for k in range(order)))
    levels = [collections.Counter(g for t in learn for g in grams(t))]
    uni = collections.Counter(x for t in learn for x in tokens(t)[order - 1 :])
    for _ in range(order - 1):
        below = collections.Counter()
        for g, c in levels[-1].items():
            below[g[1:]] += c if len(g) == 3 and g[1] is None else 1
        levels.append(below)
    count = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    told = []
    for level in levels:
        total, classes = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
        for g, c in level.items():
            total[g[:-1]] += c
            classes[g[:-1]][min(c, 3) - 1] += 1
        told.append((level, (0, *ngram_lm.discounts(*count(level.values()))), total, classes))
    assert (model.n_tokens, model.n_words, model.n_pairs) == (sum(uni.values()), len(uni), len(levels[-2]))

    def p(g, k=0):
        if k == order:
            return 1 / (len(uni) + 1)
        level, d, total, classes = told[k]
        if g[:-1] not in total:
            return p(g[1:], k + 1)
        t = total[g[:-1]]
        return max(level[g] - d[min(level[g], 3)], 0) / t + sum(d[i + 1] * classes[g[:-1]][i] for i in range(3)) / t * p(g[1:], k + 1)

    for r in rows_of(ngram_lm.score(docs.select("doc_id", "text"), model)):
        text = next(x["text"] for x in rows_of(table) if x["doc_id"] == r["doc_id"])
        t = tokens(text)[order - 1 :]
        assert math.isclose(r["score"], sum(math.log10(p(g)) for g in grams(text)), rel_tol=1e-7)
        assert math.isclose(r["base_score"], sum(math.log10((uni[b] + 1) / (sum(uni.values()) + len(uni) + 1)) for b in t), rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(uni[b] > 0 for b in t))
    assert ngram_lm.score(empty, model).count() == 0
    blank = ngram_lm.train(empty)
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in rows_of(ngram_lm.score(docs, blank)))


def test_decontamination(spark, docs, empty):
    items = [(i, f"{prose(500 + i, 25).capitalize()} what is {'asked' + str(i)}? The answer{i} is {prose(600 + i, 8)}.") for i in range(30)]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "two words")], "item_id long, text string")
    planted = [(1000, prose(9, 200) + " " + items[3][1].upper().replace(" ", "\n") + " " + prose(10, 30)), (1001, items[7][1]), (1002, prose(11, 300))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    out = rows_of(decontaminate.find_leaks(table, bench))
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(1000, 3), (1001, 7)}
    left = decontaminate.decontaminate(table, bench)
    assert left.columns == ["doc_id", "text"] and left.count() == table.count() - 2
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(table, bench.limit(0)).count() == 0


def test_block_bounds_lose_nothing(spark):
    """Every (passage, entry) score at or above the threshold is retrieved."""
    import numpy as np
    import pyarrow as pa

    from spoor.llm.common import words as hashed

    entries = [hashed(pa.array([prose(700 + i, 20)])).hash for i in range(50)]
    index = decontaminate.build_index(entries, list(range(50)))
    w = hashed(pa.array([prose(800 + i, 10 + 37 * i) for i in range(12)] + [prose(705, 20)]))
    text, start, item, score = decontaminate.retrieve(w, index, 0.3)
    want = set()
    for t in range(len(w.offsets) - 1):
        for s in range(w.offsets[t], w.offsets[t + 1], decontaminate.STRIDE):
            have = np.unique(w.hash[s : min(s + decontaminate.PASSAGE, w.offsets[t + 1])])
            for e in range(50):
                rows = np.flatnonzero(np.isin(index.terms, have))
                if index.weights[index.row[rows, e // decontaminate.BLOCK], e % decontaminate.BLOCK].sum() >= 0.3:
                    want.add((t, int(s), e))
    assert set(zip(text.tolist(), start.tolist(), item.tolist())) == want and want


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        toxic, rough = i % 5 == 0, i % 7 == 0
        text = prose(i, 40) + (" nasty vile words" if toxic else "") + (" ### $$$ !!! |" * 5 if rough else "")
        rows.append((i, text))
        if i < 300:
            labels.append((i, int(not rough), int(toxic)))
    labels += [(7000, 1, 1), (3, 1, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_chain(spark, docs, empty, labelled):
    table, labels = labelled
    models = toxicity.train(table, labels)
    assert list(models) == ["low_quality", "toxic"]
    assert len(models["toxic"].dense) == len(models["low_quality"].dense) + 1
    out = {r["doc_id"]: r for r in rows_of(toxicity.predict(table, models))}
    assert all(out[i]["toxic"] == (i % 5 == 0) for i in range(300, 400))
    assert toxicity.predict(docs, models).count() == docs.count()
    assert toxicity.predict(empty, models).count() == 0
    blank = toxicity.train(table, labels.limit(0))
    assert not any(r["p_toxic"] != 0.5 for r in rows_of(toxicity.predict(table, blank)))


def test_mixing_reaches_targets(spark, docs, empty, labelled):
    table, labels = labelled
    targets = {"good": 0.9, "rough": 0.08, "toxic": 0.02}
    out = rows_of(mixing.mix(table.withColumn("rate", F.lit("clash")), labels, targets).rows)
    total = sum(r["n_tokens"] for r in out)
    for k, share in targets.items():
        assert abs(sum(r["n_tokens"] * r["rate"] * r[f"p_{k}"] for r in out) / total - share) < 0.001 * share
    assert min(r["rate"] for r in out) >= 0
    domains = mixing.learn_domains(table, labels, list(targets))
    assert mixing.with_rates(docs, domains, mixing.fit_rates(docs, domains, targets).descent).count() == docs.count()
    assert mixing.mix(empty, labels, targets).rows.count() == 0


def test_digest_of_kept_text(docs):
    out = substring.strip_repeats(docs).select("kept_text", F.sha2(F.col("kept_text").cast("binary"), 256).alias("h"))
    assert all(r["h"] == hashlib.sha256(r["kept_text"].encode()).hexdigest() for r in rows_of(out))
