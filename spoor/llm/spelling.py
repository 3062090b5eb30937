"""Spelling variants: each word's near words (one code point inserted, deleted or replaced) and the form it varies from.

The dictionary is all distinct words with their counts. Two words one edit apart agree before the edit and after it.
The places of an edit are cut into pieces; for each piece a word goes to the shard of what lies outside it, so that
two near words meet in the shard of the piece of their edit, once. A shard keeps its words as points (place in forward
order, place in the order of the reversed words) in a wavelet matrix. For each word and place of an edit, the words
that begin as it does before the place are an interval of the forward order, those that end as it does after it an
interval of the reverse order, and the wavelet matrix reports the points of the rectangle. Words of one length and those
one longer have a matrix each: the first gives the replacements, the second the insertions, which are the other's
deletions. A shard tells each word's number of near words and the best of them, never pairs.

A shard key that more than ``hot`` words share is cut into finer pieces, so no list is capped. A clique of words that differ
at one place is bounded by the alphabet (90 letters).

Defined results: null and empty texts have no words; a null id leaves runs unchanged; a repeated row counts again; an empty
table gives an empty result. A run of any length is one word. Extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, text_bytes, written
from .fm_index import WaveletMatrix

LETTERS = "[A-Za-zÀ-ÿ]+"
#: One run in so many loses a code point.
SLIP = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A shard key with more words is cut into ``FINER`` pieces.
HOT, FINER = 100_000, 8
#: Words of one wavelet matrix; a single key may exceed it. Rectangles searched at once.
SHARD, AT_ONCE = 100_000, 500_000
_UPPER = "".join(map(chr, range(65, 91)))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP) -> DataFrame:
    """``word``: every letter run with A to Z lower-cased; those whose hash ``slip`` divides lose a code point."""
    found = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), _UPPER, _UPPER.lower()), F.lit(LETTERS), F.lit(0))
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(found).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return out.select(F.when(h % slip == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# One shard ---------------------------------------------------------------------------------------------------------


def _latin(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a code point (all are below 256), and where each text begins and ends."""
    data, off = text_bytes(texts)
    lead = data == 0xC3
    out = np.where(np.append(False, lead[:-1]) if len(data) else lead, data | np.uint8(0x40), data)[~lead]
    return out, off - np.append(0, np.cumsum(lead))[off]


def _order(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of letters in order, and how many letters each shares with the one before it."""
    width = m.shape[1]
    order = np.argsort(np.ascontiguousarray(m).view(f"S{width}").ravel(), kind="stable")
    s = m[order]
    differ = s[1:] != s[:-1]
    return order, np.append(-1, np.where(differ.any(1), differ.argmax(1), width))


def _same(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an order, the interval of those that agree with it in ``depth`` letters."""
    n = len(shared)
    head = np.flatnonzero(shared < depth) if depth else np.zeros(1, np.int64)
    group = np.searchsorted(head, np.arange(n), side="right") - 1
    return head[group], np.append(head[1:], n)[group]


class _Points:
    """Some of the shard's words as points of both orders."""

    def __init__(self, member: np.ndarray, forward: np.ndarray, backward: np.ndarray):
        self.before = np.append(0, np.cumsum(member[forward])).astype(np.int64)
        self.behind = np.append(0, np.cumsum(member[backward])).astype(np.int64)
        self.word = backward[member[backward]]
        place = np.empty(len(member), np.int64)
        place[self.word] = np.arange(len(self.word))
        self.wavelet = WaveletMatrix(place[forward[member[forward]]], max(2, len(self.word)))

    def report(self, rect: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rectangle number and word of each point inside, some rectangles at a time."""
        a, b, low, high = self.before[rect[0]], self.before[rect[1]], self.behind[rect[2]], self.behind[rect[3]]
        some = np.flatnonzero((b > a) & (high > low))
        for i in range(0, len(some), AT_ONCE):
            pick = some[i : i + AT_ONCE]
            q, v = self.wavelet.report(a[pick], b[pick], low[pick], high[pick])
            yield pick[q], self.word[v]


def near_words(letters: np.ndarray, start: np.ndarray, size: np.ndarray, c: int, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of near words of one shard: lengths c and c + 1, edits at the places from lo to hi of the shorter word.

    A replacement comes in both directions, an insertion as (shorter, longer), by its first possible place alone.
    """
    n = len(size)
    short = size == c
    width = c + 1
    col = np.arange(width)
    inside = col < size[:, None]
    ahead = np.where(inside, letters[np.minimum(start[:, None] + col, len(letters) - 1)], 0).astype(np.uint8)
    back = np.where(inside, letters[np.maximum(start[:, None] + size[:, None] - 1 - col, 0)], 0).astype(np.uint8)
    forward, shared_f = _order(ahead)
    backward, shared_b = _order(back)
    at_f, at_b = np.empty(n, np.int64), np.empty(n, np.int64)
    at_f[forward], at_b[backward] = np.arange(n), np.arange(n)
    asks = np.flatnonzero(short)
    kinds = [(_Points(short, forward, backward), 1, range(lo, hi))]
    if len(asks) < n:
        kinds.append((_Points(~short, forward, backward), 0, range(lo, hi + 1 if hi == c else hi)))
    for points, skip, places in kinds:
        rect, word, place = [[], [], [], []], [], []
        for i in places:
            fa, fb = _same(shared_f, i)
            ba, bb = _same(shared_b, c - i - skip)
            corner = fa[at_f[asks]], fb[at_f[asks]], ba[at_b[asks]], bb[at_b[asks]]
            use = (corner[1] - corner[0] > 1) & (corner[3] - corner[2] > 1)  # a word always meets itself
            for k in range(4):
                rect[k].append(corner[k][use])
            word.append(asks[use])
            place.append(np.full(len(word[-1]), i))
        if not word:
            continue
        word, place = np.concatenate(word), np.concatenate(place)
        for q, other in points.report(tuple(np.concatenate(r) for r in rect)):
            mine = word[q]
            if skip:
                ok = mine != other
            else:
                i = place[q]
                ok = (i == 0) | (ahead[other, i] != ahead[mine, np.maximum(i - 1, 0)])
            yield mine[ok], other[ok]


def _best(words: pa.Array, n: np.ndarray, c: int, lo: int, hi: int) -> pa.RecordBatch:
    """``word, near, best_n, best`` of one shard: how many near words, and the one of largest n, then least."""
    letters, off = _latin(words)
    start, size = off[:-1], np.diff(off)
    # numbers of words in the order of preference
    liking = np.argsort(-n, kind="stable")  # equal n keep the order of the words, which come sorted
    rank = np.empty(len(n), np.int64)
    rank[liking] = np.arange(len(n))
    near = np.zeros(len(n), np.int64)
    best = np.full(len(n), len(n), np.int64)
    for a, b in near_words(letters, start, size, c, lo, hi):
        both = [(a, b)] if not len(a) or size[b[0]] == c else [(a, b), (b, a)]
        for x, y in both:
            near += np.bincount(x, minlength=len(n))
            np.minimum.at(best, x, rank[y])
    hit = np.flatnonzero(near)
    chosen = liking[best[hit]]
    return pa.RecordBatch.from_arrays([words.take(pa.array(hit)), pa.array(near[hit]), pa.array(n[chosen]), words.take(pa.array(chosen))], names=["word", "near", "best_n", "best"])


def _cuts(t: pa.Table, limit: int | None) -> tuple[list[tuple[int, int]], int]:
    """Ranges of rows that are a shard each, up to ``limit`` or the last key, which may go on; and where that is."""
    differ = lambda x: pc.not_equal(t[x].slice(1), t[x].slice(0, t.num_rows - 1)).to_numpy()
    turn = differ("c") | differ("lo") | differ("hi")
    kinds = np.concatenate([[0], np.flatnonzero(turn) + 1, [t.num_rows]])
    heads = np.concatenate([[0], np.flatnonzero(turn | differ("key")) + 1, [t.num_rows]])
    limit = int(heads[-2]) if limit is None else limit
    first, out = 0, []
    while first < limit:
        end = kinds[np.searchsorted(kinds, first, side="right")]
        if end - first > SHARD:
            i = np.searchsorted(heads, first + SHARD, side="right") - 1
            end = heads[i] if heads[i] > first else heads[i + 1]
        end = min(int(end), limit)
        out.append((first, end))
        first = end
    return out, limit


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``c, lo, hi, key, word, n`` in order, cut into shards of one (c, lo, hi) with whole keys."""
    waiting, n = [], 0

    def done(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, n
        t = pa.Table.from_batches(waiting).combine_chunks()
        ranges, limit = _cuts(t, t.num_rows if last else None)
        for first, end in ranges:
            if end - first > 1:
                part = t.slice(first, end - first).sort_by("word")
                yield _best(part["word"].combine_chunks(), part["n"].to_numpy(), *(part[x][0].as_py() for x in ("c", "lo", "hi")))
        waiting, n = t.slice(limit).combine_chunks().to_batches(), t.num_rows - limit

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
            if n >= 2 * SHARD:
                yield from done(False)
    if waiting:
        yield from done(True)


# The dictionary over all shards -------------------------------------------------------------------------------------


def _key(lo: Column, hi: Column) -> Column:
    """What lies outside the piece from lo to hi of a word of length c, or one letter more."""
    return F.concat(F.substring("word", F.lit(1), lo), F.lit("|"), F.substring("word", F.length("word") - (F.col("c") - hi) + 1, F.col("c") - hi))


def _keyed(words: DataFrame, hot: int) -> DataFrame:
    """``c, lo, hi, key, word, n``: a word as one of length c and as the longer one of c = its length - 1, in each piece."""
    halves = F.array(F.struct(F.lit(0).alias("lo"), F.floor(F.col("c") / 2).cast("int").alias("hi")), F.struct(F.floor(F.col("c") / 2).cast("int").alias("lo"), F.col("c").alias("hi")))
    rows = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("c"))
    rows = rows.select("*", F.inline(halves)).select("c", "lo", "hi", _key(F.col("lo"), F.col("hi")).alias("key"), "word", "n")
    often = written(rows.groupBy("c", "lo", "hi", "key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > hot).drop("words"), "spelling-hot")
    if often.isEmpty():
        return rows
    common = rows.join(often, ["c", "lo", "hi", "key"])
    width = F.col("hi") - F.col("lo")
    step = lambda k: (F.col("lo") + F.floor(width * k / F.least(width, F.lit(FINER)))).cast("int")
    finer = common.select("c", "word", "n", F.inline(F.transform(F.sequence(F.lit(0), F.least(width, F.lit(FINER)) - 1), lambda k: F.struct(step(k).alias("lo"), step(k + 1).alias("hi")))))
    finer = finer.select("c", "lo", "hi", _key(F.col("lo"), F.col("hi")).alias("key"), "word", "n")
    return rows.join(often, ["c", "lo", "hi", "key"], "left_anti").unionByName(finer)


def near(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have a near one, from ``word, n``."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = _keyed(words, hot).repartitionByRange(parts, "c", "lo", "hi", "key").sortWithinPartitions("c", "lo", "hi", "key")
    found = shards.mapInArrow(_search, "word string, near long, best_n long, best string")
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    return found.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form, from ``word, form``: each round doubles how far a pointer reaches.

    Counts at least double from a word to its form, so chains end and rounds are few.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = further.where("moved").limit(1).count()
        drop_written(now)
        now = further.select("word", "root")
        if not moved:
            return now


def group_variants(words: DataFrame, ratio: int = 2, hot: int = HOT) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every row of ``word, n``.

    ``form`` is the near word of largest n (ties: least in code-point order) if that is at least ``ratio`` times the word's own, else
    null; ``root`` is the end of the chain of forms, the word itself if it has none.
    """
    words = written(words.select("word", "n"), "spelling-words")
    much = F.col("best_n") >= ratio * F.col("n")
    out = words.join(near(words, hot), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(much, F.col("best")).alias("form"), F.when(much, F.col("best_n")).alias("form_n"))
    out = written(out, "spelling-forms")
    drop_written(words)
    return out.join(roots(out.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
