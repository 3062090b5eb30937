"""Periodic runs of words: maximal stretches that repeat with a period, at least ``LEAST_EXPONENT`` times.

For each period p the places 0, p, 2p, ... of a text are a grid. A run of four periods holds four neighbouring places of
the grid of its period, all with the same word; at the first pair jp, (j+1)p of such places the longest common extensions
forward (of the suffixes) and backward (of the reversed prefixes) tell how far the stretch keeps the period. Extensions
come from a suffix array of the words, one of the reversed words, and range minima over their shared prefixes. Texts
without such places have no run and get no suffix array.

A stretch found with a multiple of its smallest period is the same stretch as with that, so of equal stretches the
smallest period stays. All texts of a slice are searched at once; a very long text goes alone, in memory proportional to it.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, told apart by 64-bit hashes. Defined results: a null text has no
words, no runs and an empty rest. Each row is judged by itself, so repeated rows get equal results. An empty table gives an
empty result. Extra columns are kept; those with names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, clean_text, slices, words

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
#: Entries of one block of the range minima; pairs of grid places looked at in one step.
BLOCK, STEP = 16, 2_000_000


class RangeMin:
    """Least of any range: a sparse table over blocks, and the blocks at both ends looked through."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = np.iinfo(np.int32).max
        self.values = np.concatenate([values, np.full(BLOCK + -self.n % BLOCK, top)]).astype(np.int32)
        self.table = [self.values.reshape(-1, BLOCK).min(1)]
        k = 1
        while 2 * k <= len(self.table[0]):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least value of each range from lo to hi (not empty)."""
        out = np.full(len(lo), np.iinfo(np.int32).max, np.int32)
        first, last = -(-lo // BLOCK), hi // BLOCK
        for step in range(BLOCK):
            at = lo + step
            np.minimum(out, self.values[np.minimum(at, self.n)], out=out, where=(at < hi) & (at < first * BLOCK))
            at = last * BLOCK + step
            np.minimum(out, self.values[np.minimum(at, self.n)], out=out, where=(at < hi) & (at >= lo))
        wide = last - first
        for k, row in enumerate(self.table):
            use = np.flatnonzero((wide >= 1 << k) & (wide < 2 << k))
            if len(use):
                out[use] = np.minimum(out[use], np.minimum(row[first[use]], row[last[use] - (1 << k)]))
        return out


class Extensions:
    """Suffix array by doubled ranks, shared prefixes of neighbours (each round from the ranks before it), and their range minima."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.n = n
        unknown = np.iinfo(np.int32).max
        order = np.argsort(text, kind="stable")
        new = np.append(True, text[order][1:] != text[order][:-1])
        shared = np.where(new, 0, unknown).astype(np.int32)
        rank = np.empty(n, np.int64)
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = head
        k = 1
        while (open_ := np.flatnonzero(~new)).size:
            # only places in groups of more than one are sorted again, by the rank k words on
            some = np.unique(np.concatenate([open_, open_ - 1]))
            who = order[some]
            nxt = np.where(who + k < n, rank[np.minimum(who + k, n - 1)] + 1, 0)
            by = np.lexsort((nxt, rank[who]))
            order[some] = who[by]
            nxt = nxt[by]
            split = ~new[some] & np.append(False, nxt[1:] != nxt[:-1])
            at = some[split]
            minima = RangeMin(shared)
            shared[at] = k + self._least(minima, rank, order[at - 1] + k, order[at] + k)
            new[at] = True
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank[order[some]] = head[some]
            k *= 2
        self.rank, self.minima = rank, RangeMin(shared)

    def _least(self, minima: RangeMin, rank: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        ok = np.flatnonzero((x < self.n) & (y < self.n) & (x >= 0) & (y >= 0))
        a, b = rank[x[ok]], rank[y[ok]]
        out[ok] = minima.of(np.minimum(a, b) + 1, np.maximum(a, b) + 1)
        return out

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words the suffixes from x and from y (different ones) share; 0 outside the text."""
        return self._least(self.minima, self.rank, x, y)


def _grids(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, place jp (over all texts) and p wherever four neighbouring places of the grid, from jp on, have the same word."""
    most = size // LEAST_EXPONENT
    text = np.repeat(np.arange(len(size)), most)
    p = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (size[text] - 1) // p - (LEAST_EXPONENT - 2)
    ends = np.cumsum(count)
    first = 0
    while first < len(text):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + STEP, side="right")))
        m = count[first:last]
        which = np.repeat(np.arange(first, last), m)
        step = p[which]
        at = start[text[which]] + step * (np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m))
        ok = np.flatnonzero(ids[at] == ids[at + step])
        for k in range(1, LEAST_EXPONENT - 1):
            ok = ok[ids[at[ok] + k * step[ok]] == ids[at[ok] + (k + 1) * step[ok]]]
        yield text[which[ok]], at[ok], step[ok]
        first = last


def find_runs(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, length and smallest period of every run, in this order, of texts given by word ids and offsets."""
    start, size = offsets[:-1], np.diff(offsets)
    has = np.zeros(len(size), bool)
    for text, _, _ in _grids(ids, start, size):
        has[text] = True
    some = np.flatnonzero(has)
    if not len(some):
        return (np.empty(0, np.int64),) * 4
    # the texts that may have runs, each behind an id of its own that no extension crosses
    size = size[some]
    new = np.append(0, np.cumsum(size + 1))[:-1] + 1
    total = int(size.sum()) + len(some)
    text = np.empty(total, np.int64)
    text[new - 1] = np.arange(len(some))
    word = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(new, size) + word] = np.unique(ids[np.repeat(start[some], size) + word], return_inverse=True)[1] + len(some)
    forward, backward = Extensions(text), Extensions(text[::-1].copy())
    found = [np.empty((4, 0), np.int64)]
    for doc, x, p in _grids(text, new, size):
        y = x + p
        b = backward.of(total - x, total - y)
        s = x - b
        e = y + forward.of(x, y)
        ok = e - s >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * p)
        found.append(np.unique(np.stack([doc, s - new[doc], e - s, p])[:, ok], axis=1))
    doc, s, length, p = np.unique(np.concatenate(found, axis=1), axis=1)
    first = np.append(True, (doc[1:] != doc[:-1]) | (s[1:] != s[:-1]) | (length[1:] != length[:-1]))[: len(doc)]
    doc, s, length, p = (v[first] for v in (doc, s, length, p))
    by = np.lexsort((p, s, doc))
    return some[doc[by]], s[by], length[by], p[by]


def kept_words(n: int, doc_first: np.ndarray, s: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Mask of the words, over all texts, that no run holds after its first period."""
    edge = np.bincount(doc_first + s + p, minlength=n + 1) - np.bincount(doc_first + s + length, minlength=n + 1)
    return np.cumsum(edge)[:n] == 0


def _altered(w: Words, change: pa.Array) -> np.ndarray:
    """For each word place the place of the word that stands there: from place ``from`` on, words repeat with ``period``."""
    place = np.arange(len(w.hash))
    size = np.diff(w.offsets)
    some = np.flatnonzero(change.is_valid().to_numpy(zero_copy_only=False) & (size > 0))
    first = change.field("from").to_numpy(zero_copy_only=False)
    period = change.field("period").to_numpy(zero_copy_only=False)
    for i in some:
        a, p = w.offsets[i] + int(first[i]), int(period[i])
        place[a : w.offsets[i + 1]] = a + np.arange(w.offsets[i + 1] - a) % p
    return place


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        w = words(part.column("_text"))
        place = _altered(w, part.column("_change"))
        doc, s, length, p = find_runs(w.hash[place], w.offsets)
        stays = kept_words(len(place), w.offsets[doc], s, length, p)
        sizes = np.diff(np.append(0, np.cumsum(stays))[w.offsets])
        ends = np.append(0, np.cumsum(np.bincount(doc, minlength=part.num_rows))).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(s), pa.array(length), pa.array(p)], names=RUN.names))
        yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(np.diff(w.offsets)), runs, _joined(w, place[stays], sizes)], names=["_row", "n_words", "runs", "collapsed"])


def _joined(w: Words, kept: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Words by their places, ``sizes`` of them a text, with one space between."""
    size = w.end[kept] - w.start[kept] + 1
    last = np.zeros(len(kept), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    size = size - last
    out = np.append(0, np.cumsum(size))
    # bytes in order: each word's own, then the space that stands at the end of the data
    data = np.append(w.data, np.uint8(32))
    inside = np.arange(out[-1]) - np.repeat(out[:-1], size)
    source = np.repeat(w.start[kept], size) + inside
    source[inside == np.repeat(w.end[kept] - w.start[kept], size)] = len(w.data)
    offsets = out[np.append(0, np.cumsum(sizes))]
    large = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[source].tobytes()))
    return large.cast(pa.string())


def collapse_runs(docs: DataFrame, change: F.Column | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs array<struct<start, length, period>>`` by start and period, and ``collapsed``.

    ``collapsed`` has the words that no run holds after its first period, with one space between. ``change`` (optional, null for
    texts as they are) is a struct ``from, period``: before the search, words from ``from`` on repeat the ``period`` words
    that begin there.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    none = F.lit(None).cast("struct<from: long, period: long>")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), clean_text(text_col).alias("_text"), (none if change is None else change).alias("_change"))
    schema = T.StructType([rows.schema["_row"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_collapse, schema).select("_row.*", "n_words", "runs", "collapsed")
