"""Benchmark decontamination: a BM25 inverted index of the test items, queried with every passage of every document.

Test items are cut into entries of at most ``ENTRY`` words. An entry's term weights are BM25 scores divided by the
entry's score against itself, so a passage that holds all its terms scores 1. Term frequencies, number and mean length
are those of all entries, so scores do not depend on how the index is cut. Postings lie in blocks of ``BLOCK``
entries with the block's highest weight. Passages are ``PASSAGE`` words long and begin every ``STRIDE`` words, so an
entry lies whole within one. As in block-max WAND, the block maxima of a passage's terms are summed first, and only
(passage, block) pairs that can reach the threshold are scored exactly; every entry at or above it is retrieved.

A retrieved item is verified against the passage's surroundings: it leaks if enough of the words of its question and of
its answer are there, and enough of its 3-word runs, in order. The answer is what follows the last question mark, or else the last
sentence, or else the last third of the words.

The index is broadcast in groups of at most ``GROUP`` entries and ``MOST_BYTES`` bytes; a larger benchmark takes several
passes over the documents, one a group, and is never whole on the driver. Documents and items are compared lower-cased, by their letters and digits. Defined results: null or empty
texts and items match nothing; repeated items are found each; repeated rows are searched each; empty tables give an
empty result. Extra columns are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, clean_text, slices, words, written

ENTRY, PASSAGE, STRIDE, BLOCK = 64, 96, 32, 8
THRESHOLD = 0.55
PARTS_OVERLAP, RUNS_OVERLAP = 0.7, 0.5
K1, B = 1.2, 0.75
GROUP = 4096
#: Entries of one index; a group has several.
INDEX = 256
#: Bound of what is broadcast at a time.
MOST_BYTES = 256_000_000


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def question_and_answer(text: str) -> tuple[str, str]:
    """The two parts of a test item's raw text."""
    if "?" in text and text.rsplit("?", 1)[1].strip():
        q, a = text.rsplit("?", 1)
        return q, a
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    cut = max(1, len(w) * 2 // 3)
    return " ".join(w[:cut]), " ".join(w[cut:])


@dataclass
class Index:
    """``terms`` sorted; ``row[term, block]`` names a row of ``weights`` (a block's entries), 0 for none."""

    terms: np.ndarray
    row: np.ndarray
    weights: np.ndarray
    highest: np.ndarray
    item: np.ndarray


@dataclass
class Item:
    item_id: int
    question: frozenset
    answer: frozenset
    runs: frozenset


@dataclass
class Statistics:
    """Of all entries of the benchmark: their number, their mean length, and of ``terms`` (sorted) how many have each."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def cut(hashes: np.ndarray) -> list[np.ndarray]:
    """The entries of an item's word hashes."""
    return np.array_split(hashes, max(1, -(-len(hashes) // ENTRY)))


def build_index(hashes: list[np.ndarray], item: list[int], of: Statistics | None = None) -> Index:
    """An index of entries given as word hashes, weighted by the statistics of the whole benchmark (these entries, if none)."""
    n = len(hashes)
    size = np.array([len(h) for h in hashes], float)
    entry = np.repeat(np.arange(n), size.astype(int))
    flat = np.concatenate(hashes)
    terms, term = np.unique(flat, return_inverse=True)
    pair, tf = np.unique(term * n + entry, return_counts=True)
    term, entry = pair // n, pair % n
    of = of or Statistics(n, size.mean(), terms, np.bincount(term, minlength=len(terms)))
    df = of.df[np.searchsorted(of.terms, terms)]
    idf = np.log1p((of.n - df + 0.5) / (df + 0.5))
    score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[entry] / of.mean))
    score /= np.bincount(entry, weights=score, minlength=n)[entry]
    blocks = -(-n // BLOCK)
    row = np.zeros((len(terms), blocks), np.int32)
    there, at = np.unique(term * blocks + entry // BLOCK, return_inverse=True)
    row.ravel()[there] = np.arange(1, len(there) + 1)
    weights = np.zeros((len(there) + 1, BLOCK), np.float32)
    weights[at + 1, entry % BLOCK] = score
    return Index(terms, row, weights, weights.max(1)[row], np.array(item))


def build(benchmark: pd.DataFrame, of: Statistics) -> tuple[list[Index], list[Item]]:
    """Indexes and items of rows ``item_id, text, norm`` (bounded by the caller), whose terms are all in ``of``; the rows' order doesn't matter."""
    benchmark = benchmark.sort_values(["item_id", "norm", "text"], kind="stable", na_position="last")
    items, entries, owner = [], [], []
    for item_id, text, norm in benchmark.itertuples(index=False):
        w = words(pa.array([norm]))
        if not len(w.hash):
            continue
        q, a = question_and_answer(text)
        part = lambda s: frozenset(re.findall(r"[^\W_]+", s.lower()))
        t = norm.split()
        items.append(Item(item_id, part(q), part(a), frozenset(zip(t, t[1:], t[2:]))))  # noqa: B905
        for h in cut(w.hash):
            entries.append(h)
            owner.append(len(items) - 1)
    return [build_index(entries[lo : lo + INDEX], owner[lo : lo + INDEX], of) for lo in range(0, len(entries), INDEX)], items


def retrieve(w: Words, index: Index, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word of the passage, item and score of all (passage, entry) pairs at or above the threshold."""
    none = (np.empty(0, np.int64),) * 4
    at = np.minimum(np.searchsorted(index.terms, w.hash), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == w.hash)
    if not len(known):
        return none
    term = at[known]
    text = np.searchsorted(w.offsets, known, side="right") - 1
    size = np.diff(w.offsets)
    tiles = -(-size // STRIDE)
    base = np.cumsum(tiles) - tiles
    tile = base[text] + (known - w.offsets[text]) // STRIDE
    n_tiles, wide = int(tiles.sum()), PASSAGE // STRIDE
    begin = np.searchsorted(tile, np.arange(n_tiles + wide))  # known words of tile t: begin[t] to begin[t + 1]
    total = np.zeros((n_tiles + wide, index.row.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(begin) > 0)
    for lo in range(0, len(full), 2000):
        some = full[lo : lo + 2000]
        first, last = begin[some[0]], begin[some[-1] + 1]
        total[some] = np.add.reduceat(index.highest[term[first:last]], begin[some] - first, axis=0)
    owner = np.repeat(np.arange(len(size)), tiles)
    end = np.minimum(np.arange(n_tiles) + wide, (base + tiles)[owner])
    bound = total[:n_tiles].copy()
    for k in range(1, wide):
        inside = np.arange(n_tiles) + k < end
        bound[inside] += total[np.flatnonzero(inside) + k]
    t, block = np.nonzero(bound >= threshold)
    out = []
    for lo in range(0, len(t), 4000):
        tt, bb = t[lo : lo + 4000], block[lo : lo + 4000]
        first, last = begin[tt], begin[end[tt]]
        n = last - first
        pair = np.repeat(np.arange(len(tt)), n)
        word = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.unique(pair * len(index.terms) + term[word])
        pair, which = key // len(index.terms), key % len(index.terms)
        head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        score = np.add.reduceat(index.weights[index.row[which, bb[pair]]], head, axis=0)
        p, e = np.nonzero(score >= threshold)
        row = pair[head][p]
        out.append((owner[tt[row]], w.offsets[owner[tt[row]]] + (tt[row] - base[owner[tt[row]]]) * STRIDE, index.item[bb[row] * BLOCK + e], score[p, e]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def leaks(texts: pa.Array, indexes: list[Index], items: list[Item], threshold: float = THRESHOLD) -> list[tuple[int, int, int, float, float, float, float]]:
    """Text, item number, word, score and the three overlaps of every verified leak, an item once a text."""
    w = words(texts)
    best: dict[tuple[int, int], tuple] = {}
    for index in indexes:
        for text, start, item, score in zip(*(x.tolist() for x in retrieve(w, index, threshold)), strict=True):
            x = items[item]
            lo = max(int(w.offsets[text]), start - ENTRY)
            hi = min(int(w.offsets[text + 1]), start + PASSAGE + max(ENTRY, len(x.runs)))
            near = w.data[w.start[lo] : w.end[hi - 1]].tobytes().decode("utf-8", "replace").split()
            have, runs = set(near), set(zip(near, near[1:], near[2:]))  # noqa: B905
            share = lambda part, of: len(part & of) / len(part) if part else 1.0
            q, a, r = share(x.question, have), share(x.answer, have), share(x.runs, runs)
            if min(q, a) >= PARTS_OVERLAP and r >= RUNS_OVERLAP and score > best.get((text, item), (0, -1.0))[1]:
                best[text, item] = (start - int(w.offsets[text]), score, q, a, r)
    return [(*k, *v) for k, v in sorted(best.items())]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many entries have each term."""
    for part in slices(batches, "norm"):
        w = words(part.column("norm"))
        held = [np.unique(h) for lo, hi in zip(w.offsets[:-1], w.offsets[1:], strict=True) if hi > lo for h in cut(w.hash[lo:hi])]
        if held:
            term, df = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df, pa.int64())], names=["term", "df"])


def _groups(benchmark: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark's indexes and items, broadcast: at most about GROUP entries at a time, of at most MOST_BYTES.

    With each, whether it is one of several: then it is to be used up and let go before the next is made.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), clean_text().alias("text"), normalised(clean_text()).alias("norm"))
    size = F.when(F.col("norm") == "", 0).otherwise(F.size(F.split("norm", " ")))
    told = rows.agg(F.sum(F.ceil(size / ENTRY)).alias("entries"), F.sum(size).alias("words")).first()
    entries, length = int(told["entries"] or 0), int(told["words"] or 0)
    n = max(1, -(-entries // (GROUP // 2)))
    count = lambda of: of.select("norm").mapInArrow(_terms, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    everywhere = count(rows) if n == 1 else written(count(rows), "terms")
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        # a group's terms alone come to the driver, with their counts over all groups
        found = (everywhere if n == 1 else everywhere.join(count(part).select("term"), "term", "left_semi")).toArrow()
        term = found["term"].to_numpy().view(np.uint64)
        order = np.argsort(term)
        indexes, items = build(part.toPandas(), Statistics(entries, length / max(entries, 1), term[order], found["df"].to_numpy()[order]))
        for some in _bounded(indexes, items):
            yield benchmark.sparkSession.sparkContext.broadcast(some), n > 1 or len(some[0]) < len(indexes)


def _bytes(item: Item) -> int:
    """About what an item's sets take."""
    return 80 * (len(item.question) + len(item.answer) + 3 * len(item.runs)) + 600


def _bounded(indexes: list[Index], items: list[Item]) -> Iterator[tuple[list[Index], list[Item]]]:
    """The indexes with their own items in runs of at most MOST_BYTES; an index of INDEX entries has a bound of its own."""

    def run(held: list[Index]) -> tuple[list[Index], list[Item]]:
        used = np.unique(np.concatenate([x.item for x in held])) if held else np.empty(0, np.int64)
        return [replace(x, item=np.searchsorted(used, x.item)) for x in held], [items[i] for i in used]

    held, total = [], 0
    for x in indexes:
        size = sum(a.nbytes for a in vars(x).values()) + sum(_bytes(items[i]) for i in np.unique(x.item))
        if held and total + size > MOST_BYTES:
            yield run(held)
            held, total = [], 0
        held.append(x)
        total += size
    yield run(held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, item_id, word, score, question_overlap, answer_overlap, run_overlap`` of every verified leak."""
    source = docs.select(F.col(id_col), normalised(clean_text(text_col)).alias("_text"))
    schema = f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, item_id long, word long, score double, question_overlap double, answer_overlap double, run_overlap double"
    out = None
    for shared, several in _groups(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes, items = shared.value
            for part in slices(batches, "_text"):
                got = leaks(part.column("_text"), indexes, items, threshold)
                cols = list(zip(*got, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array([items[i].item_id for i in cols[1]], pa.int64()), pa.array(cols[2], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[3:])],
                    names=[id_col, "item_id", "word", "score", "question_overlap", "answer_overlap", "run_overlap"],
                )

        found = source.mapInArrow(run, schema)
        if several:
            found = written(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without a verified leak.

    With one index in one pass. With several, the digests of texts that leak are gathered index by index, and the rows with such a
    text go at the end, so that no two indexes are held at a time.
    """
    gone = None
    text = normalised(clean_text(text_col))
    for shared, several in _groups(benchmark):
        if several:
            texts = docs.select(F.sha2(text.cast("binary"), 256).alias("_digest"), text.alias("_text"))

            def told(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                indexes, items = shared.value
                for part in slices(batches, "_text"):
                    rows = sorted({x[0] for x in leaks(part.column("_text"), indexes, items, threshold)})
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64()))], names=["_digest"])

            found = written(texts.mapInArrow(told, "_digest string").distinct(), "leaks")
            shared.destroy()
            gone = found if gone is None else gone.unionByName(found)
            continue
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes, items = shared.value
            for part in slices(batches, "_text"):
                keep = np.ones(part.num_rows, bool)
                keep[[x[0] for x in leaks(part.column("_text"), indexes, items, threshold)]] = False
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep))], names=["_row"])

        return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}").select("_row.*")
    digest = F.sha2(text.cast("binary"), 256)
    return docs.join(gone.distinct(), digest == F.col("_digest"), "left_anti")
