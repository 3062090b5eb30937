"""Substring dedup: words covered by a window that starts anywhere else too are taken out.

Documents are routed by content. In each window of ``window`` words the smallest hash of its runs of ``GRAM`` words
is its key; equal windows have equal keys at equal places, and neighbouring windows that share one run of words form a
segment. A segment whose key no other has can't have a repeated window. The segments of the others go to shards by key; each shard holds a compressed FM-index of
its distinct segments, and its segments are streamed through it: backward search gives their matching statistics, and
the windows whose match reaches the threshold come back as a mask, which joins back to the documents.

No list is capped: a key with more than ``HOT`` segments is split further, each window going by its own first and last
word as well. Equal segments are counted before they travel with their content.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged, told apart by 64-bit hashes. Defined results: a
null text has no words and an empty rest. Rows are judged by content, so equal rows (also with null ids) fare alike. An
empty table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, clean_text, mix, slices, words, written
from .fm_index import FMIndex, repeated_windows

WINDOW = 35
GRAM = 8
#: Bits of a segment's mask; a segment has window - gram + 1 windows at most.
RUN = 64
HOT = 50_000
#: Words of an index shard; a single key may exceed it.
SHARD_WORDS = 1_000_000
_G = np.uint64(0x9E3779B97F4A7C15)


def _segments(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word, number of windows and key of every segment."""
    h, off = w.hash, w.offsets
    size = np.diff(off)
    n = np.maximum(0, size - window + 1)
    total = int(n.sum())
    if not total:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, np.uint64)
    runs = h
    for j in range(1, gram):
        runs = mix(runs[: len(h) - j] * _G + h[j:])
    # where the smallest lies, the leftmost of equal ones: equal windows have it at the same place
    span, k = window - gram + 1, 1
    low = np.arange(len(runs))

    def lower(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(runs[y] < runs[x], y, x)

    while 2 * k <= span:
        low = lower(low[: len(low) - k], low[k:])
        k *= 2
    if span > k:
        low = lower(low[: len(low) - (span - k)], low[span - k :])
    text = np.repeat(np.arange(len(size)), n)
    at = np.repeat(off[:-1], n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    place = low[at]
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    length = np.diff(np.append(first, total))
    key = runs[place]
    return text[first], at[first], length, key[first]


def _content_hashes(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each run of word hashes."""
    a = np.zeros(len(start), np.uint64)
    b = np.zeros(len(start), np.uint64)
    for j in range(int(size.max()) if len(size) else 0):
        on = np.flatnonzero(size > j)
        x = h[start[on] + j]
        a[on] = mix(a[on] * _G + x)
        b[on] = mix((b[on] ^ x) + _G)
    return a, b


def _keys(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = words(part.column("text"))
            text, at, _, key = _segments(w, window, gram)
            pick = pa.array(text)
            yield pa.RecordBatch.from_arrays([part.column("id").take(pick), part.column("th").take(pick), pa.array((at - w.offsets[text]).astype(np.int32)), pa.array(key.view(np.int64))], names=["id", "th", "start", "key"])

    return run


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _units(window: int, gram: int):
    """The segments that may have a repeated window. Of equal ones in a task the first has the text and sight 1, one more has sight 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for part in slices(batches, "text"):
            w = words(part.column("text"))
            text, at, n, key = _segments(w, window, gram)
            local = at - w.offsets[text]
            row, asked = _flat(part.column("starts"))
            hot_row, hot = _flat(part.column("hot"))
            place = text * (1 << 40) + local
            one = np.isin(place, row * (1 << 40) + asked)
            many = np.flatnonzero(np.isin(place, hot_row * (1 << 40) + hot))
            times = n[many]
            each = np.repeat(many, times)
            inner = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            first = at[each] + inner
            split = mix(mix(key[each] + w.hash[first]) ^ w.hash[first + window - 1])
            text, local = np.concatenate([text[one], text[each]]), np.concatenate([local[one], local[each] + inner])
            start, n, key = np.concatenate([at[one], first]), np.concatenate([n[one], np.ones(len(each), np.int64)]), np.concatenate([key[one], split])
            end = start + n + window - 1
            a, b = _content_hashes(w.hash, start, end - start)
            raw = w.data.tobytes()
            content: list[bytes | None] = [None] * len(a)
            sight = np.zeros(len(a), np.int8)
            order = np.argsort(a, kind="stable")
            head = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])) if len(a) else []
            for lo, hi in zip(head, np.append(head[1:], len(a)), strict=True) if len(a) else ():
                i, x = order[lo], int(a[order[lo]])
                before = seen.get(x, 0)
                if before == 0:
                    content[i] = raw[w.start[start[i]] : w.end[end[i] - 1]]
                    sight[i] = 1
                    if hi - lo > 1:
                        sight[order[lo + 1]] = 2
                elif before == 1:
                    sight[i] = 2
                seen[x] = min(2, before + int(hi - lo))
            if len(seen) > 500_000:
                seen.clear()
            pick = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pick), part.column("th").take(pick), pa.array(local.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(content, pa.binary()), pa.array(sight)],
                names=["id", "th", "start", "key", "s1", "s2", "content", "sight"],
            )

    return run


def shard_masks(w: Words, again: np.ndarray, window: int) -> np.ndarray:
    """One shard: the FM-index of its segments (twice where one occurs again), and the mask of each segment's windows."""
    size = np.diff(w.offsets)
    known, ids = np.unique(w.hash, return_inverse=True)
    ids = ids.astype(np.int64) + 1
    start = w.offsets[:-1]
    pick = np.concatenate([np.arange(len(size)), np.flatnonzero(again)])
    long = size[pick] + 1
    total = int(long.sum())
    text = np.zeros(total, np.int64)
    inside = np.arange(total) - np.repeat(np.cumsum(long) - long, long)
    word = inside < np.repeat(size[pick], long)
    text[word] = ids[(np.repeat(start[pick], long) + inside)[word]]
    depth = 1 << math.ceil(math.log2(max(2, int(size.max()))))
    return repeated_windows(FMIndex(text, len(known) + 1, depth), ids, start, size, window)


def _search(window: int):
    """Rows ``key, s1, s2, content`` in order: those with one s1, s2 are one segment, seen again if there are two rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        n = 0

        def shard(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            s1, s2 = t["s1"].to_numpy(), t["s2"].to_numpy()
            head = np.flatnonzero(np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])))
            again = np.diff(np.append(head, len(s1))) > 1
            there = np.flatnonzero(t["content"].is_valid().to_numpy())
            first = there[np.searchsorted(there, head)]  # a segment's text, wherever it lies among its rows
            content = t["content"].combine_chunks().take(pa.array(first))
            mask = shard_masks(words(content), again, window)
            hit = np.flatnonzero(mask)
            return pa.RecordBatch.from_arrays([pa.array(s1[head][hit]), pa.array(s2[head][hit]), pa.array(mask[hit].view(np.int64))], names=["s1", "s2", "mask"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            n += batch.column("content").nbytes // 6
            if n >= SHARD_WORDS:
                t = pa.Table.from_batches(rest)
                key = t["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1], side="left"))  # the last key may go on
                if cut:
                    yield shard(t.slice(0, cut))
                    rest = t.slice(cut).combine_chunks().to_batches()
                    n = sum(x.column("content").nbytes // 6 for x in rest)
        if rest:
            yield shard(pa.Table.from_batches(rest))

    return run


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``id, th, text``: rows by id and content, so that neither need be unique."""
    text = clean_text(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _written_units(docs: DataFrame, window: int, gram: int, hot: int, id_col: str, text_col: str) -> DataFrame:
    source = _keyed(docs, text_col, id_col)
    keys = source.mapInArrow(_keys(window, gram), "id long, th long, start int, key long")
    # written, so that a key that very many segments have is dealt to several tasks when it is joined (skew join)
    often = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    # sets: rows with one id and text ask once
    asked = keys.join(often.hint("merge"), "key").groupBy("id", "th").agg(F.collect_set(F.when(F.col("n") <= hot, F.col("start"))).alias("starts"), F.collect_set(F.when(F.col("n") > hot, F.col("start"))).alias("hot"))
    asked = source.join(asked, ["id", "th"]).select("id", "th", "text", "starts", "hot")
    return written(asked.mapInArrow(_units(window, gram), "id long, th long, start int, key long, s1 long, s2 long, content binary, sight byte"), "units")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, spans array<struct<start, mask>>``: bit i of a mask says that the window from word start + i repeats."""
    if not 0 < gram <= window <= gram + RUN - 1:
        raise ValueError(f"gram must be from window - {RUN - 1} to window")
    units = _written_units(docs, window, gram, hot, id_col, text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = units.where("sight > 0").select("key", "s1", "s2", "content").repartition(n, "key").sortWithinPartitions("key", "s1", "s2")
    found = written(shards.mapInArrow(_search(window), "s1 long, s2 long, mask long"), "masks")
    return units.select("id", "th", "start", "s1", "s2").join(found, ["s1", "s2"]).groupBy("id", "th").agg(F.collect_set(F.struct("start", "mask")).alias("spans"))


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            w = words(part.column("_text"))
            spans = part.column("spans")
            sizes = np.where(spans.is_valid().to_numpy(zero_copy_only=False), np.diff(spans.offsets.to_numpy()), 0)
            total = len(w.hash)
            gone = np.zeros(total, bool)
            if sizes.sum():
                row = np.repeat(np.arange(len(sizes)), sizes)
                flat = spans.flatten()
                at = w.offsets[row] + flat.field("start").to_numpy(zero_copy_only=False)
                mask = flat.field("mask").to_numpy(zero_copy_only=False).view(np.uint64)
                i, bit = np.nonzero((mask[:, None] >> np.arange(RUN, dtype=np.uint64)) & np.uint64(1))
                edge = np.bincount(at[i] + bit, minlength=total + 1) - np.bincount(at[i] + bit + window, minlength=total + 1)[: total + 1]
                gone = np.cumsum(edge)[:total] > 0
            kept = np.flatnonzero(~gone)
            words_in = np.diff(w.offsets)
            n_removed = words_in - np.bincount(np.searchsorted(w.offsets, kept, side="right") - 1, minlength=len(words_in))
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(words_in.astype(np.int64)), pa.array(n_removed.astype(np.int64)), _joined(w, kept)], names=[*part.schema.names[:-2], "n_words", "n_removed", "kept_text"])

    return run


def _joined(w: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text with one space between."""
    n_texts = len(w.offsets) - 1
    count = np.diff(np.searchsorted(kept, w.offsets))
    last = np.zeros(len(kept), bool)
    ends = np.cumsum(count)[count > 0] - 1
    last[ends] = True
    size = w.end[kept] - w.start[kept] + ~last
    # a word that isn't its text's last has white space after it, which becomes the space
    data = np.append(w.data, np.uint8(32))
    data[w.end[kept[~last]]] = 32
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, w.start[kept], 1)
    np.add.at(edge, w.start[kept] + size, -1)
    out = data[np.cumsum(edge, dtype=np.int8)[: len(data)] > 0]
    text = np.repeat(np.arange(n_texts), count)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, weights=size, minlength=n_texts))]).astype(np.int32)
    return pa.StringArray.from_buffers(n_texts, pa.py_buffer(offsets), pa.py_buffer(out.tobytes()))


def strip_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` of every row; columns of these names are replaced."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    spans = repeated_spans(docs, window, gram, hot, id_col, text_col)
    text = clean_text(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.xxhash64(text).alias("th"), text.alias("_text"))
    rows = rows.join(spans, ["id", "th"], "left").select("_row", "_text", "spans")
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, n_words long, n_removed long, kept_text string"
    return rows.mapInArrow(_strip(window), schema).select("_row.*", "n_words", "n_removed", "kept_text")
