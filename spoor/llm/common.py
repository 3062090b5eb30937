"""Shared pieces: written intermediate tables, slices of Arrow text and the hashing of its words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.storage import drop_written, new_path, written

__all__ = ["Words", "bucket_of", "clean_text", "distinct", "doc_of", "drop_written", "mix", "new_path", "slices", "text_bytes", "word_counts", "words", "written"]

#: Bytes of text that one step of a Python worker looks at; a longer text goes alone.
SLICE_BYTES = 2_000_000


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the column's text modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def clean_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# Words of Arrow text ----------------------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: ``hash`` of each (64 bits of its bytes), its byte range, and the word range of each text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def text(self, i: int) -> list[bytes]:
        """The words of text ``i``."""
        lo, hi = self.offsets[i], self.offsets[i + 1]
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[lo:hi], self.end[lo:hi], strict=True)]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(off) and off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - (off[0] if len(off) else 0)


def words(texts: pa.Array, lower: bool = False, table: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes other than 0x20 and 0x09 to 0x0D (all ASCII, so UTF-8 needs no decoding).

    ``lower`` lower-cases A to Z; ``table`` replaces each of the 256 bytes first.
    """
    data, off = text_bytes(texts)
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), z, z, np.zeros(len(off), np.int64), data)
    if table is not None:
        data = table[data]
    if lower:
        data = data + ((data - np.uint8(65)) < 26) * np.uint8(32)
    ws, edge = _gaps(data, off)
    last = ~ws
    last[:-1] &= ws[1:] | edge
    start, end = _starts(ws, edge), np.flatnonzero(last) + 1
    return Words(_hash_ranges(data, start, end), start, end, np.searchsorted(start, off), data)


def word_counts(texts: pa.Array) -> np.ndarray:
    """How many ``words`` each text has; none is hashed."""
    data, off = text_bytes(texts)
    return np.diff(np.searchsorted(_starts(*_gaps(data, off)), off)) if len(data) else np.zeros(len(texts), np.int64)


def _gaps(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are white space, and which but the first begin a text."""
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    return (data == 32) | ((data - np.uint8(9)) < 5), edge[1:-1]


def _starts(ws: np.ndarray, edge: np.ndarray) -> np.ndarray:
    first = ~ws
    first[1:] &= ws[:-1] | edge
    return np.flatnonzero(first)


def _hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each byte range, eight bytes a step; ranges of one length up to eight bytes never collide."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, rest, where = start, size, None
    while len(at):
        x = eight[at] & _MASK[np.minimum(rest, 8)]
        if where is None:
            h = mix(h ^ x)
        else:
            h[where] = mix(h[where] + np.uint64(0x9E3779B97F4A7C15) ^ x)
        more = np.flatnonzero(rest > 8)
        at, rest = at[more] + 8, rest[more] - 8
        where = more if where is None else where[more]
    return h


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text or ``rows`` rows; a longer text goes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        _, off = text_bytes(texts)
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
            hi = max(lo + 1, min(hi, lo + rows, batch.num_rows))
            yield batch.slice(lo, hi - lo)
            lo = hi


def doc_of(offsets: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, in order. ``np.unique`` hashes every number first, which takes many times as long as to sort."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]
