"""An interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and scored from memory-mapped arrays.

Tokens are lower-cased (A to Z) words and one end token a text; a text's first tokens follow begin marks.

1. Each task counts the words of its texts. Buckets of words sum them and number them, frequent ones first, so that
   n-grams of numbers are small.
2. Each task counts the n-grams (u, v, w) of its texts and sends them, packed in columns, to parts by the middle word v.
   There both the context (u, v) and the suffix (v, w) of an n-gram are whole: a part stores its n-grams, its contexts
   with their totals and how many followers occurred once, twice or more, and its suffixes with how many u they follow.
   Words too common for one part are dealt to as many as their frequency asks for, by u; the suffixes of these meet
   once more, by v and w.
3. What words need as contexts and as the last part of an n-gram is summed by word and stored in the same way. Only sums
   over all parts come to the driver: token and word totals, and the counts of counts that give the discounts.
4. Workers memory-map the arrays and look up the distinct n-grams of some texts at a time.

Arrays are sorted by hash: 32 bits and the bucket of each n-gram, and one byte that names its values in a table of the
part's 255 most common ones; the rest have a sorted array of their own. Parts hold about ``PART_TOKENS`` tokens; a task
writes all its parts to one file of a kind, under a name of its own and then renamed, so one that runs again leaves the
same arrays. Workers map few files at a time (see ``Store``). Words and
n-grams are told apart by 64 bits of hash when they are counted.

Defined results: a null text is empty and has the end token alone. Without training texts every word is unknown and the
model is uniform over one word. Repeated rows count each. Extra columns are passed over.
"""

from __future__ import annotations

import math
import os
import pickle
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, drop_written, mix, new_path, slices, words, written

END = np.uint64(0xE6546B64A5B3C7D9)
#: Numbers of the begin mark and of an unknown word; words are numbered from 1.
BEGIN, NONE = np.uint64(0), np.uint64(2**64 - 1)
_G = np.uint64(0x9E3779B97F4A7C15)
#: Tokens that a task counts at a time, and that a part holds on average.
CHUNK, PART_TOKENS = 1_500_000, 500_000


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return begin, np.append(begin[1:], len(x))[: len(begin)]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + _G) * _G + b)


# Files ------------------------------------------------------------------------------------------------------------


def _table(key: np.ndarray, values: np.ndarray) -> bytes:
    """A sorted hash array of distinct ``key`` with rows of ``values`` (u8)."""
    n, width = values.shape
    order = np.argsort(key)
    key, values = key[order], values[order]
    bits = max(0, int(n // 16).bit_length() - 1)
    low = (key >> np.uint64(32 - bits)).astype(np.uint32)
    offsets = np.searchsorted(key, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
    offsets = np.concatenate([[0], offsets, [n]]).astype(np.uint64 if n >= 1 << 32 else np.uint32)
    code = values[:, 0].copy()
    for j in range(1, width):
        code = _pair(code, values[:, j])
    _, first, at, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    common = np.argsort(-count, kind="stable")[:255]
    number = np.full(len(count), 255, np.uint8)
    number[common] = np.arange(len(common))
    code = number[at] if n else np.empty(0, np.uint8)
    rest = np.flatnonzero(code == 255)
    head = np.array([n, width, bits, len(common), len(rest), offsets.itemsize, 0, 0], np.uint64)
    parts = [head, values[first[common]] if n else values, key[rest], values[rest], offsets, low, code]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


class Table:
    """What ``_table`` wrote, over mapped memory."""

    def __init__(self, raw: np.ndarray):
        n, width, bits, common, rest, size = (int(x) for x in raw[:64].view(np.uint64)[:6])
        at = 64

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            out = raw[at : at + count * np.dtype(kind).itemsize].view(kind)
            at += count * np.dtype(kind).itemsize
            return out

        self.n, self.width, self.bits = n, width, bits
        self.common = take(common * width, np.uint64).reshape(common, width)
        self.rest_key = take(rest, np.uint64)
        self.rest = take(rest * width, np.uint64).reshape(rest, width)
        self.offsets = take((1 << bits) + 1, np.uint32 if size == 4 else np.uint64)
        self.low, self.code = take(n, np.uint32), take(n, np.uint8)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The values of each key; zeros where there is none."""
        out = np.zeros((len(key), self.width), np.uint64)
        if not self.n:
            return out
        bucket = (key >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(key), np.int64)
        asked = (key >> np.uint64(32 - self.bits)).astype(np.uint32)
        lo, end = self.offsets[bucket].astype(np.int64), self.offsets[bucket + 1].astype(np.int64)
        hi = end.copy()
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = np.minimum((lo + hi) >> 1, self.n - 1)
            less = (self.low[mid] < asked) & (lo < hi)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(less, hi, np.maximum(mid, lo))
        hit = np.flatnonzero((lo < end) & (self.low[np.minimum(lo, self.n - 1)] == asked))
        code = self.code[lo[hit]]
        usual = code < 255
        out[hit[usual]] = self.common[code[usual]]
        odd = hit[~usual]
        if len(odd):
            at = np.minimum(np.searchsorted(self.rest_key, key[odd]), len(self.rest_key) - 1)
            same = self.rest_key[at] == key[odd]
            out[odd[same]] = self.rest[at[same]]
        return out


class Words:
    """Sorted word hashes of a bucket with their numbers and counts."""

    KIND = np.dtype([("key", "<u8"), ("rank", "<u4"), ("count", "<u4")])
    WIDE = np.dtype([("key", "<u8"), ("rank", "<u8"), ("count", "<u8")])

    def __init__(self, raw: np.ndarray):
        self.rows = raw[8:].view(self.WIDE if raw[0] else self.KIND)

    @classmethod
    def bytes_of(cls, key: np.ndarray, rank: np.ndarray, count: np.ndarray) -> bytes:
        wide = len(key) >= 1 << 32 or bool(len(count) and count.max() >= 1 << 32)
        rows = np.empty(len(key), cls.WIDE if wide else cls.KIND)
        rows["key"], rows["rank"], rows["count"] = key, rank, count
        return bytes([wide]) + bytes(7) + rows.tobytes()


class _Pack:
    """A file's parts, mapped.

    Of a file that can't be mapped where it lies, parts are fetched when they are first asked for, into a sparse file on
    the worker's own disk that goes with the mapping.
    """

    def __init__(self, path: str, files=None):
        self.tables: dict[int, Table | Words | None] = {}
        self.spooled, self.source = 0, None
        if files is None:
            self.raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
            size = len(self.raw)
            tail = lambda n: self.raw[size - n :].tobytes()
        else:
            self.source = files.open_input_file(path)
            size = self.source.size()
            tail = lambda n: self.source.read_at(n, size - n)
            self.spool = tempfile.TemporaryFile()
            self.spool.truncate(size)
            self.raw = np.memmap(self.spool, np.uint8, "r").view(np.ndarray)
        n = int(np.frombuffer(tail(8), np.int64)[0])
        table = np.frombuffer(tail(8 * (3 * n + 1)), np.int64)
        self.parts, self.begin, self.end = table[:n], table[n : 2 * n], table[2 * n : 3 * n]

    def get(self, part: int, kind) -> Table | Words | None:
        if part not in self.tables:
            at = int(np.searchsorted(self.parts, part))
            if at == len(self.parts) or self.parts[at] != part:
                self.tables[part] = None
            else:
                lo, hi = int(self.begin[at]), int(self.end[at])
                if self.source is not None:
                    self.spool.seek(lo)
                    self.spool.write(self.source.read_at(hi - lo, lo))
                    self.spool.flush()
                    self.spooled += hi - lo
                self.tables[part] = kind(self.raw[lo:hi])
        return self.tables[part]


class _Writer:
    """What one task writes: a file for each kind, named when the task has written all of it."""

    def __init__(self, store: Store):
        self.store, self.open = store, {}

    def __enter__(self) -> _Writer:
        return self

    def put(self, kind: str, part: int, data: bytes) -> None:
        name = self.store.file_of(kind, part)
        if name not in self.open:
            own = f".{name}-{uuid.uuid4().hex}"
            self.open[name] = own, self.store.create(own), []
        _, stream, held = self.open[name]
        at = held[-1][2] + -held[-1][2] % 8 if held else 0
        if held:
            stream.write(bytes(at - held[-1][2]))
        stream.write(data)
        held.append((part, at, at + len(data)))

    def __exit__(self, kind, *_) -> None:
        for name, (own, stream, held) in self.open.items():
            if kind is None:
                table = np.array(sorted(held), np.int64).T
                stream.write(table.tobytes() + np.int64(len(held)).tobytes())
            stream.close()
            if kind is None:
                self.store.rename(own, name)


class Store:
    """Arrays of many parts, a file for each kind and task that wrote them, in a folder that all executors see.

    Part p lies in file p % ``files``; a file ends with a table of where its parts begin and end. A worker holds the
    files it used last, at most ``OPEN``, and at most about ``SPOOL`` bytes of parts that had to be fetched.
    """

    OPEN, SPOOL = 64, 1 << 30

    def __init__(self, path: str, files: int):
        self.path, self.files = path, files
        self.local = path.removeprefix("file://") if path.startswith(("file:", "/")) else None
        self.open: OrderedDict[str, _Pack | None] = OrderedDict()

    def __getstate__(self):
        return self.path, self.files

    def __setstate__(self, state: tuple[str, int]):
        self.__init__(*state)

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def file_of(self, kind: str, part: int) -> str:
        return f"{kind}-{part % self.files}"

    def create(self, name: str):
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            return open(f"{self.local}/{name}", "wb")
        files, root = self._remote()
        files.create_dir(root, recursive=True)
        return files.open_output_stream(f"{root}/{name}")

    def rename(self, own: str, name: str) -> None:
        if self.local:
            os.replace(f"{self.local}/{own}", f"{self.local}/{name}")
        else:
            files, root = self._remote()
            files.move(f"{root}/{own}", f"{root}/{name}")

    def writer(self) -> _Writer:
        return _Writer(self)

    def _pack(self, name: str) -> _Pack | None:
        if self.local:
            return _Pack(f"{self.local}/{name}") if os.path.exists(f"{self.local}/{name}") else None
        from pyarrow import fs

        files, root = self._remote()
        return None if files.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound else _Pack(f"{root}/{name}", files)

    def get(self, kind: str, part: int) -> Table | Words | None:
        name = self.file_of(kind, part)
        if name not in self.open:
            if len(self.open) >= self.OPEN:
                self.open.popitem(last=False)
            self.open[name] = self._pack(name)
        self.open.move_to_end(name)
        pack = self.open[name]
        if pack is None:
            return None
        before = pack.spooled
        found = pack.get(part, Words if kind == "word" else Table)
        if pack.spooled > before:
            total = sum(x.spooled for x in self.open.values() if x is not None)
            while total > self.SPOOL:  # this one too, if it alone is too large: what is in use lasts until it has been used
                _, old = self.open.popitem(last=False)
                total -= old.spooled if old is not None else 0
        return found

    def _by_part(self, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Parts file after file, so that each file is opened once."""
        order = np.lexsort((part, part % self.files))
        part = part[order]
        for lo, hi in zip(*_runs(part), strict=True):
            yield int(part[lo]), order[lo:hi]

    def find(self, kind: str, width: int, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The stored values of the keys; zeros where there is none."""
        out = np.zeros((len(key), width), np.uint64)
        for p, at in self._by_part(part):
            table = self.get(kind, p)
            if table is not None:
                out[at] = table.find(key[at])
        return out

    def numbers(self, key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The number and the count of each word hash; ``NONE`` and 0 for unknown ones."""
        number, count = np.full(len(key), NONE), np.zeros(len(key), np.uint64)
        for p, at in self._by_part((key % np.uint64(buckets)).astype(np.int64)):
            held = self.get("word", p)
            if held is None or not len(held.rows):
                continue
            place = np.minimum(np.searchsorted(held.rows["key"], key[at]), len(held.rows) - 1)
            hit = held.rows["key"][place] == key[at]
            number[at[hit]] = held.rows["rank"][place[hit]].astype(np.uint64) * np.uint64(buckets) + np.uint64(p + 1)
            count[at[hit]] = held.rows["count"][place[hit]]
        return number, count


# Counting ---------------------------------------------------------------------------------------------------------


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each token's hash, and where each text's tokens begin."""
    w = words(texts, lower=True)
    n = len(w.offsets) - 1
    off = w.offsets + np.arange(n + 1)
    token = np.full(len(w.hash) + n, END)
    last = np.zeros(len(token), bool)
    last[off[1:] - 1] = True
    token[~last] = w.hash
    return token, off


def _before(number: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the number of the one before it, and of the one before that."""
    v = np.empty_like(number)
    v[1:] = number[:-1]
    v[off[:-1]] = BEGIN
    u = np.empty_like(v)
    u[1:] = v[:-1]
    u[off[:-1]] = BEGIN
    return v, u


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, a byte plane after the other; compressed where there is enough of them."""
    sizes, planes = [], []
    for c in columns:
        c = np.ascontiguousarray(c, np.uint64)
        sizes.append(max(1, (int(c.max(initial=0)).bit_length() + 7) // 8))
        planes.append(c.view(np.uint8).reshape(-1, 8)[:, : sizes[-1]].T.tobytes())
    raw = b"".join(planes)
    press = len(raw) > 200
    return bytes([press, len(sizes), *sizes]) + (zstandard.ZstdCompressor(level=3).compress(raw) if press else raw)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    press, width = blob[0], blob[1]
    sizes, raw = blob[2 : 2 + width], blob[2 + width :]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw) if press else raw, np.uint8).reshape(sum(sizes), -1)
    out, at = [], 0
    for size in sizes:
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, :size] = planes[at : at + size].T
        out.append(wide.view(np.uint64).ravel())
        at += size
    return out


BLOBS = "kind string, target int, blob binary"


def _blobs(kind: str, target: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows dealt to targets, packed by target in the order they have."""
    order = np.argsort(target, kind="stable")
    target = target[order]
    begin, end = _runs(target)
    found = [_packed(*(c[order[lo:hi]] for c in columns)) for lo, hi in zip(begin, end, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(found), pa.string()), pa.array(target[begin].astype(np.int32)), pa.array(found, pa.binary())], names=["kind", "target", "blob"])


class _Gather:
    """Rows of a task that go to targets by ``target`` of their first columns, packed when there are many."""

    def __init__(self, kind: str, target, summed: bool = False):
        self.kind, self.target, self.summed, self.held, self.n = kind, target, summed, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(columns)
            self.n += len(columns[0])
        if self.n >= CHUNK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
            if self.summed:
                at, *values = _grouped(*columns)
                columns = [columns[0][at], *values]
            self.held, self.n = [], 0
            yield _blobs(self.kind, self.target(*columns[:2]), *columns)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each target, whose blobs lie one after the other."""
    target, blobs = None, []

    def whole():
        return target, [np.concatenate(c) for c in zip(*map(_unpacked, blobs), strict=True)]

    for b in batches:
        for t, blob in zip(b.column("target").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if t != target and blobs:
                yield whole()
                blobs = []
            target = t
            blobs.append(blob)
    if blobs:
        yield whole()


def _grouped(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where each distinct key first is, and the sums of its values."""
    order = np.argsort(key, kind="stable")
    head, _ = _runs(key[order])
    return order[head], *(np.add.reduceat(v[order], head) if len(key) else v for v in values)


def _classes(count: np.ndarray) -> list[np.ndarray]:
    return [(count == 1).astype(np.uint64), (count == 2).astype(np.uint64), (count > 2).astype(np.uint64)]


def _dealt(of: DataFrame, n: int) -> DataFrame:
    """A task for each remainder of the target, which writes one file of a kind."""
    return of.repartitionById(n, F.pmod("target", F.lit(n))).sortWithinPartitions("target").select("target", "blob")


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def chunk() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(held), return_counts=True)
            return _blobs("words", (key % np.uint64(buckets)).astype(np.int64), key, count)

        for part in slices(batches, "text"):
            token, _ = _tokens(part.column("text"))
            held.append(token)
            n += len(token)
            if n >= 2 * CHUNK:
                yield chunk()
                held, n = [], 0
        if n:
            yield chunk()

    return run


SUMS = "what string, a long, b long, c long, d long"


def _told(what: str, *values) -> pa.RecordBatch:
    values = [*map(int, values), *[0] * (4 - len(values))]
    return pa.RecordBatch.from_arrays([pa.array([what]), *(pa.array([v], pa.int64()) for v in values)], names=["what", "a", "b", "c", "d"])


def _number_words(store: Store):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with store.writer() as out:
            for bucket, (key, count) in _gathered(batches):
                at, count = _grouped(key, count)
                key = key[at]
                rank = np.empty(len(key), np.uint64)
                rank[np.argsort(-count.astype(np.int64), kind="stable")] = np.arange(len(key), dtype=np.uint64)
                out.put("word", bucket, Words.bytes_of(key, rank, count))
                yield _told("words", len(key), count.sum())

    return run


def _common_words(store: Store, buckets: int, least: int):
    """Words with more tokens than ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket in b.column(0).to_pylist():
                held = store.get("word", bucket)
                if held is not None:
                    at = np.flatnonzero(held.rows["count"] > least)
                    number = held.rows["rank"][at].astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(number.view(np.int64)), pa.array(held.rows["count"][at].astype(np.int64))], names=["number", "count"])

    return run


@dataclass
class Layout:
    """Where n-grams lie. ``common`` (sorted): the words dealt to several parts, and to how many; at most two a part."""

    order: int
    buckets: int
    parts: int
    common: np.ndarray
    times: np.ndarray

    def is_common(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.common):
            return np.zeros(len(v), bool), np.zeros(len(v), np.int64)
        at = np.minimum(np.searchsorted(self.common, v), len(self.common) - 1)
        return self.common[at] == v, at

    def part(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        hit, at = self.is_common(v)
        salt = np.zeros(len(v), np.uint64)
        if hit.any():
            salt[hit] = mix((u if self.order == 3 else w)[hit] + _G) % self.times[at[hit]]
        return (_pair(v, salt) % np.uint64(self.parts)).astype(np.int64)

    def suffix_part(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For suffixes of common words."""
        return (_pair(w, v) % np.uint64(self.parts)).astype(np.int64)

    def bucket(self, number: np.ndarray) -> np.ndarray:
        return (number % np.uint64(self.buckets)).astype(np.int64)


def _numbered(store: Store, buckets: int, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(token, return_inverse=True)
    number, count = store.numbers(known, buckets)
    return number[at], count[at]


def _ngrams(store: Store, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def chunk() -> pa.RecordBatch:
            w, v, u = (np.concatenate(c) for c in zip(*held, strict=True))
            if layout.order == 2:
                u = np.zeros(len(w), np.uint64)
            _, first, count = np.unique(_pair(_pair(u, v), w), return_index=True, return_counts=True)
            u, v, w = u[first], v[first], w[first]
            order = np.lexsort((w, u, v))
            u, v, w, count = u[order], v[order], w[order], count[order]
            return _blobs("ngrams", layout.part(u, v, w), u, v, w, count)

        for piece in slices(batches, "text"):
            token, off = _tokens(piece.column("text"))
            number, _ = _numbered(store, layout.buckets, token)
            held.append((number, *_before(number, off)))
            n += len(token)
            if n >= CHUNK:
                yield chunk()
                held, n = [], 0
        if n:
            yield chunk()

    return run


def _suffixes(out: _Writer, told: _Gather, kind: str, part: int, v: np.ndarray, w: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stores distinct (v, w) with their counts, and passes on what v needs as a context and w as a word."""
    out.put(kind, part, _table(_pair(v, w), count[:, None]))
    yield pa.RecordBatch.from_arrays([pa.array(["told"]), pa.array([1], pa.int32()), pa.array([pickle.dumps([int((count == k).sum()) for k in (1, 2, 3, 4)])], pa.binary())], names=["kind", "target", "blob"])
    at, total, *classes = _grouped(v, count, *_classes(count))
    none = np.zeros(len(at), np.uint64)
    yield from told.add(v[at], none, total, *classes)
    at, kinds = _grouped(w, np.ones(len(w), np.uint64))
    none = np.zeros(len(at), np.uint64)
    yield from told.add(w[at], kinds, none, none, none, none)


def _merge(store: Store, layout: Layout):
    """Stores each part's n-grams, contexts and suffixes; the suffixes of common words go on to meet once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shared = _Gather("words", lambda x, _: layout.bucket(x), True), _Gather("shared", layout.suffix_part)
        with store.writer() as out:
            for part, (u, v, w, count) in _gathered(batches):
                key = _pair(_pair(u, v), w)
                at, count = _grouped(key, count)
                key, u, v, w = key[at], u[at], v[at], w[at]
                adjusted = count
                if layout.order == 3:
                    out.put("ngram", part, _table(key, count[:, None]))
                    context = _pair(u, v)
                    at, total, *classes = _grouped(context, count, *_classes(count))
                    out.put("context", part, _table(context[at], np.stack([total, *classes], 1)))
                    told = pickle.dumps([int((count == k).sum()) for k in (1, 2, 3, 4)])
                    yield pa.RecordBatch.from_arrays([pa.array(["told"]), pa.array([0], pa.int32()), pa.array([told], pa.binary())], names=["kind", "target", "blob"])
                    # what begins a text follows nothing, so it keeps its count
                    adjusted = np.where(v == BEGIN, count, np.uint64(1))
                at, adjusted = _grouped(_pair(v, w), adjusted)
                v, w = v[at], w[at]
                common, _ = layout.is_common(v)
                if common.any():
                    yield from shared.add(v[common], w[common], adjusted[common])
                yield from _suffixes(out, sums, "suffix", part, v[~common], w[~common], adjusted[~common])
        yield from sums.flush()
        yield from shared.flush()

    return run


def _merge_shared(store: Store, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Gather("words", lambda x, _: layout.bucket(x), True)
        with store.writer() as out:
            for part, (v, w, count) in _gathered(batches):
                at, count = _grouped(_pair(v, w), count)
                yield from _suffixes(out, sums, "shared", part, v[at], w[at], count)
        yield from sums.flush()

    return run


def _keep(store: Store):
    """Stores what words need; returns, by bucket, what is summed over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with store.writer() as out:
            for bucket, (number, *values) in _gathered(batches):
                at, *values = _grouped(number, *values)
                out.put("unigram", bucket, _table(mix(number[at]), np.stack(values, 1)))
                kinds = values[0]
                yield _told("kinds", *((kinds == k).sum() for k in (1, 2, 3, 4)))
                yield _told("totals", kinds.sum(), (kinds > 2).sum())

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the counts of counts; 1/2, 1 and 3/2 where these give none in range."""
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        if all(0 < x <= k for k, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


_FALLBACK = (0.5, 1.0, 1.5)


@dataclass
class Model:
    store: Store
    layout: Layout
    n_tokens: int = 0
    n_words: int = 0
    #: Distinct pairs of words that follow each other, and words by how many others they follow: 1, 2 or more.
    n_pairs: int = 0
    word_classes: tuple[int, int, int] = (0, 0, 0)
    ngram_discounts: tuple[float, float, float] = _FALLBACK
    suffix_discounts: tuple[float, float, float] = _FALLBACK
    word_discounts: tuple[float, float, float] = field(default=_FALLBACK)


def train(docs: DataFrame, text_col: str = "text", order: int = 3) -> Model:
    """Counts all of ``docs``. What comes to the driver is at most two words a part, and sums over all parts."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    source = docs.select(clean_text(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = n
    store = Store(new_path(spark, "ngrams"), n)
    empty = Layout(order, buckets, 1, np.empty(0, np.uint64), np.empty(0, np.uint64))
    counted = written(_dealt(source.mapInArrow(_count_words(buckets), BLOBS), n).mapInArrow(_number_words(store), SUMS), "sums")
    n_words, n_tokens = counted.agg(F.sum("a"), F.sum("b")).first()
    drop_written(counted)
    if not n_words:
        return Model(store, empty)
    parts = max(n, -(-n_tokens // PART_TOKENS))
    least = max(1, n_tokens // parts // 2)
    found = spark.range(0, buckets, 1, n).mapInArrow(_common_words(store, buckets, least), "number long, count long").toArrow()
    common, often = found["number"].to_numpy().view(np.uint64), found["count"].to_numpy()
    by = np.argsort(common)
    layout = Layout(order, buckets, parts, common[by], (often[by] // least + 1).astype(np.uint64))
    sums = written(_dealt(source.mapInArrow(_ngrams(store, layout), BLOBS), n).mapInArrow(_merge(store, layout), BLOBS), "sums")
    shared = written(_dealt(sums.where("kind = 'shared'"), n).mapInArrow(_merge_shared(store, layout), BLOBS), "sums")
    both = sums.where("kind <> 'shared'").unionByName(shared)
    words_ = written(_dealt(both.where("kind = 'words'"), n).mapInArrow(_keep(store), SUMS), "sums")
    told = {r["what"]: r for r in words_.groupBy("what").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()}

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for level, blob in zip(b.column("target").to_pylist(), b.column("blob").to_pylist(), strict=True):
                yield _told(str(level), *pickle.loads(blob))

    levels = {r["what"]: discounts(*list(r)[1:]) for r in both.where("kind = 'told'").select("target", "blob").mapInArrow(unfold, SUMS).groupBy("what").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()}
    drop_written(sums, shared, words_)
    k, t = told["kinds"], told["totals"]
    return Model(store, layout, n_tokens, n_words, t["a"], (k["a"], k["b"], t["b"]), levels.get("0", _FALLBACK), levels["1"], discounts(k["a"], k["b"], k["c"], k["d"]))


# Scoring ----------------------------------------------------------------------------------------------------------


def _off(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3).astype(np.int64)]


def _mixed(count: np.ndarray, context: np.ndarray, d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """The discounted share of the n-gram in its context (total, followers by class), and the rest by the lower order."""
    total, once, twice, more = (context[:, j].astype(float) for j in range(4))
    count = count.astype(float)
    own = np.maximum(count - _off(count, d), 0) / np.maximum(total, 1)
    spare = np.where(total > 0, (d[0] * once + d[1] * twice + d[2] * more) / np.maximum(total, 1), 1.0)
    return own + spare * lower


def probabilities(model: Model, token: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(token | the tokens before it) of each token of some texts, and its training count."""
    P, layout = model.store, model.layout
    if not model.n_pairs:
        return np.full(len(token), 1.0 / (model.n_words + 1)), np.zeros(len(token), np.uint64)
    number, counts = _numbered(P, layout.buckets, token)
    v, u = _before(number, off)
    if layout.order == 2:
        u = np.zeros(len(v), np.uint64)
    _, first, back = np.unique(_pair(_pair(u, v), number), return_index=True, return_inverse=True)
    u, v, w = u[first], v[first], number[first]
    words_, at = np.unique(np.concatenate([w, v]), return_inverse=True)
    told = P.find("unigram", 5, layout.bucket(words_), mix(words_))
    w_at, v_at = at[: len(w)], at[len(w) :]
    kinds = told[:, 0].astype(float)
    left = sum(d * m for d, m in zip(model.word_discounts, model.word_classes, strict=True)) / model.n_pairs
    lower = (np.maximum(kinds - _off(kinds, model.word_discounts), 0) / model.n_pairs + left / (model.n_words + 1))[w_at]
    key, some, again = np.unique(_pair(v, w), return_index=True, return_inverse=True)
    common, _ = layout.is_common(v[some])
    count = np.zeros(len(key), np.uint64)
    for kind, mine, part in (("suffix", ~common, layout.part), ("shared", common, None)):
        x, y = v[some[mine]], w[some[mine]]
        if len(x):
            where = part(x, x, y) if part else layout.suffix_part(x, y)
            count[mine] = P.find(kind, 1, where, key[mine])[:, 0]
    p = _mixed(count[again], told[v_at, 1:], model.suffix_discounts, lower)
    if layout.order == 3:
        part = layout.part(u, v, w)
        count = P.find("ngram", 1, part, _pair(_pair(u, v), w))[:, 0]
        key, some, again = np.unique(_pair(u, v), return_index=True, return_inverse=True)
        context = P.find("context", 4, part[some], key)[again]
        p = _mixed(count, context, model.ngram_discounts, p)
    return p[back], counts


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep, n_tokens, n_known, base_score, score`` of every row: log10 probabilities of whole texts."""
    source = docs.select(*keep, clean_text(text_col).alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) + "n_tokens long, n_known long, base_score double, score double"
    m = model  # goes with the function: a path, a few sums, and at most two words a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 4_000_000):
            token, off = _tokens(part.column("_text"))
            p, count = probabilities(m, token, off)
            base = np.log10((count.astype(float) + 1) / (m.n_tokens + m.n_words + 1))
            add = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  every text has a token
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(np.diff(off)), pa.array(add((count > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)))], names=[*keep, "n_tokens", "n_known", "base_score", "score"])

    return source.mapInArrow(run, schema)


def perplexity(scored: DataFrame) -> float:
    total, tokens = scored.agg(F.sum("score"), F.sum("n_tokens")).first()
    return math.pow(10, -total / tokens) if tokens else float("nan")
