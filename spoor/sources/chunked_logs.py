"""Chunked message logs (MCAP): records, compressed chunks with checksums, and an index that prunes them.

A file is a magic number, records (one byte of kind, eight of length, the body), a summary with all types, topics and
chunks, and a footer that says where the summary is. A chunk's entry has the range of its times and its topics, so a
filter by time or topic leaves chunks packed. Files are found as Spark finds them (``binaryFile``), so any store will do. Of
files in mounted folders (``file:``) workers read the index and then a chunk at a time; those of other stores come as Spark
reads them, whole. A file that ends early (its recorder was killed) has no summary, and its records are walked through instead.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x89MCAP0\r\n"
#: The kinds of records.
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, STATISTICS, DATA_END = 1, 2, 3, 4, 5, 6, 7, 8, 11, 15
_KNOWN_CODECS = ("", "lz4", "zstd")
MESSAGES = "path string, topic string, msgtype string, conn_id int, log_ts_ns long, seq long, raw binary"
CHUNKS = "path string, first long, packing string, size long, crc long, data binary, channels string, wanted string"
TOPICS = "path string, conn_id int, topic string, msgtype string, encoding string, definition string"
#: Types of one table's logs; their definitions go to the driver.
MOST_TYPES = 10_000
#: Messages that a worker gathers before it hands them on: so many, or bytes.
BATCH, BATCH_BYTES = 1000, 4_000_000
#: The least that is read of a file at once.
BLOCK = 65_536


class Ranged:
    """A file's bytes by place, read when asked for, as slices of ``memoryview`` would give them."""

    def __init__(self, path: str):
        self.file = pa.OSFile(path, "rb")
        self.size, self.start, self.block = self.file.size(), 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, where):
        start, stop, _ = (where if isinstance(where, slice) else slice(where, where + 1)).indices(self.size)
        n = max(0, stop - start)
        if not (self.start <= start and start + n <= self.start + len(self.block)):
            if n >= BLOCK:
                return memoryview(self.file.read_at(n, start))
            self.start, self.block = start, self.file.read_at(BLOCK, start)
        out = memoryview(self.block)[start - self.start : start - self.start + n]
        return out if isinstance(where, slice) else out[0]


class _Cursor:
    def __init__(self, raw: memoryview | Ranged, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, kind: str):
        size = struct.calcsize("<" + kind)
        (out,) = struct.unpack("<" + kind, self.raw[self.at : self.at + size])
        self.at += size
        return out

    def block(self, kind: str = "I") -> memoryview:
        n = self.take(kind)
        if self.at + n > len(self.raw):
            raise ValueError("a record ends before its content")
        out = self.raw[self.at : self.at + n]
        self.at += n
        return out

    def text(self) -> str:
        return bytes(self.block()).decode()


def _places(raw: memoryview | Ranged, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Kind, place of the body and its length, of each whole record; one that is cut off ends them."""
    while at + 9 <= end:
        kind, size = struct.unpack("<BQ", raw[at : at + 9])
        if at + 9 + size > end:
            return
        yield kind, at + 9, size
        at += 9 + size


def records(raw: memoryview, at: int, end: int) -> Iterator[tuple[int, memoryview]]:
    """Kind and body of each whole record."""
    for kind, start, size in _places(raw, at, end):
        yield kind, raw[start : start + size]


@dataclass
class Chunk:
    """``first``: the place in the file of its first message, from 1; ``topics``: ids of its channels, or None if unknown.

    Its data are read from ``raw`` each time they are asked for.
    """

    low: int
    high: int
    first: int
    packing: str
    size: int
    crc: int
    raw: memoryview | Ranged
    at: int
    length: int
    topics: set[int] | None = None

    @property
    def data(self) -> memoryview:
        return self.raw[self.at : self.at + self.length]


@dataclass
class Index:
    """``schemas`` by id: name, encoding, text; ``channels`` by id: topic and schema."""

    schemas: dict[int, tuple[str, str, str]] = field(default_factory=dict)
    channels: dict[int, tuple[str, int]] = field(default_factory=dict)
    chunks: list[Chunk] = field(default_factory=list)

    def learn(self, kind: int, body: memoryview) -> None:
        c = _Cursor(body)
        if kind == SCHEMA:
            number = c.take("H")
            self.schemas[number] = (c.text(), c.text(), bytes(c.block()).decode("utf-8", "replace"))
        elif kind == CHANNEL:
            number, schema = c.take("H"), c.take("H")
            self.channels[number] = (c.text(), schema)

    def kind_of(self, channel: int) -> tuple[str, str]:
        """Topic and type name."""
        topic, schema = self.channels[channel]
        return topic, self.schemas[schema][0] if schema else ""


def _chunk(raw: memoryview | Ranged, at: int, end: int, first: int) -> Chunk:
    """Of a record's body from ``at`` to ``end``."""
    c = _Cursor(raw, at)
    low, high, size, crc, packing, length = c.take("Q"), c.take("Q"), c.take("Q"), c.take("I"), c.text(), c.take("Q")
    if c.at + length > end:
        raise ValueError("a record ends before its content")
    return Chunk(low, high, first, packing, size, crc, raw, c.at, length)


def unpacked(packing: str, data: bytes | memoryview, size: int, crc: int) -> memoryview:
    """A chunk's records; an error where its checksum (0: none) says that they are others."""
    if packing not in _KNOWN_CODECS:
        raise ValueError(f"chunks packed as {packing} can't be read")
    raw = memoryview(data).cast("B") if not packing else memoryview(pa.decompress(pa.py_buffer(bytes(data)), size, codec=packing, asbytes=True)) if size else memoryview(b"")
    if crc and zlib.crc32(raw) != crc:
        raise ValueError("a chunk's checksum does not match")
    return raw


def read_index(content: bytes | Ranged) -> Index:
    """From the summary, or else from all records."""
    raw = content if isinstance(content, Ranged) else memoryview(content).cast("B")
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a chunked log")
    end = len(raw) - len(MAGIC)
    footer = end - 29
    if footer > len(MAGIC) and raw[end:] == MAGIC and raw[footer] == FOOTER:
        start, _, crc = struct.unpack("<QQI", raw[footer + 9 : footer + 29])
        if crc and zlib.crc32(raw[start : end - 4]) != crc:
            raise ValueError("the summary's checksum does not match")
        found = _from_summary(raw, start, footer) if start else None
        if found:
            return found
    return _from_records(raw)


def _from_summary(raw: memoryview | Ranged, start: int, end: int) -> Index | None:
    out, entries, told = Index(), [], 0
    summary = raw[start:end]
    for kind, body in records(summary, 0, len(summary)):
        out.learn(kind, body)
        if kind == CHUNK_INDEX:
            c = _Cursor(body)
            _, _, at, _ = c.take("Q"), c.take("Q"), c.take("Q"), c.take("Q")
            places = c.block()
            entries.append((at, dict(struct.iter_unpack("<HQ", places))))
        elif kind == STATISTICS:
            told = struct.unpack_from("<Q", body)[0]
    first = 1
    for at, places in sorted(entries, key=lambda e: e[0]):
        _, body, size = next(_places(raw, at, len(raw)))
        chunk = _chunk(raw, body, body + size, first)
        if not places:  # without an index of its messages, a chunk tells neither number nor topics
            return None
        chunk.topics = set(places)
        out.chunks.append(chunk)
        for place in places.values():
            _, listed, _ = next(_places(raw, place, len(raw)))
            first += struct.unpack("<I", raw[listed + 2 : listed + 6])[0] // 16
    return out if first - 1 == told else None


def _from_records(raw: memoryview | Ranged) -> Index:
    out, first = Index(), 1
    for kind, at, size in _places(raw, len(MAGIC), len(raw)):
        if kind in (DATA_END, FOOTER):
            break
        if kind in (SCHEMA, CHANNEL):
            out.learn(kind, raw[at : at + size])
        elif kind == CHUNK:
            chunk = _chunk(raw, at, at + size, first)
            chunk.topics = set()
            for k, b in records(inside := unpacked(chunk.packing, chunk.data, chunk.size, chunk.crc), 0, len(inside)):
                out.learn(k, b)
                if k == MESSAGE:
                    chunk.topics.add(struct.unpack_from("<H", b)[0])
                    first += 1
            out.chunks.append(chunk)
        elif kind == MESSAGE:  # outside a chunk: one of its own, not packed
            channel, _, time = struct.unpack("<HIQ", raw[at : at + 14])
            out.chunks.append(Chunk(time, time, first, "", size + 9, 0, raw, at - 9, size + 9, {channel}))
            first += 1
    return out


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path, content``; of files in mounted folders without their content, which workers read by pieces."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.select("path", F.lit(None).cast("binary").alias("content") if store.getUri().getScheme() == "file" else "content")


def _indexes(batch: pa.RecordBatch) -> Iterator[tuple[str, Index]]:
    for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield name, read_index(content.as_buffer() if content.is_valid else Ranged("/" + name.removeprefix("file:").lstrip("/")))


def read_topics(spark: SparkSession, path: str, glob: str = "*.mcap") -> DataFrame:
    """Every channel of every file, with the definition of its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, index in _indexes(batch):
                rows = [(name, k, topic, *index.schemas.get(schema, ("", "", ""))) for k, (topic, schema) in sorted(index.channels.items())]
                yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in TOPICS.split(", ")), r, strict=True)) for r in rows], schema=pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.string()) for c in TOPICS.split(", ")]))

    return _files(spark, path, glob).mapInArrow(run, TOPICS)


def definitions_of(topics: DataFrame) -> dict[str, str]:
    """One definition a type name. Types are few: more than ``MOST_TYPES`` are an error, as are two definitions for one name."""
    rows = topics.where("encoding = 'ros2msg' AND definition <> ''").select("msgtype", "definition").distinct().limit(MOST_TYPES + 1).collect()
    out = {r["msgtype"]: r["definition"] for r in rows}
    if len(rows) > MOST_TYPES or len(out) < len(rows):
        raise ValueError("too many types, or a type with two definitions; read the logs apart")
    return out


def _wanted(index: Index, start: int | None, end: int | None, topics: list[str] | None) -> tuple[set[int], Iterator[Chunk]]:
    """Channels of these topics, and the chunks that may have their messages."""
    wanted = {k for k, (topic, _) in index.channels.items() if topics is None or topic in topics}
    return wanted, (c for c in index.chunks if not ((start is not None and c.high < start) or (end is not None and c.low >= end) or (c.topics is not None and not c.topics & wanted)))


def read_chunks(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, topics: list[str] | None = None, glob: str = "*.mcap") -> DataFrame:
    """The chunks that may have messages of these topics from ``start`` to before ``end`` (nanoseconds), still packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, index in _indexes(batch):
                named = json.dumps({k: index.kind_of(k) for k in index.channels})
                wanted, chunks = _wanted(index, start, end, topics)
                for c in chunks:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([c.first], pa.int64()), pa.array([c.packing]), pa.array([c.size], pa.int64()), pa.array([c.crc], pa.int64()), pa.array([bytes(c.data)], pa.binary()), pa.array([named]), pa.array([json.dumps(sorted(wanted))])], names=[x.split()[0] for x in CHUNKS.split(", ")])

    return _files(spark, path, glob).mapInArrow(run, CHUNKS)


_KINDS = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
_NAMES = [x.split()[0] for x in MESSAGES.split(", ")]


def _messages(path: str, first: int, raw: memoryview, channels: Mapping[int, tuple[str, str]], wanted: set[int], start: int | None, end: int | None) -> Iterator[pa.RecordBatch]:
    """``MESSAGES`` of an unpacked chunk."""
    rows, held, seq = [], 0, first - 1
    for kind, body in records(raw, 0, len(raw)):
        if kind != MESSAGE:
            continue
        seq += 1
        channel, _, time = struct.unpack_from("<HIQ", body)
        if channel not in wanted or (start is not None and time < start) or (end is not None and time >= end):
            continue
        rows.append((path, *channels[channel], channel, time, seq, bytes(body[22:])))
        held += len(body)
        if len(rows) == BATCH or held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def read_log(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, topics: list[str] | None = None, glob: str = "*.mcap", spread: int | None = None) -> DataFrame:
    """``MESSAGES`` of all files that match, in files' order by ``seq``.

    A worker holds a chunk at a time. ``spread`` deals the packed chunks to that many tasks before they are opened: for few large files.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, index in _indexes(batch):
                channels = {k: index.kind_of(k) for k in index.channels}
                wanted, chunks = _wanted(index, start, end, topics)
                for c in chunks:
                    yield from _messages(name, c.first, unpacked(c.packing, c.data, c.size, c.crc), channels, wanted, start, end)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (c,) = batch.slice(k, 1).to_pylist()
                channels = {int(n): v for n, v in json.loads(c["channels"]).items()}
                yield from _messages(c["path"], c["first"], unpacked(c["packing"], c["data"], c["size"], c["crc"]), channels, set(json.loads(c["wanted"])), start, end)

    if not spread:
        return _files(spark, path, glob).mapInArrow(opened, MESSAGES)
    return read_chunks(spark, path, start, end, topics, glob).repartition(spread).mapInArrow(dealt, MESSAGES)


# Writing -------------------------------------------------------------------------------------------------------------


def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<BQ", kind, len(body)) + body


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<I", len(raw)) + raw


class LogWriter:
    """Writes one file to ``out`` (with ``write``): messages in the order they come, a chunk about every ``chunk_bytes``."""

    def __init__(self, out, definitions: Mapping[str, str] | None = None, chunk_bytes: int = 1_000_000, packing: str = "zstd"):
        if packing not in _KNOWN_CODECS:
            raise ValueError(f"chunks can't be packed as {packing}")
        self.out, self.definitions, self.chunk_bytes, self.packing = out, definitions or {}, chunk_bytes, packing
        self.at = 0
        self.schemas: dict[str, tuple[int, bytes]] = {}
        self.channels: dict[tuple[str, str], tuple[int, bytes]] = {}
        self.counts: dict[int, int] = {}
        self.entries: list[bytes] = []
        self.span: list[int] = []
        self._begin()
        self._put(MAGIC + _record(HEADER, _text("") + _text("spoor")))

    def _begin(self) -> None:
        self.chunk, self.index, self.low, self.high = bytearray(), {}, None, 0

    def _put(self, raw: bytes) -> int:
        at = self.at
        self.out.write(raw)
        self.at += len(raw)
        return at

    def add(self, topic: str, msgtype: str, time: int, raw: bytes) -> None:
        if msgtype not in self.schemas:
            number = len(self.schemas) + 1
            text = self.definitions.get(msgtype, "").encode()
            self.schemas[msgtype] = number, _record(SCHEMA, struct.pack("<H", number) + _text(msgtype) + _text("ros2msg" if text else "") + struct.pack("<I", len(text)) + text)
            self.chunk += self.schemas[msgtype][1]
        if (topic, msgtype) not in self.channels:
            number = len(self.channels) + 1
            self.channels[topic, msgtype] = number, _record(CHANNEL, struct.pack("<HH", number, self.schemas[msgtype][0]) + _text(topic) + _text("cdr") + struct.pack("<I", 0))
            self.chunk += self.channels[topic, msgtype][1]
        channel = self.channels[topic, msgtype][0]
        self.index.setdefault(channel, []).append((time, len(self.chunk)))
        self.chunk += _record(MESSAGE, struct.pack("<HIQQ", channel, self.counts.get(channel, 0) & 0xFFFFFFFF, time, time) + raw)
        self.counts[channel] = self.counts.get(channel, 0) + 1
        self.low, self.high = time if self.low is None else min(self.low, time), max(self.high, time)
        if len(self.chunk) >= self.chunk_bytes:
            self._end_chunk()

    def _end_chunk(self) -> None:
        if not self.index:
            return
        raw = bytes(self.chunk)
        data = pa.compress(raw, codec=self.packing, asbytes=True) if self.packing else raw
        head = struct.pack("<QQQI", self.low, self.high, len(raw), zlib.crc32(raw)) + _text(self.packing) + struct.pack("<Q", len(data))
        start = self._put(_record(CHUNK, head + data))
        size = self.at - start
        places = b"".join(struct.pack("<HQ", k, self._put(_record(MESSAGE_INDEX, struct.pack("<HI", k, 16 * len(v)) + b"".join(struct.pack("<QQ", *e) for e in v)))) for k, v in sorted(self.index.items()))
        length = self.at - start - size
        self.entries.append(_record(CHUNK_INDEX, struct.pack("<QQQQI", self.low, self.high, start, size, len(places)) + places + struct.pack("<Q", length) + _text(self.packing) + struct.pack("<QQ", len(data), len(raw))))
        self.span += [self.low, self.high]
        self._begin()

    def close(self) -> None:
        self._end_chunk()
        self._put(_record(DATA_END, struct.pack("<I", 0)))
        start = self.at
        counts = b"".join(struct.pack("<HQ", k, n) for k, n in sorted(self.counts.items()))
        told = struct.pack("<QHIIIIQQI", sum(self.counts.values()), len(self.schemas), len(self.channels), 0, 0, len(self.entries), min(self.span, default=0), max(self.span, default=0), len(counts)) + counts
        summary = b"".join([*(s[1] for s in self.schemas.values()), *(c[1] for c in self.channels.values()), *self.entries, _record(STATISTICS, told)])
        tail = struct.pack("<BQQQ", FOOTER, 20, start, 0)
        self._put(summary + tail + struct.pack("<I", zlib.crc32(summary + tail)) + MAGIC)

