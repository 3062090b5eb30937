"""Recorded message logs (SQLite bags) as Spark data sources: ``bag``, one partition a slice of message ids, and ``bag_topics``.

The topic filter is applied in SQLite, before any message is decoded. ``bag`` is a streaming source too: its offsets are
message ids by file, so a query that stops and starts again loses and repeats nothing. Files lie on paths that the
workers can open, as SQLite needs them; ``chunked_logs`` reads logs from any store.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

from .chunked_logs import TOPICS
from .messages import decoded

__all__ = ["MESSAGES", "BagSource", "BagTopicsSource", "decoded", "read_topics", "register"]

MESSAGES = "topic string, msgtype string, conn_id int, log_ts_ns long, seq long, raw binary"
ARROW = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
#: Messages of a partition, and of a batch.
SLICE, BATCH = 100_000, 1000


class _Slice(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def _open(path: str):
    import sqlite3

    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _bags(path: str) -> list[str]:
    from pathlib import Path

    root = Path(path.removeprefix("file://"))
    if not root.exists():
        raise FileNotFoundError(root)
    return sorted(map(str, [root] if root.is_file() else root.glob("*.db3")))


def _slices(path: str, low: int, high: int) -> list[_Slice]:
    """Ids from low to before high."""
    return [_Slice(path, k, min(high, k + SLICE)) for k in range(low, high, SLICE)]


def _read(partition: _Slice, topic: str | None) -> Iterator[pa.RecordBatch]:
    with _open(partition.path) as db:
        ask = "SELECT t.name, t.type, t.id, m.timestamp, m.id, m.data FROM messages m JOIN topics t ON t.id = m.topic_id WHERE m.id >= ? AND m.id < ?"
        given: list = [partition.low, partition.high]
        if topic:
            ask, given = ask + " AND t.name = ?", [*given, topic]
        found = db.execute(ask + " ORDER BY m.timestamp, m.id", given)
        while rows := found.fetchmany(BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), ARROW, strict=True)], names=[c.split()[0] for c in MESSAGES.split(", ")])


class BagReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.topic = _bags(options["path"]), options.get("topic")

    def partitions(self):
        out = []
        for f in self.files:
            with _open(f) as db:
                low, high = db.execute("SELECT min(id), max(id) FROM messages").fetchone()
            out += _slices(f, low, high + 1) if low is not None else []
        return out

    def pushFilters(self, filters):
        """``topic = '...'`` is applied in SQLite; the rest stays Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("topic",) and self.topic in (None, f.value):
                self.topic = f.value
            else:
                yield f

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.topic)


class BagStreamReader(DataSourceStreamReader):
    """Offsets are the last id taken of each file. Recorders append ids in order; files may be added.

    With ``max_messages`` (a trigger's messages, over all files) the ends of planned batches are also kept in the file that
    ``progress`` names, since after a start Spark tells the place only when a batch is planned.
    """

    def __init__(self, options):
        self.path, self.topic, self.most = options["path"], options.get("topic"), int(options.get("max_messages", "0"))
        self.progress = options.get("progress", "").removeprefix("file://")
        if self.most and not self.progress:
            raise ValueError("max_messages needs a file to keep its progress in")
        self.at: dict[str, int] | None = None
        if self.progress and os.path.exists(self.progress):
            with open(self.progress) as f:
                self.at = json.load(f)

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def latestOffset(self) -> dict:
        out, left = dict(self.at or {}), self.most
        for f in _bags(self.path):
            last = out.get(f, -1)
            with _open(f) as db:
                if self.most:
                    ids = [r[0] for r in db.execute("SELECT id FROM messages WHERE id > ? ORDER BY id LIMIT ?", (last, left))]
                    left -= len(ids)
                    end = ids[-1] if ids else last
                else:
                    end = db.execute("SELECT coalesce(max(id), -1) FROM messages").fetchone()[0]
            if end >= 0:
                out[f] = max(end, last)
        return out

    def partitions(self, start: dict, end: dict):
        self.at = dict(end)
        if self.progress:
            with open(f"{self.progress}.tmp", "w") as f:
                json.dump(self.at, f)
            os.replace(f"{self.progress}.tmp", self.progress)
        return [s for f, high in sorted(end.items()) for s in _slices(f, start.get(f, -1) + 1, high + 1)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.topic)


class BagTopicsReader(DataSourceReader):
    def __init__(self, options):
        self.files = _bags(options["path"])

    def partitions(self):
        return [_Slice(f, 0, 0) for f in self.files]

    def read(self, partition):
        with _open(partition.path) as db:
            has = db.execute("SELECT count(*) FROM sqlite_master WHERE name = 'message_definitions'").fetchone()[0]
            told = dict((r[0], r[1:]) for r in db.execute("SELECT topic_type, encoding, encoded_message_definition FROM message_definitions")) if has else {}
            for number, topic, kind in db.execute("SELECT id, name, type FROM topics ORDER BY id").fetchall():
                yield (partition.path, number, topic, kind, *told.get(kind, ("", "")))


class BagTopicsSource(DataSource):
    """``spark.read.format("bag_topics").load(path)``: every connection, with or without messages, and its type's definition."""

    @classmethod
    def name(cls) -> str:
        return "bag_topics"

    def schema(self) -> str:
        return TOPICS

    def reader(self, schema) -> DataSourceReader:
        return BagTopicsReader(self.options)


class BagSource(DataSource):
    """``spark.read.format("bag").option("topic", "/tf").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> DataSourceReader:
        return BagReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BagStreamReader(self.options)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """``chunked_logs.TOPICS`` of all bags in a folder."""
    return spark.read.format("bag_topics").load(path)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets their readers take filters."""
    from .clouds import PointCloudSource
    from .recorder import MessageLog

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BagSource, BagTopicsSource, PointCloudSource, MessageLog):
        spark.dataSource.register(source)
