"""Message logs written by Spark: ``message_log``, one chunked file a task, also as the sink of a stream.

Paths may be of any file system that pyarrow opens. A batch's files appear when all its tasks have ended. A stream's epoch is
named in its files and in a mark that is written last, so an epoch that is repeated after a crash leaves each message once:
what it wrote before without a mark is replaced, and with a mark it is passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from .chunked_logs import LogWriter

MARKS, STAGED = "_epochs", "_staged"


def opened(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    task: int
    staged: str | None


class _Files:
    """Writing, committing and withdrawing of one write's files. ``options``: path, definitions (JSON), packing, chunk_bytes."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.definitions = json.loads(options.get("definitions", "{}"))
        self.packing, self.chunk_bytes = options.get("packing", "zstd"), int(options.get("chunk_bytes", "1000000"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        store, root = opened(self.path)
        task, staged, out, log = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("topic", "msgtype", "log_ts_ns", "raw")]
            for topic, kind, time, raw in zip(*columns, strict=True):
                if log is None:
                    store.create_dir(f"{root}/{STAGED}", recursive=True)
                    staged = f"{STAGED}/{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{root}/{staged}", compression=None)
                    log = LogWriter(out, self.definitions, self.chunk_bytes, self.packing)
                log.add(topic, kind, time, raw)
        if log is not None:
            log.close()
            out.close()
        return _Written(task, staged)

    def place(self, messages: list[_Written | None], name: str) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None and m.staged:
                store.move(f"{root}/{m.staged}", f"{root}/{name}-{m.task:05d}.mcap")

    def withdraw(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, root = opened(self.path)
        for m in messages:
            if m is not None and m.staged and store.get_file_info(f"{root}/{m.staged}").type == fs.FileType.File:
                store.delete_file(f"{root}/{m.staged}")


class LogBatchWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.files = _Files(options)

    def write(self, iterator):
        return self.files.write(iterator)

    def commit(self, messages):
        self.files.place(messages, f"part-{uuid.uuid4().hex[:12]}")

    def abort(self, messages):
        self.files.withdraw(messages)


class LogStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options):
        self.files = _Files(options)

    def write(self, iterator):
        return self.files.write(iterator)

    def commit(self, messages, batchId):
        from pyarrow import fs

        store, root = opened(self.files.path)
        mark = f"{root}/{MARKS}/{batchId:010d}"
        if store.get_file_info(mark).type == fs.FileType.File:
            self.files.withdraw(messages)
            return
        store.create_dir(f"{root}/{MARKS}", recursive=True)
        name = f"epoch-{batchId:010d}"
        for found in store.get_file_info(fs.FileSelector(root)):
            if found.base_name.startswith(f"{name}-"):
                store.delete_file(found.path)
        self.files.place(messages, name)
        with store.open_output_stream(mark, compression=None) as out:
            out.write(b"")

    def abort(self, messages, batchId):
        self.files.withdraw(messages)


class MessageLog(DataSource):
    """``df.write.format("message_log").option("definitions", json).mode("append").save(path)`` of ``topic, msgtype, log_ts_ns, raw``."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return "topic string, msgtype string, log_ts_ns long, raw binary"

    def writer(self, schema, overwrite: bool) -> LogBatchWriter:
        if overwrite:
            raise ValueError("message_log only appends")
        return LogBatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(self.options)
