"""State of frames on a stream: a buffer of transforms that answers queries in time, and the last value of each key."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What transformWithState needs of the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

VALUES = ("x", "y", "z")
_POINT = "t double, row_idx long, x double, y double, z double"
_ASK = "t double, query string"


class _Buffer(StatefulProcessor):
    """One frame pair: points by time, and the queries that wait for a later one.

    A query is answered when the watermark has passed a point at or after its time: no earlier one can come then. One that no
    point follows for ``keep`` seconds of event time takes the last point's values. Points go that no waiting or later query
    can need: all before the last one at or before the watermark less ``keep`` and the waiting queries.
    """

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", _POINT)
        self.asks = handle.getListState("asks", _ASK)

    def _settle(self, key, points: list[tuple], asks: list[tuple], seen: float) -> Iterator[Row]:
        points.sort(key=lambda p: p[:2])
        times = [p[0] for p in points]
        wait = []
        for t, query in sorted(asks):
            at = bisect.bisect_left(times, t)
            after = points[at] if at < len(points) else None
            if after is not None and after[0] <= seen:
                before = points[at - 1] if at else None
                if before is None:
                    values = after[2:]
                else:
                    part = (t - before[0]) / (after[0] - before[0])
                    values = tuple(b + part * (a - b) for b, a in zip(before[2:], after[2:], strict=True))
            elif after is None and seen > t + self.keep and points:
                values = points[-1][2:]
            elif seen > t + self.keep and not points:
                continue  # nothing ever came
            else:
                wait.append((t, query))
                continue
            yield Row(pair=key[0], t=t, query=query, x=values[0], y=values[1], z=values[2])
        low = min([seen - self.keep, *(t for t, _ in wait)])
        first = max(0, bisect.bisect_left(times, low) - 1)
        self._put(self.points, [Row(t=p[0], row_idx=p[1], x=p[2], y=p[3], z=p[4]) for p in points[first:]])
        self._put(self.asks, [Row(t=t, query=q) for t, q in wait])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if wait:
            self.handle.registerTimer(int(1000 * (max(min(wait)[0], seen) + 0.001)) + 1)

    @staticmethod
    def _put(state, rows: list[Row]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _held(self) -> tuple[list[tuple], list[tuple]]:
        return [tuple(p) for p in self.points.get()], [tuple(a) for a in self.asks.get()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        points, asks = self._held()
        for r in rows:
            if r.query is None:
                points.append((r.t, r.row_idx, r.x, r.y, r.z))
            else:
                asks.append((r.t, r.query))
        yield from self._settle(key, points, asks, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key, *self._held(), timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def looked_up(queries: DataFrame, transforms: DataFrame, late: str = "10 seconds", keep: float = 60.0) -> DataFrame:
    """``pair, t, query, x, y, z``: each query's place at its time, linear between the transforms around it.

    ``queries`` are ``pair, time timestamp, query string``; ``transforms`` are ``pair, time, row_idx, x, y, z``; both streams. Times
    count in microseconds. Equal to ``timejoin.interpolated`` on tables, as long as nothing is later than ``late`` and no gap between
    transforms is longer than ``keep`` seconds; state per pair is bounded by the transforms of ``keep`` and the waiting queries.
    """
    seconds = (F.unix_micros("time") / F.lit(1e6)).alias("t")
    none = [F.lit(None).cast("double").alias(v) for v in VALUES]
    asks = queries.select("pair", "time", seconds, F.lit(None).cast("long").alias("row_idx"), *none, "query")
    both = transforms.select("pair", "time", seconds, F.col("row_idx").cast("long"), *VALUES, F.lit(None).cast("string").alias("query")).unionByName(asks).where("pair IS NOT NULL AND time IS NOT NULL")
    return both.withWatermark("time", late).groupBy("pair").transformWithState(_Buffer(keep), "pair string, t double, query string, x double, y double, z double", "append", "EventTime")


class _Latch(StatefulProcessor):
    """The last value of a key, which is let go some time after it came; rows take what holds when they come."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double, value string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.last.get()) if self.last.exists() else None
        for r in sorted(rows, key=lambda r: (r.t, r.latch is None)):
            if r.latch is not None:
                if held is None or r.t >= held[0]:
                    held = (r.t, r.latch)
            else:
                yield Row(key=key[0], t=r.t, row=r.row, value=held[1] if held else None)
        if held:
            self.last.update(held)

    def close(self) -> None:
        pass


def latched(rows: DataFrame, values: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """``key, t, row, value``: each row of a stream with the last value that its key had by then, null before the first.

    ``rows`` are ``key, t double, row string``, ``values`` are ``key, t double, value string``; of one trigger they are taken by time,
    values first. A value is let go ``keep_ms`` milliseconds (of processing time) after it was last seen; without it, it holds
    for ever. With it Spark plans batches on and on to look for values to let go, unless ``noDataMicroBatches`` is off.
    """
    given = values.select("key", "t", F.lit(None).cast("string").alias("row"), F.col("value").alias("latch"))
    both = rows.select("key", "t", "row", F.lit(None).cast("string").alias("latch")).unionByName(given).where("key IS NOT NULL")
    return both.groupBy("key").transformWithState(_Latch(keep_ms), "key string, t double, row string, value string", "append", "ProcessingTime" if keep_ms else "None")
