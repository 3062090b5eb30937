"""Streams held against their batch forms."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from spoor.operators import timejoin
from spoor.streaming import buffer, sync

UTC = datetime.UTC


def at(seconds):
    return datetime.datetime.fromtimestamp(1_700_000_000 + seconds, UTC)


def feed(spark, folder, schema, batches):
    """A stream of files, one a trigger, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
        time_of = 1_600_000_000 + i * 10
        for f in __import__("glob").glob(f"{folder}/b{i}/*.parquet"):
            __import__("os").utime(f, (time_of, time_of))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(df, spark, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state-{name}").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    progress = q.recentProgress
    return spark.table(name), progress


@pytest.fixture
def rocks(spark):
    spark.conf.set(*buffer.STATE_STORE)
    yield
    spark.conf.unset(buffer.STATE_STORE[0])


def test_synchronised_streams_equal_the_batch_join(spark, tmp_path):
    r = random.Random(2)
    a = [("u" if i % 2 else "v", at(i + r.random() * 0.3), f"a{i}") for i in range(60)]
    b = [("u" if i % 2 else "v", at(i + r.random() * 0.5), f"b{i}") for i in range(60)]
    schema = "track string, t timestamp, name string"
    end = [("u", at(500), "end")]
    late = [("u", at(3.0), "late")]  # long after the watermark has passed it
    parts = lambda rows: [rows[:20], rows[20:40], rows[40:], end, [*late, ("u", at(501), "end2")], [("u", at(900), "end3")]]
    left, right = feed(spark, f"{tmp_path}/a", schema, parts(a)), feed(spark, f"{tmp_path}/b", schema, parts(b))
    got, progress = run(sync.matched(left, right, 0.25, "5 seconds", by=["track"]), spark, tmp_path, "sync")
    shape = lambda df: sorted((x.left.name, x.right.name, round(x.apart, 6)) for x in df.collect() if "end" not in x.left.name)
    batch = sync.matched(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.25, by=["track"])
    assert shape(got) == shape(batch) and 10 < len(shape(got)) < 60
    want = []
    for track, t, name in a:
        near = min(((abs((u - t).total_seconds()), u, m) for k, u, m in b if k == track), default=None)
        if near and near[0] <= 0.25:
            want.append((name, near[2], round(near[0], 6)))
    assert shape(batch) == sorted(want)
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) >= 2


def test_buffer_equals_the_batch_interpolation(spark, tmp_path, rocks):
    r = random.Random(3)
    track = [("p", at(i * 2.0 + r.random()), i, float(i), float(i % 7), r.random()) for i in range(80)]
    asks = [("p", at(r.random() * 165 - 2), f"q{i}") for i in range(90)] + [("p", track[5][1], "exact")]
    order = sorted(track, key=lambda p: p[1])
    chunks = [order[i : i + 20] for i in range(0, 80, 20)]
    for c in chunks:
        r.shuffle(c)  # out of order within the lateness
    asked = [[q for q in asks if (k == 0 or q[1] > at(k * 42)) and (k == 3 or q[1] <= at((k + 1) * 42))] for k in range(4)]
    pose, query = "pair string, time timestamp, row_idx long, x double, y double, z double", "pair string, time timestamp, query string"
    far = [[("other", at(1000 + 200 * k), 0, 0.0, 0.0, 0.0)] for k in range(3)]
    poses = feed(spark, f"{tmp_path}/poses", pose, [*chunks, *far])
    queries = feed(spark, f"{tmp_path}/queries", query, [*asked, *[[("other", at(1000 + 200 * k), f"far{k}")] for k in range(3)]])
    got, progress = run(buffer.looked_up(queries, poses, "50 seconds", keep=60.0), spark, tmp_path, "buffer")
    secs = (F.unix_micros("time") / F.lit(1e6))
    batch = timejoin.interpolated(spark.createDataFrame(asks, query).select("query", secs.alias("ts")), spark.createDataFrame(track, pose).select(secs.alias("t"), "row_idx", "x", "y", "z"))
    want = {x.query: (x.x, x.y, x.z) for x in batch.collect()}
    found = {x.query: (x.x, x.y, x.z) for x in got.where("pair = 'p'").collect()}
    assert set(found) == set(want) and all(abs(u - v) < 1e-6 for k in want for u, v in zip(found[k], want[k], strict=True))
    assert got.where("pair = 'p'").count() == len(want)


def test_latched_values(spark, tmp_path, rocks):
    rows = feed(spark, f"{tmp_path}/rows", "key string, t double, row string", [[("k", 1.0, "a"), ("k", 3.0, "b"), ("other", 3.0, "c")], [("k", 4.0, "d")], [(None, 5.0, "e"), ("k", 9.0, "f")]])
    values = feed(spark, f"{tmp_path}/values", "key string, t double, value string", [[("k", 2.0, "one")], [("k", 4.0, "two")], [("k", 3.5, "old")]])
    got, _ = run(buffer.latched(rows, values), spark, tmp_path, "latched")
    assert {x.row: x.value for x in got.collect()} == {"a": None, "b": "one", "c": None, "d": "two", "f": "two"}


def test_latched_values_are_let_go(spark, tmp_path, rocks):
    import time

    schema = "key string, t double, row string"
    rows = feed(spark, f"{tmp_path}/rows", schema, [[("k", 2.0, "a")]])
    values = feed(spark, f"{tmp_path}/values", "key string, t double, value string", [[("k", 1.0, "one")]])
    df = buffer.latched(rows, values, keep_ms=1500)
    # state of processing time calls for batches without end unless batches need rows
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def go():
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(60)

    go()
    time.sleep(2)
    spark.createDataFrame([("k", 3.0, "b")], schema).coalesce(1).write.parquet(f"{tmp_path}/rows/later")
    go()
    assert {x.row: x.value for x in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a": "one", "b": None}
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
