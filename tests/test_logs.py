"""Messages of any type, chunked logs and their SQLite twin, streams of messages."""

import base64
import json
import random
import sqlite3
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spoor.plans import trajectory
from spoor.sources import bags, chunked_logs, messages

# Five definitions that nest, with constants, bounds, comments and every kind of array.
READING = """# a reading
uint8 GOOD=1
std_msgs/Header header
Inner[] inner     # nested
Inner one
uint8[] blob
bool ok
float64[3] fixed
string<=20[] names
int16[<=4] few
Grid/Point far
string note "none"
================================================================================
MSG: demo/Inner
int8 a
uint64 big
Deep deep
================================================================================
MSG: demo/Deep
float32[] values
Nothing nothing
char c
================================================================================
MSG: demo/Nothing
================================================================================
MSG: Grid/Point
float64 x
int32 k
"""


def value(k):
    inner = lambda i: {"a": -i, "big": 2**63 + i, "deep": {"values": [0.5 * i] * (i % 3), "nothing": {}, "c": 65 + i % 20}}
    head = {"stamp": {"sec": k, "nanosec": 5}, "frame_id": "é" * (k % 4)}
    return {"header": head, "inner": [inner(i) for i in range(k % 4)], "one": inner(7), "blob": base64.b64encode(bytes(range(k % 11))).decode(), "ok": k % 2 == 0, "fixed": [1.5, -0.0, k / 4], "names": ["x" * i for i in range(k % 3)], "few": list(range(k % 5))[:4], "far": {"x": 1e300, "k": -k}, "note": "n" * (k % 7)}


def plain_cdr(v, order="<"):
    """The serialised form written out by hand."""
    out = bytearray()

    def put(kind, *xs):
        for x in xs:
            out.extend(bytes(-len(out) % struct.calcsize(order + kind)) + struct.pack(order + kind, x))

    def text(t):
        raw = t.encode() + b"\0"
        put("I", len(raw))
        out.extend(raw)

    def inner(i):
        put("b", i["a"])
        put("Q", i["big"])
        put("I", len(i["deep"]["values"]))
        put("f", *i["deep"]["values"])
        put("B", 0, i["deep"]["c"])

    put("i", v["header"]["stamp"]["sec"])
    put("I", v["header"]["stamp"]["nanosec"])
    text(v["header"]["frame_id"])
    put("I", len(v["inner"]))
    for i in v["inner"]:
        inner(i)
    inner(v["one"])
    blob = base64.b64decode(v["blob"])
    put("I", len(blob))
    out.extend(blob)
    put("?", v["ok"])
    put("d", *v["fixed"])
    put("I", len(v["names"]))
    for t in v["names"]:
        text(t)
    put("I", len(v["few"]))
    put("h", *v["few"])
    put("d", v["far"]["x"])
    put("i", v["far"]["k"])
    text(v["note"])
    return (b"\0\1\0\0" if order == "<" else b"\0\0\0\0") + bytes(out)


def test_five_nested_definitions_equal_plain_bytes():
    read, write = messages.decoder("demo/msg/Reading", READING), messages.encoder("demo/msg/Reading", READING)
    for k in range(60):
        v = value(k)
        assert write(v) == plain_cdr(v)
        assert read(plain_cdr(v)) == v and read(plain_cdr(v, ">")) == v


def test_cut_and_odd_messages():
    read = messages.decoder("demo/msg/Reading", READING)
    whole = plain_cdr(value(7))
    for n in range(len(whole)):
        with pytest.raises((ValueError, struct.error, UnicodeDecodeError)):
            read(whole[:n])
    with pytest.raises(ValueError, match="ends within"):
        messages.decoder("std_msgs/msg/String")(b"\0\1\0\0" + struct.pack("<I", 2**31) + b"a")
    with pytest.raises(ValueError, match="no definition"):
        messages.decoder("demo/msg/Reading", "Missing m")
    with pytest.raises(ValueError, match="holds itself"):
        messages.decoder("demo/msg/Reading", "Reading r")
    with pytest.raises(ValueError, match="no field"):
        messages.parse("int32", "demo/Bad")
    for name in messages.standard_types():
        messages.decoder(name)


def recorded(tmp_path, per_chunk=40, packing="zstd"):
    """The same messages as a chunked file and as a SQLite bag."""
    r = random.Random(1)
    definitions = {"demo/msg/Reading": READING}
    write, tf = messages.encoder("demo/msg/Reading", READING), messages.encoder("tf2_msgs/msg/TFMessage")
    rows = []
    for k in range(120):
        if k % 3:
            rows.append(("/reading" if k % 2 else "/other", "demo/msg/Reading", 1000 + k * 10 + r.randrange(3), write(value(k))))
        else:
            t = {"header": {"stamp": {"sec": k, "nanosec": 0}, "frame_id": "/root"}, "child_frame_id": "base_link", "transform": {"translation": {"x": float(k // 6), "y": 0.0, "z": 0.0}, "rotation": {"x": 0.0, "y": 0.0, "z": 0.0, "w": 1.0}}}
            rows.append(("/tf", "tf2_msgs/msg/TFMessage", 1000 + k * 10, tf({"transforms": [t]})))
    rows.append(("/broken", "demo/msg/Unknown", 2300, b"\0\1\0\0"))
    (tmp_path / "logs").mkdir()
    with open(tmp_path / "logs" / "a.mcap", "wb") as f:
        log = chunked_logs.LogWriter(f, definitions, 10**9, packing)
        for i, row in enumerate(rows):
            log.add(*row)
            if i % per_chunk == per_chunk - 1 and i < 119:
                log._end_chunk()
        log.close()
    (tmp_path / "bags").mkdir()
    db = sqlite3.connect(tmp_path / "bags" / "a.db3")
    db.execute("CREATE TABLE topics (id INTEGER, name TEXT, type TEXT)")
    db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    db.execute("CREATE TABLE message_definitions (id INTEGER, topic_type TEXT, encoding TEXT, encoded_message_definition TEXT)")
    db.execute("INSERT INTO message_definitions VALUES (1, 'demo/msg/Reading', 'ros2msg', ?)", (READING,))
    topics = sorted({(t, k) for t, k, _, _ in rows}) + [("/silent", "std_msgs/msg/String")]
    db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(i, *t) for i, t in enumerate(topics)])
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(i + 1, topics.index((t, k)), n, raw) for i, (t, k, n, raw) in enumerate(rows)])
    db.commit()
    db.close()
    return rows


PLAIN = ("topic", "msgtype", "log_ts_ns", "seq", "raw")


def plain(df):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*PLAIN).collect())


@pytest.mark.parametrize("packing", ["zstd", "lz4", ""])
def test_chunked_log_equals_its_sqlite_twin(spark, tmp_path, packing):
    rows = recorded(tmp_path, packing=packing)
    bags.register(spark)
    log = chunked_logs.read_log(spark, f"{tmp_path}/logs")
    assert plain(log) == plain(spark.read.format("bag").load(f"{tmp_path}/bags")) == sorted((*r[:3], i + 1, r[3]) for i, r in enumerate(rows))
    assert plain(chunked_logs.read_log(spark, f"{tmp_path}/logs", spread=3)) == plain(log)
    there = {tuple(r) for r in chunked_logs.read_topics(spark, f"{tmp_path}/logs").select("topic", "msgtype", "definition").collect()}
    twin = {tuple(r) for r in bags.read_topics(spark, f"{tmp_path}/bags").select("topic", "msgtype", "definition").collect()}
    assert there == {t for t in twin if t[0] != "/silent"} and chunked_logs.definitions_of(bags.read_topics(spark, f"{tmp_path}/bags")) == {"demo/msg/Reading": READING}
    # an unfinished file has no summary: its records are walked through
    content = (tmp_path / "logs" / "a.mcap").read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.mcap").write_bytes(content[: content.rindex(b"\x0f\x04\0\0\0\0\0\0\0") + 3])
    assert plain(chunked_logs.read_log(spark, f"{tmp_path}/cut")) == plain(log)
    assert plain(chunked_logs.read_log(spark, f"{tmp_path}/cut", topics=["/tf"], start=1500)) == plain(log.where("topic = '/tf' AND log_ts_ns >= 1500"))


def test_a_filter_by_time_opens_one_chunk(spark, tmp_path):
    recorded(tmp_path)
    path = tmp_path / "logs" / "a.mcap"
    content = bytearray(path.read_bytes())
    index = chunked_logs.read_index(bytes(content))
    assert len(index.chunks) == 3
    middle = (index.chunks[1].low, index.chunks[1].high + 1)
    want = plain(chunked_logs.read_log(spark, f"{tmp_path}/logs", *middle))
    assert len(want) == 40 and chunked_logs.read_chunks(spark, f"{tmp_path}/logs", *middle).count() == 1
    assert chunked_logs.read_chunks(spark, f"{tmp_path}/logs", topics=["/broken"]).count() == 1
    # the others' content is spoilt: a chunk that is opened tells
    for c in (index.chunks[0], index.chunks[2]):
        at = content.index(bytes(c.data))
        content[at + len(c.data) // 2] ^= 255
    path.write_bytes(content)
    assert plain(chunked_logs.read_log(spark, f"{tmp_path}/logs", *middle)) == want
    with pytest.raises(Exception, match="checksum|decompress|Corrupt|corrupt"):
        chunked_logs.read_log(spark, f"{tmp_path}/logs").count()


def test_checksums_and_foreign_files(tmp_path):
    raw = b"abc" * 50
    with pytest.raises(ValueError, match="checksum"):
        chunked_logs.unpacked("", raw, len(raw), zlib.crc32(raw) ^ 1)
    with pytest.raises(ValueError, match="can't be read"):
        chunked_logs.unpacked("snappy", raw, len(raw), 0)
    with pytest.raises(ValueError, match="not a chunked log"):
        chunked_logs.read_index(b"SQLite format 3")


def test_every_type_in_the_profile(spark, tmp_path):
    recorded(tmp_path)
    bags.register(spark)
    topics = bags.read_topics(spark, f"{tmp_path}/bags")
    log = messages.decoded(spark.read.format("bag").load(f"{tmp_path}/bags").withColumn("error", F.lit("clash")), chunked_logs.definitions_of(topics))
    told = {r["topic"]: r for r in trajectory.profile(log, topics, 10_000).collect()}
    assert sorted(told) == ["/broken", "/other", "/reading", "/silent", "/tf"]
    assert json.loads(told["/reading"]["example"]) == json.loads(json.dumps(value(1))) and json.loads(told["/other"]["example"]) == json.loads(json.dumps(value(2)))
    assert json.loads(told["/tf"]["example"])["transforms"][0]["child_frame_id"] == "base_link"
    assert told["/silent"]["example"] is None and told["/broken"]["example"].startswith("<undecoded demo/msg/Unknown")
    typed = log.where("topic = '/reading'").select(F.variant_get("value", "$.one.big", "decimal(20,0)").alias("b"), F.variant_get("value", "$.names", "array<string>").alias("n"))
    assert all(int(r.b) == 2**63 + 7 for r in typed.collect())
    path = trajectory.extract(log).orderBy("t").collect()
    assert [r["x"] for r in path] == [float(k) for k in range(20)]
    spark_nan = spark.createDataFrame([("std_msgs/msg/Float64", b"\0\1\0\0" + struct.pack("<d", float("nan"))), (None, None)], "msgtype string, raw binary")
    assert [(r.j, r.error is None) for r in messages.decoded(spark_nan).select(F.to_json("value").alias("j"), "error").collect()] == [('{"data":"NaN"}', True), (None, False)]


def test_written_by_spark_and_read_again(spark, tmp_path):
    recorded(tmp_path)
    bags.register(spark)
    rows = spark.read.format("bag").load(f"{tmp_path}/bags").select("topic", "msgtype", "log_ts_ns", "raw")
    rows.repartition(3).write.format("message_log").option("definitions", json.dumps({"demo/msg/Reading": READING})).option("chunk_bytes", "500").mode("append").save(f"{tmp_path}/out")
    again = chunked_logs.read_log(spark, f"{tmp_path}/out")
    three = lambda df: sorted((r.topic, r.log_ts_ns, bytes(r.raw)) for r in df.collect())
    assert three(again) == three(rows) and again.select("path").distinct().count() == 3
    assert chunked_logs.definitions_of(chunked_logs.read_topics(spark, f"{tmp_path}/out")) == {"demo/msg/Reading": READING}
    values = messages.encoded(spark.createDataFrame([("/a", "std_msgs/msg/String", '{"data": "é"}')], "topic string, msgtype string, json string"))
    assert bytes(values.first().raw) == b"\0\1\0\0\3\0\0\0" + "é".encode() + b"\0"


def test_a_bag_as_a_stream_loses_and_repeats_nothing(spark, tmp_path):
    recorded(tmp_path)
    bags.register(spark)
    path = f"{tmp_path}/bags"

    def run(more=()):
        for i, topic in more:
            with sqlite3.connect(f"{path}/a.db3") as db:
                db.execute("INSERT INTO messages VALUES (?, ?, ?, ?)", (i, topic, i, b"late"))
        stream = spark.readStream.format("bag").option("max_messages", "50").option("progress", f"{tmp_path}/progress").load(path)
        q = stream.select("topic", "seq").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/seen").start()
        q.processAllAvailable()
        sizes = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        q.stop()
        return sizes

    assert max(run()) <= 50
    assert run([(200, 0), (201, 1)]) == [2]
    assert run() == []
    seen = sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/seen").collect())
    assert seen == [*range(1, 122), 200, 201]


def test_a_repeated_epoch_leaves_each_message_once(spark, tmp_path):
    import shutil

    recorded(tmp_path)
    bags.register(spark)
    schema = "topic string, msgtype string, log_ts_ns long, raw binary"
    rows = spark.read.format("bag").load(f"{tmp_path}/bags").select("topic", "msgtype", "log_ts_ns", "raw")
    rows.where("log_ts_ns < 1600").write.parquet(f"{tmp_path}/in/a")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        q = stream.writeStream.format("message_log").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        q.processAllAvailable()
        q.stop()

    run()
    shutil.copytree(f"{tmp_path}/state", f"{tmp_path}/before")
    rows.where("log_ts_ns >= 1600").write.parquet(f"{tmp_path}/in/b")
    run()
    # killed after its files were placed, before Spark noted the epoch: it runs again, with and without the mark
    for mark in (True, False):
        shutil.rmtree(f"{tmp_path}/state")
        shutil.copytree(f"{tmp_path}/before", f"{tmp_path}/state")
        if not mark:
            (tmp_path / "out" / "_epochs" / "0000000001").unlink()
        run()
        again = chunked_logs.read_log(spark, f"{tmp_path}/out")
        assert sorted((r.topic, r.log_ts_ns, bytes(r.raw)) for r in again.collect()) == sorted((r.topic, r.log_ts_ns, bytes(r.raw)) for r in rows.collect())
