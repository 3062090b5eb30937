"""Steps whose work a task or a worker must not repeat or hold as logs grow."""

from bisect import bisect_left

from pyspark.sql import functions as F

from spoor.operators import timejoin
from spoor.plans import catalogue
from spoor.sources import chunked_logs, messages


def test_asof_windows_run_once_over_their_rows(spark, capsys):
    track = [(float(i // 3 * 7 % 5000), i, float(i)) for i in range(600)]
    asks = [(k, k * 11.5 - 100.0) for k in range(500)]
    got = timejoin.asof_neighbours(spark.createDataFrame(asks, "k long, ts double"), spark.createDataFrame(track, "t double, row_idx long, x double"), ["x"], bucket=250.0)
    got.explain("formatted")
    frames = capsys.readouterr().out.lower()
    # a frame that ends at the last row is worked out anew at each row: quadratic in a bucket, and in the buckets
    assert "unboundedpreceding" in frames and "unboundedfollowing" not in frames
    track.sort()
    times = [t for t, _, _ in track]
    want = {}
    for k, ts in asks:
        i = bisect_left(times, ts)
        want[k] = (track[i - 1][2] if i else None, track[i][2] if i < len(track) else None)
    assert {r.k: (r.before and r.before.x, r.after and r.after.x) for r in got.collect()} == want


def test_a_log_is_read_by_pieces(spark, tmp_path):
    (tmp_path / "a log%20").mkdir()
    path = tmp_path / "a log%20" / "a.mcap"
    with open(path, "wb") as f:
        log = chunked_logs.LogWriter(f, chunk_bytes=200_000, packing="")
        for k in range(3000):
            log.add("/even" if k % 2 == 0 else "/odd", "demo/msg/Block", k, bytes([k % 251]) * 1000)
        log.close()
    content, file = path.read_bytes(), chunked_logs.Ranged(str(path))
    read, file.file = [], (inner := file.file) and type("Counted", (), {"read_at": staticmethod(lambda n, at: read.append(n) or inner.read_at(n, at))})
    index, whole = chunked_logs.read_index(file), chunked_logs.read_index(content)
    assert [(c.first, c.at, c.topics) for c in index.chunks] == [(c.first, c.at, c.topics) for c in whole.chunks] and len(whole.chunks) > 10
    assert sum(read) < len(content) / 2 and max(read) <= chunked_logs.BLOCK
    assert all(bytes(a.data) == bytes(b.data) for a, b in zip(index.chunks, whole.chunks, strict=True)) and max(read) < 300_000
    (tmp_path / "a log%20" / "b.mcap").write_bytes(content[: len(content) // 2])  # without a summary
    # the content isn't asked for where workers can open the file, and comes with the row where they can't
    folder, kept = f"file://{tmp_path}/a log%20", ("topic", "log_ts_ns", "seq", "raw")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pieces.link./in", f"file://{tmp_path}")
    store = "viewfs://pieces/in/a log%20"
    rows = {p: sorted(map(str, chunked_logs.read_log(spark, p, start=100, topics=["/odd"]).select(*kept).collect())) for p in (folder, store)}
    assert len(rows[folder]) > 2000 and rows[folder] == rows[store]
    assert [chunked_logs._files(spark, p, "*.mcap").where("content IS NOT NULL").count() for p in (folder, store)] == [0, 2]


def test_numbers_side_by_side_are_coded_as_one_by_one(spark, tmp_path, monkeypatch):
    definition = "\n".join(["uint8 lead", "Pair pair", "Mixed mixed", "Pair[] pairs", "=" * 80, "MSG: demo/Pair", "float64 a", "int64 b", "=" * 80, "MSG: demo/Mixed", "int32 s", "uint32 n"])
    value = {"lead": 3, "pair": {"a": 1.5, "b": -7}, "mixed": {"s": -1, "n": 2**32 - 1}, "pairs": [{"a": float(k), "b": k} for k in range(3)]}
    raw = messages.encoder("demo/msg/Row", definition)(value)
    assert messages.decoder("demo/msg/Row", definition)(raw) == value
    monkeypatch.setattr(messages, "_run", lambda fields: None)
    assert messages.encoder("demo/msg/Row", definition)(value) == raw and messages.decoder("demo/msg/Row", definition)(raw) == value


def test_a_recorded_log_has_files_for_every_core(spark):
    path = catalogue._recorded(spark, "/root/testdata/sf0.001")
    log = chunked_logs.read_log(spark, path)
    spans = sorted((r.a, r.b) for r in log.groupBy("path").agg(F.min("log_ts_ns").alias("a"), F.max("log_ts_ns").alias("b")).collect())
    assert len(spans) >= 2 * spark.sparkContext.defaultParallelism
    assert all(before[1] < after[0] for before, after in zip(spans, spans[1:], strict=False))  # a window opens few of them
