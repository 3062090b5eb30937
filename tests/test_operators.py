"""Operators against small re-derivations, and the traps of their semantics."""

import bisect
import math
import random
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.functions import geometry as g
from spoor.functions.scalars import frame_name, is_finite, shortened
from spoor.operators import graph, ordered, spatial, timejoin, validation, voxel
from spoor.plans import align, cloud_merge, mesh, topology, trajectory
from spoor.sources import bags, clouds, text

NAN = float("nan")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_scalars(spark):
    df = spark.createDataFrame([("//tf", "1.5"), (None, "nan"), ("a/", "x"), ("/", "inf"), ("b", None)], "f string, v string")
    assert [r[0] for r in rows_of(df.select(frame_name(F.col("f"))))] == ["tf", "", "a/", "", "b"]
    assert [r[0] for r in rows_of(df.select(is_finite(F.col("v"))))] == [True, False, False, False, False]
    s = spark.createDataFrame([("abcdefgh",), ("abc",), (None,)], "s string")
    for n in (1, 3, 5, 8):
        cut = [t if t is None or len(t) <= n else t[: n - 3] + "..." for t in ("abcdefgh", "abc", None)]
        assert [r[0] for r in rows_of(s.select(shortened(F.col("s"), n)))] == cut
    with pytest.raises(ValueError):
        shortened(F.col("s"), 0)


def test_range_and_box_drop_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (NAN,), (3.0,)], "d double")
    keep = lambda low, high: [r[0] for r in rows_of(df.where(g.in_range(F.col("d"), low, high)))]
    assert keep(1.0, 2.0) == [1.0, 2.0] and keep(2.0, None) == [2.0, 3.0]
    assert len(keep(None, None)) == 4


def test_changes_keep_later_repeats_and_nan(spark):
    log = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, 1.0), (5, -0.0), (6, 0.0), (7, NAN), (8, NAN)], "seq long, x double")
    for bucket in (1e9, 3, 1):  # logs are cut into buckets, which changes nothing
        assert sorted(r[0] for r in rows_of(ordered.changes(log, ("x",), ("seq",), bucket=bucket))) == [1, 3, 4, 5, 7, 8]
    two = log.withColumn("k", F.lit("a")).unionByName(log.withColumn("k", F.lit(None).cast("string")))
    assert sorted(r[0] for r in rows_of(ordered.changes(two, ("x",), ("seq",), by=("k",), bucket=2))) == [1, 1, 3, 3, 4, 4, 5, 5, 7, 7, 8, 8]


def test_tolerance(spark):
    frames = spark.createDataFrame([("a", 1.0), ("b", 1.5), ("c", 9.0), ("d", None)], "f string, frame_ts double")
    times = spark.createDataFrame([(1.25,), (3.0,)], "t double")
    names = lambda tol: sorted(r[0] for r in rows_of(timejoin.within_tolerance(frames, times, tol)))
    assert names(0.25) == ["a", "b", "d"] and names(0.0) == ["d"] and names(-1.0) == ["d"] and names(100.0) == ["a", "b", "c", "d"]


def test_asof_equals_bisect(spark):
    r = random.Random(5)
    track = sorted((r.choice([round(r.uniform(0, 20000), 1), 777.0]), i, r.random()) for i in range(200))
    asks = [(i, r.choice([r.uniform(-500, 21000), track[r.randrange(200)][0]])) for i in range(300)]
    df = spark.createDataFrame([(t, i, x, 0.0, 0.0) for t, i, x in track], "t double, row_idx long, x double, y double, z double")
    got = dict(rows_of(timejoin.interpolated(spark.createDataFrame(asks, "k long, ts double"), df, bucket=900.0).select("k", "x")))
    ts = [t[0] for t in track]
    for k, at in asks:
        j = bisect.bisect_left(ts, at)
        if j == 0 or j == len(ts):
            want = track[min(j, len(ts) - 1)][2]
        else:
            (t0, _, a), (t1, _, b) = track[j - 1], track[j]
            want = a + (at - t0) / (t1 - t0) * (b - a)
        assert math.isclose(got[k], want, abs_tol=1e-12)


def test_guard_equals_a_sequential_pass(spark):
    r = random.Random(3)
    frames = [(i, f"f{i:03}", r.random() < 0.7, r.choice([0, 5, 9]), r.choice([0, 4]), r.choice([0.01, 1.0])) for i in range(80)]
    df = spark.createDataFrame(frames, "frame_idx long, path string, k boolean, n_points long, n_kept long, centroid_norm double")
    got = {x["frame_idx"]: x["disposition"] for x in ordered.disposition(df, F.col("k")).collect()}
    accepted = 0
    for i, _, k, n, kept, c in frames:
        want = "not_keyframe" if not k else "empty" if n == 0 else "centroid_guard" if i > 5 and c < 0.05 and accepted else "after_filters" if kept == 0 else "accepted"
        accepted += want == "accepted"
        assert got[i] == want


def cloud_of(spark, n, seed, name="id"):
    r = random.Random(seed)
    return spark.createDataFrame([(i, r.gauss(0, 1), r.gauss(0, 1), r.choice([0.0, r.gauss(0, 3)])) for i in range(n)], f"{name} long, x double, y double, z double")


def test_spatial_joins_equal_all_pairs(spark):
    p, o = cloud_of(spark, 80, 1), cloud_of(spark, 40, 2)
    a = np.array([r[1:] for r in rows_of(p)])
    b = np.array([r[1:] for r in rows_of(o)])
    d = np.linalg.norm(a[:, None] - a, axis=2)
    got = {(r[0], r[1]) for r in rows_of(spatial.pairs_within(p, 0.8))}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if d[i, j] <= 0.8}
    near = {r["id"]: r["clearance_radius"] for r in spatial.nearest_distance(p, o).collect()}
    assert all(math.isclose(near[i], np.linalg.norm(b - a[i], axis=1).min()) for i in range(80))
    assert all(r["clearance_radius"] is None for r in spatial.nearest_distance(p, o.limit(0)).collect())


def test_collision_equals_sampling(spark):
    p, o = cloud_of(spark, 60, 4), cloud_of(spark, 60, 5)
    nodes = spatial.nearest_distance(p, o)
    edges = topology.candidate_edges(nodes, 1.5)
    pts, obs = {r[0]: np.array(r[1:]) for r in rows_of(p)}, np.array([r[1:] for r in rows_of(o)])
    for margin in (0.0, 0.05):
        got = {(r["source"], r["target"]) for r in spatial.collision_free(edges, o, 0.1, margin).collect()}
        want = set()
        for e in edges.collect():
            n = max(2, math.ceil(e["weight"] / 0.1) + 1)
            s = pts[e["source"]] + np.linspace(0, 1, n)[:, None] * (pts[e["target"]] - pts[e["source"]])
            if (np.linalg.norm(s[:, None] - obs, axis=2) > margin).all():
                want.add((e["source"], e["target"]))
        assert got == want


def test_components_and_degrees(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 4), (4, 6), (6, 7), (9, 9), (0, 1)], "source long, target long")
    assert dict(rows_of(graph.components(nodes, edges))) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 4, 8: 8, 9: 9, 10: 10, 11: 11}
    assert dict(rows_of(graph.degrees(nodes, edges)))[0] == 2 and dict(rows_of(graph.degrees(nodes, edges)))[9] == 1


def test_findings(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, NAN, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, clearance_radius double")
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 9, 1.0), (0, 0, 2.0), (1, 0, -1.0), (1, 0, NAN)], "source long, target long, weight double")
    found = {r["rule"]: (r["severity"], r["n"]) for r in validation.findings(nodes, edges, max_p95_weight=0.5).collect()}
    assert found == {"node_not_finite": ("FAIL", 1), "ids_not_unique": ("FAIL", 1), "ids_not_contiguous": ("FAIL", 1), "unknown_endpoint": ("FAIL", 1), "weight_not_finite": ("FAIL", 1), "negative_weight": ("FAIL", 1), "self_loop": ("FAIL", 1), "isolated_nodes": ("FAIL", 1), "largest_component": ("FAIL", 1), "p95_weight": ("WARN", 1)}
    w = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "w double")
    assert rows_of(validation.ranked(w, "w", {"p": 0.95, "m": 0.5})) == [(3.0, 2.0)]
    assert rows_of(validation.interpolated(w, "w", 0.5)) == [(w.agg(F.percentile("w", 0.5)).first()[0],)]
    assert rows_of(validation.interpolated(w.where("w < 0"), "w", 0.75)) == [(None,)]


def test_quaternions_round_trip(spark):
    r = random.Random(9)
    qs = [(i, *(r.gauss(0, 1) for _ in range(4))) for i in range(60)] + [(60, 0.0, 0.0, 0.0, 0.0), (61, 1.0, 0.0, 0.0, 0.0), (62, 0.0, 0.0, -2.0, 0.0)]
    df = spark.createDataFrame(qs, "id long, qx double, qy double, qz double, qw double")
    rot = align.rotations(df)
    back = {x[0]: x[1:] for x in rows_of(rot.select("id", *g.quaternion_of([F.col(f"r{i}") for i in range(9)])))}
    for i, *q in qs:
        n = math.sqrt(sum(c * c for c in q)) or None
        want = [c / n for c in q] if n else [0, 0, 0, 1]
        assert min(max(abs(a - s * b) for a, b in zip(back[i], want)) for s in (1, -1)) < 1e-9


def test_strict_and_grid_voxels(spark):
    pts = [(f, 0.1 * i, 0.05 * f, 0.0) for f in range(45) for i in range(10)]
    df = spark.createDataFrame([(f"{f:03}.pcd", float(f), x, y, z) for f, x, y, z in pts], "path string, frame_ts double, x double, y double, z double")
    out = cloud_merge.merge(df, cloud_merge.MergeOptions(0.3, max_range=5.0, rotate_z_deg=90.0))
    assert {r["disposition"]: r["n_frames"] for r in out.summary().collect()} == {"accepted": 45}
    grid = voxel.merged(voxel.voxels(df.select(F.col("path"), (-F.col("y")).alias("x"), F.col("x").alias("y"), "z"), (0.3,) * 3, by=("path",)))
    assert abs(out.cloud.count() - grid.count()) <= 2
    strict = cloud_merge.merge(df, cloud_merge.MergeOptions(0.3, mode="strict"))
    assert 0 < strict.cloud.count() <= 45 * 10
    with pytest.raises(ValueError):
        cloud_merge.MergeOptions(0.3, min_range=2.0, max_range=1.0)


def test_text_loaders(spark, tmp_path):
    (tmp_path / "t.csv").write_text("t,x,y,z\n2,1,1,1\n1,0,0,0\n\nbad,1,1,1\n3,1\n")
    assert sorted(r[1] for r in rows_of(text.read_trajectory(spark, f"{tmp_path}/t.csv"))) == [1.0, 2.0]
    (tmp_path / "p.txt").write_text("# c\n\n 5 1 2 3 0 0 0 1 7\n4 1 2 3 0 0 0 1\nshort 1\n")
    got = text.read_poses(spark, f"{tmp_path}/p.txt").orderBy("row_idx").collect()
    assert [(r["t"], r["pid"]) for r in got] == [(5.0, 7), (4.0, -1)]
    assert sorted(r[0] for r in rows_of(text.read_keyframe_times(spark, f"{tmp_path}/p.txt"))) == [4.0, 5.0]
    assert text.resolve_output("a/b.PCD", "pcd") == "a/b.PCD" and text.resolve_output("a/b.ply", "pcd") == "a/b.pcd" and text.resolve_output("a/b", "auto") == "a/b"


def test_cloud_files(spark, tmp_path):
    pts = np.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.5]])
    (tmp_path / "12.5.pcd").write_bytes(clouds.encode("a.pcd", pts))
    (tmp_path / "x.pcd").write_text("VERSION .7\nFIELDS x y z i\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 1\nHEIGHT 1\nVIEWPOINT 7 8 9 1 0 0 0\nPOINTS 1\nDATA ascii\n1 2 3 4\n")
    got = clouds.read_clouds(spark, f"{tmp_path}").orderBy("frame_ts", "x").collect()
    assert [(r["frame_ts"], r["x"], r["z"], r["vx"]) for r in got] == [(None, 1.0, 3.0, 7.0), (12.5, 1.0, 3.0, 0.0), (12.5, 4.0, 6.5, 0.0)]
    assert clouds.list_frames(spark, f"{tmp_path}").count() == 2
    raw = np.ascontiguousarray(np.tile([1.0, 2.0], 20), "<f4").tobytes() + np.arange(40, dtype="<f4").tobytes() + bytes(160)
    packed = b"".join(bytes([len(raw[i : i + 32]) - 1]) + raw[i : i + 32] for i in range(0, 320, 32)) + b"\x00\x00" + bytes([7 << 5, 150, 0])
    head = b"VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 40\nHEIGHT 1\nPOINTS 40\nDATA binary_compressed\n"
    got, _ = clouds.parse_pcd(head + np.array([len(packed), 480], "<u4").tobytes() + packed)
    assert got.shape == (40, 3) and got[:, 0].tolist() == [1.0, 2.0] * 20 and got[:, 1].tolist() == list(range(40)) and not got[:, 2].any()
    bags.register(spark)
    spark.createDataFrame(pts.tolist(), "x double, y double, z double").coalesce(1).write.format("pointcloud").mode("append").save(f"{tmp_path}/out")
    again = spark.read.format("pointcloud").load(f"{tmp_path}/out")
    assert sorted(r[1:] for r in rows_of(again)) == [tuple(p) for p in pts.tolist()]


def serialised(transforms, alone=False):
    """A transform message as a log stores it."""
    out = bytearray()

    def put(kind, size, value):
        out.extend(b"\0" * (-len(out) % size))
        out.extend(struct.pack(f"<{kind}", value))

    if not alone:
        put("I", 4, len(transforms))
    for sec, nano, parent, child, *pose in transforms:
        put("i", 4, sec)
        put("I", 4, nano)
        for s in (parent, child):
            put("I", 4, len(s) + 1)
            out.extend(s.encode() + b"\0")
        for v in pose:
            put("d", 8, v)
    return b"\0\1\0\0" + bytes(out)


def test_bag_to_trajectory(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "log.db3")
    db.execute("CREATE TABLE topics (id INTEGER, name TEXT, type TEXT)")
    db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(1, "/tf", "tf2_msgs/msg/TFMessage"), (2, "/other", "std_msgs/msg/String"), (3, "/silent", "s"), (4, "/one", "geometry_msgs/msg/TransformStamped"), (5, "/cut", "tf2_msgs/msg/TFMessage")])
    still = (1, 0, "/root", "base_link", 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)
    moved = (2, 500_000_000, "root", "//base_link", 1.5, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)
    data = [[still], [still], [(1, 0, "map", "x", *still[4:]), moved], [still]]
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(i, 1, i * 10**9, serialised(d)) for i, d in enumerate(data)] + [(9, 2, 5, b"bad"), (10, 4, 6, serialised([still], alone=True)), (11, 5, 7, b"\0\1\0\0\5")])
    db.commit()
    bags.register(spark)
    log = bags.decoded(spark.read.format("bag").load(f"{tmp_path}"))
    got = trajectory.extract(log).orderBy("t", "x").collect()
    assert [(r["t"], r["x"]) for r in got] == [(1.0, 1.0), (1.0, 1.0), (2.5, 1.5)]
    topics = spark.createDataFrame([("/tf", "tf"), ("/other", "o"), ("/silent", "s")], "topic string, msgtype string")
    told = {r["topic"]: r for r in trajectory.profile(log, topics, 40).collect()}
    assert told["/silent"]["example"] is None and told["/other"]["example"] == "<ValueError: not a serialised message>" and len(told["/tf"]["example"]) == 40
    assert spark.read.format("bag").option("topic", "/other").load(f"{tmp_path}").count() == 1
    assert spark.read.format("bag").load(f"{tmp_path}").where("topic = '/tf' AND seq > 1").count() == 2
    by = {r["topic"]: r for r in log.where("topic IN ('/one', '/cut')").collect()}
    assert [t["x"] for t in by["/one"]["transforms"]] == [1.0] and by["/cut"]["transforms"] is None and by["/cut"]["error"].startswith(("error", "ValueError", "struct"))


def test_mesh_samples_lie_on_faces(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 4 0 0\nv 4 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\n")
    faces = clouds.read_faces(spark, f"{tmp_path}/m.obj")
    assert faces.count() == 2
    (tmp_path / "r.obj").write_text("".join(f"v {i} {i * i} 0\n" for i in range(1500)) + f"f {' '.join(map(str, range(1, 1501)))}\nv 9 9 9\nf -1 -2 -3\n")
    more = clouds.read_faces(spark, f"{tmp_path}/r.obj").collect()
    assert len(more) == 1499 and [[9.0, 9.0, 9.0], [1499.0, 1499.0**2, 0.0], [1498.0, 1498.0**2, 0.0]] in [[r["v0"], r["v1"], r["v2"]] for r in more]
    pts = mesh.sample_surface(faces.withColumn("face_id", F.col("face_id.k")), 500, seed=3).collect()
    assert 100 < len(pts) <= 502 and all(0 <= p["x"] <= 4 and 0 <= p["y"] <= 1 and p["z"] == 0 for p in pts)


def test_graph_json_round_trip(spark):
    graph_ = topology.extract(cloud_of(spark, 30, 7), cloud_of(spark, 20, 8))
    back = topology.from_json(topology.to_json(graph_))
    assert sorted(rows_of(back.edges)) == sorted(rows_of(graph_.edges)) and back.nodes.count() == 30
    broken = spark.createDataFrame([('{"nodes":[{"id":1.5,"x":"1.5","y":"no","z":0,"clearance_radius":1},7],"edges":[{"source":true,"target":"a","weight":1}]}',), ("[1]",), ("{",), ('{"nodes":[]}',)], "document string")
    found = {(r["subject"], r["rule"]) for r in validation.document_findings(broken).collect()}
    assert found == {("document", "root_not_object"), ("document", "unparsable"), ("document", "edges_missing"), ("nodes", "id_not_integer"), ("nodes", "y_not_finite"), ("nodes", "not_an_object"), ("edges", "target_not_integer")}
    order = validation.document_messages(broken.limit(1)).orderBy("item", "place").collect()
    assert sorted((r["subject"], r["item"], r["rule"]) for r in order) == [("edges", 0, "target_not_integer"), ("nodes", 0, "id_not_integer"), ("nodes", 0, "y_not_finite"), ("nodes", 1, "not_an_object")]
    lists = spark.createDataFrame([('{"nodes": 5, "edges": {}}',)], "document string")
    assert {r["rule"] for r in validation.document_findings(lists).collect()} == {"nodes_not_a_list", "edges_not_a_list"}
    flags = spark.createDataFrame([('{"nodes":[{"id":true,"x":0,"y":0,"z":0,"clearance_radius":1}],"edges":[]}',)], "document string")
    assert [r["id"] for r in validation.document_graph(flags)[0].collect()] == [1]


def test_document_report(spark, tmp_path):
    from spoor.plans import validate

    nodes = spark.createDataFrame([(i, float(i), 0.0, 0.0, 1.0) for i in range(3)], "id long, x double, y double, z double, clearance_radius double")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "source long, target long, weight double")
    validate.write_document(topology.Topology(nodes, edges), f"{tmp_path}/g")
    assert validate.validate(validate.read_document(spark, f"{tmp_path}/g")).status == 0
    warned = validate.validate(validate.read_document(spark, f"{tmp_path}/g"), max_max_degree=1)
    assert warned.ok and warned.findings.count() == 1
    assert validate.validate(spark.createDataFrame([("{",)], "document string")).status == 2


def test_stream_changes(spark, tmp_path):
    from spoor.streaming.changes import stream_changes

    schema = "traj_id long, seq long, x double"
    for k, part in enumerate(([(1, 1, 0.0), (1, 2, 0.0), (2, 1, 5.0)], [(1, 3, 0.0), (1, 4, 1.0), (2, 2, 5.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    out = set()
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    q = stream_changes(log, ("x",), ("seq",)).writeStream.foreachBatch(lambda df, _: out.update(rows_of(df))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert out == {(1, 1, 0.0), (2, 1, 5.0), (1, 4, 1.0)}
