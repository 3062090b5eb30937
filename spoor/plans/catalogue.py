"""Registered queries over the driver tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.scalars import frame_name, is_finite, shortened, stamp_seconds
from ..operators import ordered, spatial, timejoin, validation, voxel
from ..operators.graph import components, degrees
from ..operators.storage import new_path, written
from ..sources import views as v
from . import align, topology

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums in another order differ in the last bits. Adding zero makes -0.0 plain."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def averaged(df: DataFrame, *columns: str) -> DataFrame:
    """Averages of few decimals often lie on a tie of the rounding; a small shift takes them off it."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(1.3e-11), 9) + F.lit(0.0) for c in columns})


def r9(sql: str) -> str:
    return f"round({sql} + 1.3e-11::DOUBLE, 9) + 0.0::DOUBLE"


def r6(sql: str) -> str:
    return f"round({sql}, 6) + 0.0::DOUBLE"


# The views in SQL ------------------------------------------------------------------------------------------------

TF = """tf AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS log_ts_ns, '/' || event_type AS topic,
  CASE WHEN user_id % 10 < 7 THEN '/root' ELSE 'map' END AS frame_id,
  CASE WHEN user_id % 2 = 0 THEN 'base_link' ELSE '//imu_frame' END AS child_frame_id,
  (event_type IN ('view', 'click'))::INT::DOUBLE AS x, (user_id % 4)::DOUBLE / 4.0::DOUBLE AS y FROM events)"""
TRAJ = """traj AS (SELECT event_id AS row_idx, epoch_us(ts)::DOUBLE / 1e6::DOUBLE AS t, (user_id % 50)::DOUBLE / 10.0::DOUBLE AS x,
  value / 100.0::DOUBLE AS y, json_extract_string(props, '$.k')::DOUBLE / 50.0::DOUBLE AS z,
  json_extract_string(props, '$.k')::DOUBLE / 100.0::DOUBLE AS h FROM events WHERE event_type = 'purchase')"""
SLAM = """slam AS (SELECT event_id AS row_idx, epoch_us(ts)::DOUBLE / 1e6::DOUBLE AS t, value / 50.0::DOUBLE AS x,
  (user_id % 20)::DOUBLE / 4.0::DOUBLE AS y, json_extract_string(props, '$.k')::DOUBLE / 25.0::DOUBLE AS z,
  (user_id % 100)::DOUBLE / 200.0::DOUBLE AS h FROM events WHERE event_type = 'view')"""
FRAMES = "frames AS (SELECT event_id AS frame_id, epoch_us(ts)::DOUBLE / 1e6::DOUBLE AS frame_ts FROM events WHERE event_type = 'view')"
POINTS = """points AS (SELECT l_orderkey, l_linenumber, l_suppkey AS frame_id, 'f' || lpad(l_suppkey::VARCHAR, 6, '0') || '.pcd' AS path,
  l_suppkey * 0.5::DOUBLE AS frame_ts, l_quantity - 25.5::DOUBLE AS x, l_extendedprice / 1000.0::DOUBLE - 38.0::DOUBLE AS y,
  l_discount * 100.0::DOUBLE - 5.0::DOUBLE AS z FROM lineitem)"""
CLOUD = "cloud AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
GRAPH = f"""{CLOUD},
nodes0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, x, y, z FROM cloud WHERE vec_id % 5 <> 0),
obst AS (SELECT x, y, z FROM cloud WHERE vec_id % 5 = 0),
nodes AS (SELECT n.id, any_value(n.x) AS x, any_value(n.y) AS y, any_value(n.z) AS z,
  min(sqrt((n.x-o.x)*(n.x-o.x) + (n.y-o.y)*(n.y-o.y) + (n.z-o.z)*(n.z-o.z))) AS r FROM nodes0 n CROSS JOIN obst o GROUP BY n.id),
rad AS (SELECT quantile_cont(r, 0.75) * 2 AS radius FROM nodes),
pairs AS (SELECT a.id AS source, b.id AS target, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS weight,
  a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, a.r AS ar, b.r AS br FROM nodes a JOIN nodes b ON a.id < b.id),
edges AS (SELECT p.* FROM pairs p, rad WHERE weight <= radius AND weight <= ar + br)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with clearances, and their candidate edges."""
    nodes = written(spatial.nearest_distance(v.nodes(spark, sf_dir), v.obstacles(spark, sf_dir)), "nodes")
    return nodes, written(topology.candidate_edges(nodes, topology.adaptive_radius(nodes)), "candidates")


# Queries ---------------------------------------------------------------------------------------------------------


@query("q01_traj_dedupe", f"""WITH {TF}, f AS (SELECT *, ltrim(frame_id, '/') AS p, ltrim(child_frame_id, '/') AS c FROM tf),
k AS (SELECT *, lag(x) OVER (PARTITION BY topic ORDER BY log_ts_ns, seq) AS bx, lag(y) OVER (PARTITION BY topic ORDER BY log_ts_ns, seq) AS by_
  FROM f WHERE p = 'root' AND c = 'base_link')
SELECT seq, topic, log_ts_ns::DOUBLE / 1e9::DOUBLE AS t, x, y FROM k WHERE x IS DISTINCT FROM bx OR y IS DISTINCT FROM by_""")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = v.tf_messages(spark, sf_dir).where((frame_name(F.col("frame_id")) == "root") & (frame_name(F.col("child_frame_id")) == "base_link"))
    none = F.lit(None).cast("long")
    return ordered.changes(tf, ("x", "y"), ("log_ts_ns", "seq"), by=("topic",)).select("seq", "topic", stamp_seconds(none, none, F.col("log_ts_ns")).alias("t"), "x", "y")


@query("q02_topic_profile", """WITH m AS (SELECT event_type AS topic, 'type' || (user_id % 3)::VARCHAR AS msgtype, user_id, event_id, ts,
  event_type || ' of user ' || user_id::VARCHAR || ' is ' || props AS body FROM events),
t AS (SELECT topic, count(DISTINCT user_id) AS n_connections, array_to_string(list_sort(list(DISTINCT msgtype)), ',') AS msgtypes FROM m GROUP BY topic),
e AS (SELECT topic, arg_min(body, (ts, event_id)) AS body FROM m WHERE topic <> 'click' GROUP BY topic)
SELECT t.topic, n_connections, msgtypes, CASE WHEN length(body) <= 24 THEN body ELSE left(body, 21) || '...' END AS example FROM t LEFT JOIN e ON t.topic = e.topic""")
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics without a decoded message (here click) are still listed."""
    m = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.concat(F.lit("type"), (F.col("user_id") % 3).cast("string")).alias("msgtype"), "user_id", "event_id", "ts", F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"), F.lit(" is "), "props").alias("body"))
    topics = m.groupBy("topic").agg(F.count_distinct("user_id").alias("n_connections"), F.array_join(F.sort_array(F.collect_set("msgtype")), ",").alias("msgtypes"))
    first = m.where("topic <> 'click'").groupBy("topic").agg(F.min_by("body", F.struct("ts", "event_id")).alias("body"))
    return topics.join(first, "topic", "left").select("topic", "n_connections", "msgtypes", shortened(F.col("body"), 24).alias("example"))


@query("q03_range_filter", f"""WITH {POINTS} SELECT l_orderkey, l_linenumber, frame_id, x, y, z FROM points WHERE sqrt(x*x + y*y + z*z) BETWEEN 10 AND 30""")
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.points(spark, sf_dir)
    return p.where(g.in_range(g.norm(F.col("x"), F.col("y"), F.col("z")), 10.0, 30.0)).select("l_orderkey", "l_linenumber", "frame_id", "x", "y", "z")


@query("q04_roi_crop", f"""WITH {POINTS} SELECT l_orderkey, l_linenumber, x, y, z FROM points WHERE x BETWEEN -10 AND 10 AND y BETWEEN -20 AND 20 AND z BETWEEN -1 AND 2.5""")
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = ((-10.0, 10.0), (-20.0, 20.0), (-1.0, 2.5))
    return v.points(spark, sf_dir).where(g.in_box([F.col("x"), F.col("y"), F.col("z")], box)).select("l_orderkey", "l_linenumber", "x", "y", "z")


@query("q05_rotate_z", f"""WITH {CLOUD} SELECT vec_id, {r6('cos(radians(30::DOUBLE)) * x - sin(radians(30::DOUBLE)) * y')} AS x,
{r6('sin(radians(30::DOUBLE)) * x + cos(radians(30::DOUBLE)) * y')} AS y, z FROM cloud""")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = g.rotate_z(F.col("x"), F.col("y"), 30.0)
    return rounded(v.cloud(spark, sf_dir).select("vec_id", x.alias("x"), y.alias("y"), "z"), "x", "y")


@query("q06_finite_filter", f"""WITH {CLOUD}, d AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'nan'::DOUBLE WHEN vec_id % 11 = 0 THEN '-inf'::DOUBLE ELSE x END AS x, y, z FROM cloud),
k AS (SELECT count(*) FILTER (NOT isfinite(x)) AS n_dropped FROM d) SELECT vec_id, x, y, z, n_dropped FROM d, k WHERE isfinite(x) AND isfinite(y) AND isfinite(z)""")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.cloud(spark, sf_dir).withColumn("x", F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("x")))
    dropped = d.agg(F.count_if(~(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z")))).alias("n_dropped"))
    # one row
    return topology.finite_points(d).join(F.broadcast(dropped), F.lit(True)).select("vec_id", "x", "y", "z", "n_dropped")


@query("q07_keyframe_semi", f"""WITH {TRAJ}, {FRAMES} SELECT frame_id, frame_ts FROM frames f WHERE EXISTS (SELECT 1 FROM traj WHERE abs(traj.t - f.frame_ts) <= 60)""")
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timejoin.within_tolerance(v.frame_times(spark, sf_dir), v.trajectory(spark, sf_dir).select("t"), 60.0)


ASOF = f"""WITH {TRAJ}, {FRAMES},
seg AS (SELECT t AS t0, x AS x0, y AS y0, z AS z0, lead(t) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM traj WINDOW w AS (ORDER BY t, row_idx)),
ends AS (SELECT arg_min((x, y, z), (t, row_idx)) AS a, min(t) AS ta, arg_max((x, y, z), (t, row_idx)) AS b, max(t) AS tb FROM traj),
hit AS (SELECT frame_id, frame_ts, x0 + (frame_ts-t0)/(t1-t0) * (x1-x0) AS x, y0 + (frame_ts-t0)/(t1-t0) * (y1-y0) AS y, z0 + (frame_ts-t0)/(t1-t0) * (z1-z0) AS z
  FROM frames JOIN seg ON frame_ts > t0 AND frame_ts <= t1
  UNION ALL SELECT frame_id, frame_ts, a[1], a[2], a[3] FROM frames, ends WHERE frame_ts <= ta
  UNION ALL SELECT frame_id, frame_ts, b[1], b[2], b[3] FROM frames, ends WHERE frame_ts > tb)"""


def _at_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timejoin.interpolated(v.frame_times(spark, sf_dir), v.trajectory(spark, sf_dir), ts="frame_ts")


@query("q08_asof_position", f"{ASOF} SELECT frame_id, {r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z FROM hit")
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_at_frames(spark, sf_dir).select("frame_id", "x", "y", "z"), "x", "y", "z")


@query("q09_sensor_range", f"""{ASOF}, {POINTS},
d AS (SELECT h.frame_id, p.l_linenumber, sqrt((p.x-h.x)*(p.x-h.x) + (p.y-h.y)*(p.y-h.y) + (p.z-h.z)*(p.z-h.z)) AS dist FROM hit h JOIN points p ON p.l_orderkey = h.frame_id)
SELECT frame_id, l_linenumber, {r6('dist')} AS dist FROM d WHERE dist BETWEEN 5 AND 40""")
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's points are here the line items of the order of its number."""
    o = _at_frames(spark, sf_dir).select("frame_id", *[F.col(a).alias(f"o{a}") for a in "xyz"])
    p = v.points(spark, sf_dir).select(F.col("l_orderkey").alias("frame_id"), "l_linenumber", "x", "y", "z")
    d = g.norm(*[F.col(a) - F.col(f"o{a}") for a in "xyz"])
    return rounded(p.join(o, "frame_id").select("frame_id", "l_linenumber", d.alias("dist")).where(g.in_range(F.col("dist"), 5.0, 40.0)), "dist")


@query("q10_frame_centroid", f"WITH {CLOUD} SELECT label, count(*) AS n_points, {r6('avg(x)')} AS x, {r6('avg(y)')} AS y, {r6('avg(z)')} AS z FROM cloud GROUP BY label")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(v.cloud(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n_points"), *[F.avg(a).alias(a) for a in "xyz"]), "x", "y", "z")


DISPOSED = f"""WITH {POINTS},
f AS (SELECT path, any_value(frame_id) AS frame_id, any_value(frame_ts) AS frame_ts, count(*) AS n_points,
  count(*) FILTER (sqrt(x*x + y*y + z*z) BETWEEN 5 AND 6 AND z BETWEEN -1 AND 2.5) AS n_kept,
  sqrt(avg(x)*avg(x) + avg(y)*avg(y) + avg(z)*avg(z)) AS c FROM points GROUP BY path),
i AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS frame_idx,
  EXISTS (SELECT 1 FROM f k WHERE k.frame_id % 4 = 0 AND abs(k.frame_ts - f.frame_ts) <= 0.5) AS is_key FROM f),
j AS (SELECT *, min(CASE WHEN is_key AND n_points > 0 AND n_kept > 0 THEN frame_idx END) OVER () AS j0 FROM i),
disposed AS (SELECT *, CASE WHEN NOT is_key THEN 'not_keyframe' WHEN n_points = 0 THEN 'empty'
  WHEN frame_idx > 5 AND frame_idx > j0 AND c < 14.5 THEN 'centroid_guard' WHEN n_kept = 0 THEN 'after_filters' ELSE 'accepted' END AS disposition FROM j)"""


def _disposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.points(spark, sf_dir)
    ok = g.in_range(g.norm(F.col("x"), F.col("y"), F.col("z")), 5.0, 6.0) & g.in_range(F.col("z"), -1.0, 2.5)
    f = p.groupBy("path").agg(F.first("frame_id").alias("frame_id"), F.first("frame_ts").alias("frame_ts"), F.count(F.lit(1)).alias("n_points"), F.count_if(ok).alias("n_kept"), *[F.avg(a).alias(f"c{a}") for a in "xyz"])
    f = ordered.numbered(f, "path", "frame_idx").withColumn("centroid_norm", g.norm(F.col("cx"), F.col("cy"), F.col("cz")))
    keys = timejoin.within_tolerance(f.select("path", "frame_ts"), f.where("frame_id % 4 = 0").select(F.col("frame_ts").alias("t")), 0.5)
    f = f.join(keys.select("path").distinct().withColumn("is_key", F.lit(True)), "path", "left").fillna(False, ["is_key"])
    return ordered.disposition(f, F.col("is_key"), radius=14.5)


@query("q11_disposition", f"""{DISPOSED} SELECT disposition, count(*) AS n_frames, sum(CASE WHEN disposition = 'accepted' THEN n_points ELSE 0 END)::BIGINT AS n_points FROM disposed GROUP BY disposition""")
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = F.col("disposition") == "accepted"
    return _disposed(spark, sf_dir).groupBy("disposition").agg(F.count(F.lit(1)).alias("n_frames"), F.sum(F.when(yes, F.col("n_points")).otherwise(0)).alias("n_points"))


VOXELS = f"""WITH {POINTS}, each AS (SELECT frame_id, floor(x/5.0::DOUBLE)::BIGINT AS vx, floor(y/5.0::DOUBLE)::BIGINT AS vy, floor(z/2.0::DOUBLE)::BIGINT AS vz,
  avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM points GROUP BY ALL)"""
CELL = (5.0, 5.0, 2.0)


@query("q12_voxel_frame", f"{VOXELS} SELECT frame_id, vx, vy, vz, {r9('x')} AS x, {r9('y')} AS y, {r9('z')} AS z, n FROM each")
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return averaged(voxel.voxels(v.points(spark, sf_dir), CELL, by=("frame_id",)), "x", "y", "z")


@query("q13_voxel_merge", f"{VOXELS} SELECT vx, vy, vz, {r9('avg(x)')} AS x, {r9('avg(y)')} AS y, {r9('avg(z)')} AS z FROM each GROUP BY vx, vy, vz")
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return averaged(voxel.merged(voxel.voxels(v.points(spark, sf_dir), CELL, by=("frame_id",))), "x", "y", "z")


QUAT = """q0 AS (SELECT vec_id, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c, embedding[7]::DOUBLE AS d FROM embeddings),
q1 AS (SELECT vec_id, a / n AS x, b / n AS y, c / n AS z, d / n AS w FROM (SELECT *, sqrt(a*a + b*b + c*c + d*d) AS n FROM q0)),
rot AS (SELECT vec_id, 1 - 2*(y*y + z*z) AS r0, 2*(x*y - z*w) AS r1, 2*(x*z + y*w) AS r2, 2*(x*y + z*w) AS r3, 1 - 2*(x*x + z*z) AS r4, 2*(y*z - x*w) AS r5,
  2*(x*z - y*w) AS r6, 2*(y*z + x*w) AS r7, 1 - 2*(x*x + y*y) AS r8 FROM q1)"""


@query("q14_quat_rot", f"WITH {QUAT} SELECT vec_id, " + ", ".join(f"{r6(f'r{i}')} AS r{i}" for i in range(9)) + " FROM rot")
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = v.quaternions(spark, sf_dir)
    return rounded(align.rotations(q), *[f"r{i}" for i in range(9)])


_SIGN = "CASE WHEN r0 + r4 + r8 > 0 THEN sign(w) WHEN r0 > r4 AND r0 > r8 THEN sign(x) WHEN r4 > r8 THEN sign(y) ELSE sign(z) END"


@query("q15_rot_quat", f"WITH {QUAT}, s AS (SELECT q1.*, {_SIGN} AS s FROM q1 JOIN rot USING (vec_id)) SELECT vec_id, " + ", ".join(f"{r6(f's * {c}')} AS q{c}" for c in "xyzw") + " FROM s")
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = v.quaternions(spark, sf_dir)
    r = align.rotations(q)
    back = g.quaternion_of([F.col(f"r{i}") for i in range(9)])
    return rounded(r.select("vec_id", *[c.alias(n) for c, n in zip(back, align.QUAT, strict=True)]), *align.QUAT)


ANCHOR = f"""WITH {TRAJ}, {SLAM}, first AS (SELECT * FROM slam ORDER BY row_idx LIMIT 1),
lo AS (SELECT traj.* FROM traj, first WHERE traj.t < first.t ORDER BY traj.t DESC, traj.row_idx DESC LIMIT 1),
hi AS (SELECT traj.* FROM traj, first WHERE traj.t >= first.t ORDER BY traj.t, traj.row_idx LIMIT 1),
b AS (SELECT coalesce(lo.t, hi.t) AS t0, coalesce(hi.t, lo.t) AS t1, coalesce(lo.x, hi.x) AS x0, coalesce(hi.x, lo.x) AS x1, coalesce(lo.y, hi.y) AS y0, coalesce(hi.y, lo.y) AS y1,
  coalesce(lo.z, hi.z) AS z0, coalesce(hi.z, lo.z) AS z1, coalesce(lo.h, hi.h) AS h0, coalesce(hi.h, lo.h) AS h1 FROM (SELECT 1) one LEFT JOIN lo ON TRUE LEFT JOIN hi ON TRUE),
al AS (SELECT b.*, CASE WHEN t1 > t0 THEN (first.t - t0) / (t1 - t0) ELSE 0 END AS a, abs(h1 - h0) AS th FROM b, first),
wt AS (SELECT *, CASE WHEN cos(th) > 0.9995 THEN 1 - a ELSE sin((1 - a) * th) / sin(th) END AS wa, CASE WHEN cos(th) > 0.9995 THEN a ELSE sin(a * th) / sin(th) END AS wb FROM al),
gt AS (SELECT (1-a)*x0 + a*x1 AS gx, (1-a)*y0 + a*y1 AS gy, (1-a)*z0 + a*z1 AS gz, atan2(wa*sin(h0) + wb*sin(h1), wa*cos(h0) + wb*cos(h1)) AS gh FROM wt),
al2 AS (SELECT gx, gy, gz, gh - first.h AS dh, first.x AS px, first.y AS py, first.z AS pz FROM gt, first),
moved AS (SELECT s.row_idx, cos(2*dh)*(s.x-px) - sin(2*dh)*(s.y-py) + gx AS x, sin(2*dh)*(s.x-px) + cos(2*dh)*(s.y-py) + gy AS y, s.z - pz + gz AS z, s.h + dh AS h FROM slam s, al2)"""


@query("q16_align_poses", f"""{ANCHOR} SELECT row_idx, {r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z,
{r6('CASE WHEN 1 + 2*cos(2*h) > 0 THEN sign(cos(h)) ELSE sign(sin(h)) END * sin(h)')} AS qz, {r6('CASE WHEN 1 + 2*cos(2*h) > 0 THEN sign(cos(h)) ELSE sign(sin(h)) END * cos(h)')} AS qw FROM moved""")
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = v.slam_poses(spark, sf_dir)
    out = align.move_poses(poses, align.anchor(v.trajectory(spark, sf_dir), poses))
    return rounded(out.select("row_idx", "x", "y", "z", "qz", "qw"), "x", "y", "z", "qz", "qw")


@query("q17_align_cloud", f"""{ANCHOR}, {CLOUD} SELECT vec_id, {r6('cos(2*dh)*(c.x-px) - sin(2*dh)*(c.y-py) + gx')} AS x, {r6('sin(2*dh)*(c.x-px) + cos(2*dh)*(c.y-py) + gy')} AS y, {r6('c.z - pz + gz')} AS z FROM cloud c, al2""")
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rigid = align.anchor(v.trajectory(spark, sf_dir), v.slam_poses(spark, sf_dir))
    return rounded(align.move_points(v.cloud(spark, sf_dir).select("vec_id", "x", "y", "z"), rigid), "x", "y", "z")


@query("q18_clearance", f"WITH {GRAPH} SELECT id, {r6('r')} AS clearance_radius FROM nodes")
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.nearest_distance(v.nodes(spark, sf_dir), v.obstacles(spark, sf_dir)).select("id", "clearance_radius"), "clearance_radius")


@query("q19_adaptive_radius", f"WITH {GRAPH} SELECT {r6('radius')} AS radius FROM rad")
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spatial.nearest_distance(v.nodes(spark, sf_dir), v.obstacles(spark, sf_dir))
    quartile = validation.interpolated(written(nodes.select("clearance_radius"), "clearances"), "clearance_radius", 0.75, "radius")
    return rounded(quartile.select((F.col("radius") * 2).alias("radius")), "radius")


@query("q20_topology_edges", f"WITH {GRAPH} SELECT source, target, {r6('weight')} AS weight FROM edges")
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph(spark, sf_dir)[1].select("source", "target", "weight"), "weight")


@query("q21_collision_free", f"""WITH {GRAPH}, e AS MATERIALIZED (SELECT source, target, weight, ax, ay, az, bx, by_, bz, greatest(2, ceil(weight / 0.02::DOUBLE)::BIGINT + 1) AS n FROM edges),
s AS MATERIALIZED (SELECT *, unnest(range(n)) AS i FROM e),
p AS MATERIALIZED (SELECT source, target, ax + i::DOUBLE/(n-1) * (bx-ax) AS x, ay + i::DOUBLE/(n-1) * (by_-ay) AS y, az + i::DOUBLE/(n-1) * (bz-az) AS z FROM s),
oc AS MATERIALIZED (SELECT x, y, z, floor(x / 0.0101)::BIGINT + unnest([-1, 0, 1]) AS cx FROM obst),
hit AS MATERIALIZED (SELECT DISTINCT source, target FROM p JOIN oc o ON floor(p.x / 0.0101)::BIGINT = o.cx WHERE sqrt((p.x-o.x)*(p.x-o.x) + (p.y-o.y)*(p.y-o.y) + (p.z-o.z)*(p.z-o.z)) <= 0.01)
SELECT e.source, e.target, {r6('e.weight')} AS weight FROM e LEFT JOIN hit ON hit.source = e.source AND hit.target = e.target WHERE hit.source IS NULL""")
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spatial.collision_free(graph(spark, sf_dir)[1], v.obstacles(spark, sf_dir), step=0.02, margin=0.01)
    return rounded(edges.select("source", "target", "weight"), "weight")


NBR = "nbr AS (SELECT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges)"


@query("q22_degree_stats", f"""WITH {GRAPH}, {NBR}, deg AS (SELECT id, count(v) AS d FROM nodes LEFT JOIN nbr ON u = id GROUP BY id), e AS (SELECT count(*) AS n_edges FROM edges)
SELECT count(*) AS n_nodes, {r6('avg(d)')} AS mean_degree, max(d) AS max_degree, count(*) FILTER (d = 0) AS isolated, any_value(n_edges) AS n_edges, {r6('any_value(n_edges)::DOUBLE / count(*)')} AS edges_per_node FROM deg, e""")
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.summary(*graph(spark, sf_dir)), "mean_degree", "edges_per_node")


@query("q23_components", f"""WITH RECURSIVE {GRAPH}, thin AS (SELECT * FROM edges WHERE weight <= 0.05), near AS (SELECT source AS u, target AS v FROM thin UNION SELECT target, source FROM thin),
reach(id, got) AS (SELECT id, id FROM nodes UNION SELECT reach.id, near.v FROM reach JOIN near ON near.u = reach.got) SELECT id, min(got) AS component FROM reach GROUP BY id""")
def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return components(nodes, edges.where("weight <= 0.05"))


@query("q24_percentile_lower", f"""WITH {GRAPH}, l AS (SELECT list_sort(list(weight)) AS w, count(*) AS n FROM edges)
SELECT {r6('w[1 + trunc(0.95::DOUBLE * (n-1))::BIGINT]')} AS p95, {r6('w[1 + trunc(0.5::DOUBLE * (n-1))::BIGINT]')} AS median, {r6('w[1]')} AS low, {r6('w[n]')} AS high FROM l""")
def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.ranked(written(graph(spark, sf_dir)[1].select("weight"), "weights"), "weight", {"p95": 0.95, "median": 0.5, "low": 0.0, "high": 1.0}), "p95", "median", "low", "high")


@query("q25_graph_findings", f"""WITH {GRAPH}, broken AS (SELECT source, target, weight FROM edges UNION ALL SELECT source, source, weight FROM edges WHERE source % 9 = 0
  UNION ALL SELECT source, 100000 + target, weight FROM edges WHERE target % 8 = 0 UNION ALL SELECT source, target, -weight FROM edges WHERE source % 7 = 0 UNION ALL SELECT source, target, 'nan'::DOUBLE FROM edges WHERE source % 6 = 0),
f AS (SELECT CASE WHEN source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes) THEN 'unknown_endpoint' WHEN NOT isfinite(weight) THEN 'weight_not_finite'
  WHEN weight < 0 THEN 'negative_weight' WHEN source = target THEN 'self_loop' ELSE 'none' END AS fault FROM broken) SELECT fault, count(*) AS n FROM f GROUP BY fault""")
def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    e = written(edges.select("source", "target", "weight"), "edges")
    broken = e.unionByName(e.where("source % 9 = 0").select("source", F.col("source").alias("target"), "weight"))
    broken = broken.unionByName(e.where("target % 8 = 0").withColumn("target", F.col("target") + 100000))
    broken = broken.unionByName(e.where("source % 7 = 0").withColumn("weight", -F.col("weight"))).unionByName(e.where("source % 6 = 0").withColumn("weight", F.lit(float("nan"))))
    return validation.edge_faults(nodes, broken).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query("q26_pose_lines", f"WITH {TRAJ} SELECT row_idx, printf('%.6f %.6f %.6f %.6f', t, x, y, z) || ' ' || row_idx::VARCHAR AS line FROM traj")
def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import pose_line

    return v.trajectory(spark, sf_dir).select("row_idx", pose_line(["t", "x", "y", "z"], "row_idx").alias("line"))


@query("q27_batches", f"{DISPOSED} SELECT path, ((row_number() OVER (ORDER BY frame_idx) - 1) // 20)::BIGINT AS batch FROM disposed WHERE disposition = 'accepted'")
def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.batches(_disposed(spark, sf_dir).where("disposition = 'accepted'").select("path", "frame_idx"), "frame_idx").select("path", "batch")


@query("q28_graph_json", f"WITH {GRAPH} SELECT source, target, {r6('weight')} AS weight FROM edges")
def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    document = topology.to_json(topology.Topology(nodes, edges.select("source", "target", "weight")))
    return rounded(topology.from_json(document).edges, "weight")


@query("q29_mesh_sample")
def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even samples of triangles made of three neighbouring vectors each."""
    from .mesh import sample_surface

    c = v.cloud(spark, sf_dir)
    faces = c.groupBy(F.floor(F.col("vec_id") / 3).alias("face_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", F.array("x", "y", "z").alias("p")))).alias("v")).where("size(v) = 3")
    return sample_surface(faces.select("face_id", *[F.col("v")[i]["p"].alias(f"v{i}") for i in range(3)]), n=50_000, seed=7)


@query("q30_degree_rows", f"WITH {GRAPH}, {NBR} SELECT id, count(v)::BIGINT AS degree FROM nodes LEFT JOIN nbr ON u = id GROUP BY id")
def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(*graph(spark, sf_dir))


# Sources and sinks: what is written is read again ------------------------------------------------------------------


@query("q31_trajectory_csv", f"WITH {TRAJ} SELECT {r6('t')} AS t, {r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z FROM traj")
def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import text

    text.write_trajectory(v.trajectory(spark, sf_dir), path := new_path(spark, "trajectory"))
    return rounded(text.read_named_trajectory(spark, path).select("t", "x", "y", "z"), "t", "x", "y", "z")


def _pose_file(spark: SparkSession, sf_dir: str) -> str:
    from ..sources import text

    poses = v.slam_poses(spark, sf_dir)
    text.write_poses(poses.withColumn("pid", F.when(F.col("row_idx") % 3 > 0, F.col("row_idx")).otherwise(F.lit(-1))), path := new_path(spark, "poses"))
    return path


@query("q32_pose_text", f"WITH {SLAM} SELECT CASE WHEN row_idx % 3 > 0 THEN row_idx ELSE -1 END::INT AS pid, {r6('t')} AS t, {r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z, {r6('sin(h)')} AS qz, {r6('cos(h)')} AS qw FROM slam")
def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import read_poses

    return rounded(read_poses(spark, _pose_file(spark, sf_dir)).select("pid", "t", "x", "y", "z", "qz", "qw"), "t", "x", "y", "z", "qz", "qw")


@query("q33_keyframe_times", f"WITH {SLAM} SELECT {r6('t')} AS t FROM slam")
def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import read_keyframe_times

    return rounded(read_keyframe_times(spark, _pose_file(spark, sf_dir)), "t")


@query("q34_cloud_files", f"WITH {CLOUD} SELECT x, y, z FROM cloud")
def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import bags, clouds

    bags.register(spark)
    v.cloud(spark, sf_dir).select("x", "y", "z").write.format("pointcloud").option("kind", "pcd").mode("append").save(path := new_path(spark, "clouds"))
    return clouds.read_clouds(spark, path).select("x", "y", "z")


# More of the merge and of the rules --------------------------------------------------------------------------------


@query("q35_origin_chain", f"""WITH {POINTS}, {TRAJ}, o AS (SELECT arg_min(x, (t, row_idx)) AS x, arg_min(y, (t, row_idx)) AS y, arg_min(z, (t, row_idx)) AS z FROM traj),
p AS (SELECT points.*, CASE WHEN frame_id % 3 > 0 THEN o.x WHEN frame_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS ox, CASE WHEN frame_id % 3 > 0 THEN o.y WHEN frame_id % 2 = 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS oy,
  CASE WHEN frame_id % 3 > 0 THEN o.z WHEN frame_id % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS oz FROM points, o),
k AS (SELECT path, count(*) AS n_points, count(*) FILTER (sqrt((x-ox)*(x-ox) + (y-oy)*(y-oy) + (z-oz)*(z-oz)) BETWEEN 4 AND 20 AND z BETWEEN -3 AND 4) AS n_kept FROM p GROUP BY path)
SELECT path, n_points, n_kept, CASE WHEN n_kept = 0 THEN 'after_filters' ELSE 'accepted' END AS disposition FROM k""")
def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor's origin is the track's place at the frame's time, else the file's viewpoint, else zero."""
    from .cloud_merge import MergeOptions, merge

    even = F.col("frame_id") % 2 == 0
    p = v.points(spark, sf_dir).withColumn("frame_ts", F.when(F.col("frame_id") % 3 > 0, F.col("frame_ts")))
    p = p.select("path", "frame_ts", "x", "y", "z", *[F.when(even, F.lit(o)).otherwise(F.lit(0.0)).alias(f"v{a}") for a, o in zip("xyz", (1.0, 2.0, 0.5), strict=True)])
    options = MergeOptions(1.0, 4.0, 20.0, ((None, None), (None, None), (-3.0, 4.0)), range_mode="sensor_local", centroid_guard=False)
    return merge(p, options, track=v.trajectory(spark, sf_dir)).frames.select("path", "n_points", "n_kept", "disposition")


def _fold_sql(rounds: int, size: float) -> str:
    """Rounds of strict folding written out, each on a grid from its own corner."""
    out, before = [], None
    for k in range(rounds):
        part = f"SELECT x, y, z FROM each WHERE frame_id % {rounds} = {k}"
        rows = part if before is None else f"SELECT x, y, z FROM {before} UNION ALL {part}"
        cells = ", ".join(f"floor(({a} - (l{a} - {size / 2}::DOUBLE)) / {size}::DOUBLE)::BIGINT AS v{a}" for a in "xyz")
        lows = ", ".join(f"min({a}) AS l{a}" for a in "xyz")
        out.append(f"f{k} AS ({rows}), g{k} AS (SELECT {', '.join(f'avg({a}) AS {a}' for a in 'xyz')} FROM (SELECT x, y, z, {cells} FROM f{k}, (SELECT {lows} FROM f{k})) GROUP BY vx, vy, vz)")
        before = f"g{k}"
    return ", ".join(out)


FOLDS, FOLD_SIZE = 3, 4.37


@query("q36_compaction", f"{VOXELS}, {_fold_sql(FOLDS, FOLD_SIZE)} SELECT {r9('x')} AS x, {r9('y')} AS y, {r9('z')} AS z FROM g{FOLDS - 1}")
def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud is downsampled again after each batch of frames; here the batches go by the frame's number."""
    each = voxel.voxels(v.points(spark, sf_dir), CELL, by=("frame_id",)).withColumn("batch", F.col("frame_id") % FOLDS)
    return averaged(voxel.folded(each, "batch", FOLD_SIZE), "x", "y", "z")


BROKEN = """thin AS (SELECT source, target, weight FROM edges WHERE weight <= 0.05),
bn AS (SELECT id, CASE WHEN id % 50 = 0 THEN 'nan'::DOUBLE ELSE x END AS x, y, z, r FROM nodes WHERE id % 31 <> 30 UNION ALL SELECT id, x, y, z, r FROM nodes WHERE id % 29 = 0 AND id % 31 <> 30),
be AS (SELECT * FROM thin UNION ALL SELECT source, source, weight FROM thin WHERE source % 9 = 0 UNION ALL SELECT source, target, -weight FROM thin WHERE source % 7 = 0 UNION ALL SELECT source, target, 'inf'::DOUBLE FROM thin WHERE source % 6 = 0)"""


def _broken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graph(spark, sf_dir)
    nodes = nodes.where("id % 31 <> 30")
    bad = nodes.withColumn("x", F.when(F.col("id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("x"))).unionByName(nodes.where("id % 29 = 0"))
    e = written(edges.where("weight <= 0.05").select("source", "target", "weight"), "edges")
    more = e.unionByName(e.where("source % 9 = 0").withColumn("target", F.col("source"))).unionByName(e.where("source % 7 = 0").withColumn("weight", -F.col("weight")))
    return written(bad, "nodes"), written(more.unionByName(e.where("source % 6 = 0").withColumn("weight", F.lit(float("inf")))), "edges")


@query("q37_findings", f"""WITH RECURSIVE {GRAPH}, {BROKEN}, ids AS (SELECT DISTINCT id FROM bn),
f AS (SELECT source, target, weight, CASE WHEN source NOT IN (SELECT id FROM ids) OR target NOT IN (SELECT id FROM ids) THEN 'unknown_endpoint' WHEN NOT isfinite(weight) THEN 'weight_not_finite'
  WHEN weight < 0 THEN 'negative_weight' WHEN source = target THEN 'self_loop' END AS fault FROM be),
used AS (SELECT * FROM f WHERE fault IS NULL OR fault = 'self_loop'),
near AS (SELECT source AS u, target AS v FROM used UNION SELECT target, source FROM used),
reach(id, got) AS (SELECT id, id FROM ids UNION SELECT reach.id, near.v FROM reach JOIN near ON near.u = reach.got),
comp AS (SELECT c, count(*) AS n FROM (SELECT id, min(got) AS c FROM reach GROUP BY id) GROUP BY c),
deg AS (SELECT id, count(v) AS d FROM ids LEFT JOIN near ON u = id GROUP BY id),
w AS (SELECT list_sort(list(weight)) AS w, count(*) AS n FROM used),
told AS (
  SELECT 1 AS phase, 'FAIL' AS severity, 'node_not_finite' AS rule, (SELECT count(*) FROM bn WHERE NOT isfinite(x)) AS n
  UNION ALL SELECT 2, 'FAIL', 'ids_not_unique', (SELECT count(id) - count(DISTINCT id) FROM bn)
  UNION ALL SELECT 3, 'FAIL', 'ids_not_contiguous', (SELECT max(id) - min(id) + 1 - count(DISTINCT id) FROM bn)
  UNION ALL SELECT 4, 'FAIL', 'unknown_endpoint', (SELECT count(*) FROM f WHERE fault = 'unknown_endpoint')
  UNION ALL SELECT 5, 'FAIL', 'weight_not_finite', (SELECT count(*) FROM f WHERE fault = 'weight_not_finite')
  UNION ALL SELECT 6, 'FAIL', 'negative_weight', (SELECT count(*) FROM f WHERE fault = 'negative_weight')
  UNION ALL SELECT 7, 'FAIL', 'self_loop', (SELECT count(*) FROM f WHERE fault = 'self_loop')
  UNION ALL SELECT 8, 'FAIL', 'isolated_nodes', (SELECT count(*) FROM deg WHERE d = 0)
  UNION ALL SELECT 9, 'FAIL', 'largest_component', ((SELECT max(n) FROM comp) < (SELECT count(*) FROM ids))::INT
  UNION ALL SELECT 10, 'WARN', 'mean_degree', ((SELECT avg(d) FROM deg) > 0.5)::INT
  UNION ALL SELECT 11, 'WARN', 'max_degree', ((SELECT max(d) FROM deg) > 2)::INT
  UNION ALL SELECT 12, 'WARN', 'p95_weight', ((SELECT w[1 + trunc(0.95::DOUBLE * (n-1))::BIGINT] FROM w) > 0.01)::INT)
SELECT phase::INT AS phase, severity, rule, n::BIGINT AS n FROM told WHERE n > 0""")
def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the report on a graph with planted faults."""
    return validation.findings(*_broken(spark, sf_dir), max_avg_degree=0.5, max_max_degree=2, max_p95_weight=0.01)


@query("q38_id_sets", f"WITH {GRAPH}, {BROKEN} SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) = count(DISTINCT id) AS is_unique, max(id) - min(id) + 1 = count(DISTINCT id) AS is_contiguous FROM bn")
def q38(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _broken(spark, sf_dir)
    n = nodes.agg(F.count("id").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    return n.select("n_rows", "n_ids", (F.col("n_rows") == F.col("n_ids")).alias("is_unique"), (F.col("hi") - F.col("lo") + 1 == F.col("n_ids")).alias("is_contiguous"))


@query("q39_document_faults", """WITH c AS (SELECT vec_id, vec_id % 12 AS k, (vec_id // 10) % 9 AS g, vec_id // 10 AS d FROM embeddings),
f AS (SELECT 'document' AS subject, 'unparsable' AS rule, count(DISTINCT d) AS n FROM c WHERE g = 0
  UNION ALL SELECT 'lists', 'nodes_not_a_list', count(DISTINCT d) FROM c WHERE g = 1
  UNION ALL SELECT 'nodes', CASE k WHEN 0 THEN 'not_an_object' WHEN 2 THEN 'y_not_finite' WHEN 3 THEN 'z_missing' ELSE 'id_not_integer' END, count(*) FROM c WHERE g > 1 AND k < 5 GROUP BY ALL
  UNION ALL SELECT 'edges', CASE k WHEN 5 THEN 'source_not_integer' WHEN 6 THEN 'weight_missing' ELSE 'weight_not_finite' END, count(*) FROM c WHERE g > 0 AND k IN (5, 6, 7) GROUP BY ALL)
SELECT subject, rule, n::BIGINT AS n FROM f WHERE n > 0""")
def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural faults of documents of ten places each, some with planted faults; some documents are cut off, or have no list of nodes."""
    k, n = F.col("vec_id") % 12, F.col("vec_id").cast("string")
    place = lambda y, z: F.concat(F.lit(',"x":'), F.col("x").cast("string"), F.lit(',"y":'), y, z, F.lit(',"clearance_radius":1}'))
    y, z = F.col("y").cast("string"), F.concat(F.lit(',"z":'), F.col("z").cast("string"))
    name = F.when(k == 1, F.lit("1.5")).when(k == 4, F.lit('"a"')).otherwise(n)
    node = F.when(k == 0, F.lit("7")).otherwise(F.concat(F.lit('{"id":'), name, place(F.when(k == 2, F.lit('"no"')).otherwise(y), F.when(k == 3, F.lit("")).otherwise(z))))
    weight = F.when(k == 6, F.lit("")).when(k == 7, F.lit(',"weight":"NaN"')).otherwise(F.lit(',"weight":0.5'))
    edge = F.concat(F.lit('{"source":'), F.when(k == 5, F.lit('"x"')).otherwise(n), F.lit(',"target":'), n, weight, F.lit("}"))
    tens = v.cloud(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 10).alias("d")).agg(F.array_join(F.collect_list(node), ",").alias("nodes"), F.array_join(F.collect_list(edge), ",").alias("edges"))
    nodes = F.when(F.col("d") % 9 == 1, F.lit("5")).otherwise(F.concat(F.lit("["), "nodes", F.lit("]")))
    document = F.concat(F.lit('{"nodes":'), nodes, F.lit(',"edges":['), "edges", F.when(F.col("d") % 9 == 0, F.lit("]")).otherwise(F.lit("]}")))
    return validation.document_findings(tens.select(document.alias("document")))


# Recorded logs: events as messages of several types, written to a chunked log and read again ----------------------------

#: A type with nested parts, and one that the log has no definition of.
EVENT, UNTOLD = "plant_msgs/msg/Event", "plant_msgs/msg/Untold"
EVENT_DEFINITION = "\n".join(["int64 id", "string kind", "Part[] parts", "uint8[2] pair", "=" * 80, "MSG: plant_msgs/Part", "string name", "int32[] digits"])

LOG = """log AS (SELECT event_id, epoch_us(ts) * 1000 AS log_ts_ns, '/' || event_type || CASE user_id % 4 WHEN 0 THEN '/tf' WHEN 1 THEN '/one' WHEN 2 THEN '/event' ELSE '/untold' END AS topic,
  CASE user_id % 4 WHEN 0 THEN 'tf2_msgs/msg/TFMessage' WHEN 1 THEN 'geometry_msgs/msg/TransformStamped' WHEN 2 THEN 'plant_msgs/msg/Event' ELSE 'plant_msgs/msg/Untold' END AS msgtype,
  user_id, event_type, (user_id % 50)::DOUBLE / 8.0::DOUBLE AS x, user_id % 3 AS k FROM events)"""


def _recorded(spark: SparkSession, sf_dir: str) -> str:
    """The log's folder. Messages of a type go by the user's number.

    A file has a range of the times, in order, and there are several files a core: as many tasks code the messages, and read them.
    """
    import json

    from ..sources import bags, messages

    bags.register(spark)
    e = v.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (v.naive_micros(F.col("ts")) * 1000).alias("log_ts_ns"))
    files = max(3 * spark.sparkContext.defaultParallelism, e.rdd.getNumPartitions())
    e = e.repartitionByRange(files, "log_ts_ns").sortWithinPartitions("log_ts_ns", "event_id")
    kind = F.col("user_id") % 4
    head = F.struct(F.struct(F.floor(F.col("log_ts_ns") / 1_000_000_000).cast("int").alias("sec"), (F.col("log_ts_ns") % 1_000_000_000).alias("nanosec")).alias("stamp"), F.lit("/root").alias("frame_id"))
    place = F.struct(((F.col("user_id") % 50) / F.lit(8.0)).alias("x"), F.lit(0.5).alias("y"), F.lit(-1.0).alias("z"))
    turn = F.struct(*[F.lit(q).alias(a) for a, q in zip("xyzw", (0.0, 0.0, 0.0, 1.0), strict=True)])
    one = F.struct(head.alias("header"), F.lit("base_link").alias("child_frame_id"), F.struct(place.alias("translation"), turn.alias("rotation")).alias("transform"))
    parts = F.transform(F.sequence(F.lit(1), F.col("user_id") % 3 + 1), lambda i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("name"), F.sequence(F.lit(1).cast("long"), i).alias("digits")))
    event = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), parts.alias("parts"), F.lit("AQI=").alias("pair"))
    rows = e.select(
        F.concat(F.lit("/"), "event_type", F.when(kind == 0, "/tf").when(kind == 1, "/one").when(kind == 2, "/event").otherwise("/untold")).alias("topic"),
        F.when(kind == 0, "tf2_msgs/msg/TFMessage").when(kind == 1, "geometry_msgs/msg/TransformStamped").otherwise(EVENT).alias("msgtype"),
        "log_ts_ns",
        F.when(kind == 0, F.to_json(F.struct(F.array(one, one).alias("transforms")))).when(kind == 1, F.to_json(one)).otherwise(F.to_json(event)).alias("json"),
        (kind == 3).alias("untold"),
    )
    rows = messages.encoded(rows, {EVENT: EVENT_DEFINITION}).withColumn("msgtype", F.when(F.col("untold"), UNTOLD).otherwise(F.col("msgtype")))
    path = new_path(spark, "log")
    rows.select("topic", "msgtype", "log_ts_ns", "raw").write.format("message_log").option("definitions", json.dumps({EVENT: EVENT_DEFINITION})).mode("append").save(path)
    return path


def _log(spark: SparkSession, path: str, **only) -> DataFrame:
    from ..sources import chunked_logs, messages

    return messages.decoded(chunked_logs.read_log(spark, path, **only), chunked_logs.definitions_of(chunked_logs.read_topics(spark, path)))


@query("q40_log_messages", f"""WITH {LOG} SELECT topic, log_ts_ns, msgtype, (user_id % 4 = 3) AS is_error, (CASE user_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::INT AS n_transforms,
CASE WHEN user_id % 4 < 2 THEN x ELSE -1.0::DOUBLE END AS x, CASE WHEN user_id % 4 = 2 THEN event_id ELSE -1 END AS id, CASE WHEN user_id % 4 = 2 THEN 'p' || (k + 1)::VARCHAR ELSE '' END AS last_part, (CASE WHEN user_id % 4 = 2 THEN k + 1 ELSE 0 END)::INT AS last_digit FROM log""")
def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the log, with what its type tells; a type without definition is an error in its row."""
    log = _log(spark, _recorded(spark, sf_dir))
    last = F.element_at(F.variant_get("value", "$.parts", "array<struct<name: string, digits: array<int>>>"), -1)
    return log.select("topic", "log_ts_ns", "msgtype", F.col("error").isNotNull().alias("is_error"), F.when(F.col("transforms").isNull(), 0).otherwise(F.size("transforms")).alias("n_transforms"), F.coalesce(F.get(F.col("transforms.x"), F.lit(0)), F.lit(-1.0)).alias("x"), F.coalesce(F.variant_get("value", "$.id", "long"), F.lit(-1).cast("long")).alias("id"), F.coalesce(last["name"], F.lit("")).alias("last_part"), F.coalesce(F.element_at(last["digits"], -1), F.lit(0)).alias("last_digit"))


@query("q41_log_window", f"""WITH {LOG}, w AS (SELECT min(log_ts_ns) + (max(log_ts_ns) - min(log_ts_ns)) // 4 AS a, min(log_ts_ns) + (max(log_ts_ns) - min(log_ts_ns)) // 2 AS b FROM log)
SELECT topic, log_ts_ns, event_id AS id FROM log, w WHERE log_ts_ns >= a AND log_ts_ns < b AND topic IN ('/view/event', '/click/event')""")
def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topics in a quarter of the log's time: the index leaves the other chunks packed."""
    path = _recorded(spark, sf_dir)
    ends = v.table(spark, sf_dir, "events").agg(F.min(v.naive_micros(F.col("ts"))).alias("a"), F.max(v.naive_micros(F.col("ts"))).alias("b")).first()
    low, span = ends["a"] * 1000, (ends["b"] - ends["a"]) * 1000
    return _log(spark, path, start=low + span // 4, end=low + span // 2, topics=["/view/event", "/click/event"]).select("topic", "log_ts_ns", F.variant_get("value", "$.id", "long").alias("id"))


@query("q42_log_profile", f"""WITH {LOG}, f AS (SELECT topic, any_value(msgtype) AS msgtype, arg_min((event_id, event_type, k, user_id % 4), log_ts_ns) AS m FROM log GROUP BY topic),
p AS (SELECT topic, msgtype, m[1]::VARCHAR AS id, m[2] AS kind, m[4] AS t, array_to_string(list_transform(range(1, m[3] + 2), lambda i: '{{"digits":[' || array_to_string(range(1, i + 1), ',') || '],"name":"p' || i::VARCHAR || '"}}'), ',') AS parts FROM f),
e AS (SELECT topic, msgtype, CASE t WHEN 0 THEN '{{"transforms":[{{"child_frame_id":"base_link","header":{{"frame_id":"/root","stamp":{{"nanosec":' WHEN 1 THEN '{{"child_frame_id":"base_link","header":{{"frame_id":"/root","stamp":{{"nanosec":'
  WHEN 2 THEN '{{"id":' || id || ',"kind":"' || kind || '","pair":"AQI=","parts":[' || parts || ']}}' ELSE '<undecoded plant_msgs/msg/Untold: plant_msgs/Untold has no definition>' END AS example FROM p)
SELECT topic, msgtype, left(example, 60) AS example FROM e""")
def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic's type and the first 60 characters of its first message."""
    from ..sources import chunked_logs
    from .trajectory import profile

    path = _recorded(spark, sf_dir)
    told = profile(_log(spark, path), chunked_logs.read_topics(spark, path).select("topic", "msgtype").distinct(), 10_000)
    return told.select("topic", F.col("msgtypes")[0].alias("msgtype"), F.left("example", F.lit(60)).alias("example"))


@query("q43_log_trajectory", f"""WITH {LOG}, t AS (SELECT log_ts_ns, x, lag(x) OVER (ORDER BY log_ts_ns) AS before FROM log WHERE topic = '/view/one')
SELECT {r6("log_ts_ns::DOUBLE / 1e9::DOUBLE")} AS t, x FROM t WHERE before IS NULL OR x <> before""")
def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The poses that differ from the one before, of a topic whose messages are a transform each; times are the headers'."""
    from .trajectory import extract

    return rounded(extract(_log(spark, _recorded(spark, sf_dir), topics=["/view/one"]), topic="/view/one").select("t", "x"), "t")
