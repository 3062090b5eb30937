"""The nearest obstacle: exact on odd inputs, and few comparisons where points are far or dense."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.operators import nearest, spatial

POINT = "id long, x double, y double, z double"
NAN, INF = float("nan"), float("inf")


def cloud(spark, rows):
    return spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in rows], "x double, y double, z double")


def points_of(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], POINT)


def brute(points, obstacles):
    d = np.array(points, float)[:, None] - np.array(obstacles, float)[None]
    return np.sqrt((d**2).sum(2)).min(1)


def got(df):
    return [r["clearance_radius"] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("kind", ["even", "flat", "line", "clusters", "repeated", "scales"])
def test_equals_brute_force(spark, kind):
    g = np.random.default_rng(3)
    o = g.random((700, 3))
    if kind == "flat":
        o[:, 2] = 0.5
    elif kind == "line":
        o = np.outer(g.random(700), [1, 2, 3])
    elif kind == "clusters":
        o = g.integers(0, 3, (700, 3)) * 50 + g.random((700, 3)) * 0.01
    elif kind == "repeated":
        o = g.integers(0, 4, (700, 3)).astype(float)
    elif kind == "scales":
        o = o * (10.0 ** -g.integers(0, 12, (700, 1)))
    p = np.concatenate([g.random((150, 3)) * 2 - 0.5, o[:50], g.random((20, 3)) * 1e4])
    near = got(nearest.nearest_distance(points_of(spark, p), cloud(spark, o)))
    assert np.allclose(near, brute(p, o), rtol=1e-12, atol=0)


def test_rows_without_finite_coordinates(spark):
    rows = [(0, 1.0, 0.0, 0.0), (1, NAN, 0.0, 0.0), (2, 0.0, INF, 0.0), (3, None, 0.0, 0.0), (4, 0.0, 0.0, -INF), (5, 1.0, 0.0, 0.0), (5, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame([(*r, "kept", 9.0) for r in rows], POINT + ", note string, clearance_radius double")
    walls = cloud(spark, [(0, 0, 0), (NAN, 0, 0), (1, INF, 0), (0.5, 0, -INF)])
    near = nearest.nearest_distance(p, walls)
    assert near.columns == ["id", "x", "y", "z", "note", "clearance_radius"]
    assert sorted((r.id, r.clearance_radius) for r in near.collect() if r.clearance_radius is not None) == [(0, 1.0), (5, 0.0), (5, 1.0)]
    assert near.count() == 7 and near.where("note = 'kept'").count() == 7
    assert nearest.nearest_distance(p, walls.where("isnan(x)")).where("clearance_radius IS NOT NULL").isEmpty()
    assert nearest.nearest_distance(p.limit(0), walls).isEmpty()
    one_nan = spark.createDataFrame([(0, 0.1, 0.0, 0.0), (1, 5.0, 5.0, 5.0), (2, NAN, 1.0, 1.0)], POINT)
    assert got(nearest.nearest_distance(one_nan, walls))[2] is None


@pytest.mark.parametrize("kind", ["far", "dense"])
def test_few_pairs_are_compared(spark, kind):
    n, m = 10_000, 4_000
    r = lambda seed: F.rand(seed)
    if kind == "far":  # ten extents away
        o = spark.range(m).select(r(1).alias("x"), r(2).alias("y"), r(3).alias("z"))
        p = spark.range(n).select("id", (r(4) + 10).alias("x"), r(5).alias("y"), r(6).alias("z"))
    else:  # half of all points and obstacles in a thousandth of the extent
        small = lambda df, k: df.select("id", *[F.when(F.col("id") % 2 == 0, r(k + i) / 1000).otherwise(r(k + i)).alias(a) for i, a in enumerate("xyz")])
        o, p = small(spark.range(m), 1).drop("id"), small(spark.range(n), 4)
    o, p = spark.createDataFrame(o.toPandas()), spark.createDataFrame(p.toPandas())
    tree = nearest.cells(o)
    assert tree.leaves.groupBy("node").count().agg(F.max("count")).first()[0] <= nearest.LEAF
    pairs = nearest.compared(p, tree).count()
    told = pairs / n
    assert told < (400 if kind == "far" else 150), told  # of 4,000
    near = nearest.nearest_distance(p, o)
    some = near.where("id % 100 = 3").orderBy("id").collect()
    want = brute([(q.x, q.y, q.z) for q in some], [tuple(q) for q in o.collect()])
    assert np.allclose([q.clearance_radius for q in some], want, rtol=1e-12)


def test_pairs_within_on_cell_edges_and_ties(spark):
    g = np.random.default_rng(8)
    rows = [tuple(v) for v in np.round(g.random((150, 3)) * 4) / 2] + [(NAN, 0, 0), (INF, 0, 0)]
    p = points_of(spark, rows)
    for radius in (0.5, 0.75, 0.0):
        pairs = sorted((r.source, r.target) for r in spatial.pairs_within(p, radius).collect())
        want = [(i, j) for i in range(150) for j in range(i + 1, 150) if math.dist(rows[i], rows[j]) <= radius]
        assert pairs == want


def test_collision_at_a_margin_of_zero(spark):
    edges = spark.createDataFrame([(0, 1, 2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0), (0, 2, 2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0)], "source long, target long, weight double, sx double, sy double, sz double, tx double, ty double, tz double, sr double, tr double")
    walls = cloud(spark, [(1, 0, 0), (0, 1.1, 0), (NAN, 0, 0)])
    assert [r.target for r in spatial.collision_free(edges, walls, step=0.5).collect()] == [2]
