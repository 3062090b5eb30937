"""Even thinning and mesh sampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.operators import ordered
from spoor.operators.thinning import thin
from spoor.plans.mesh import sample_surface

SCHEMA = "id long, x double, y double, z double"


def table(spark, p):
    return spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], SCHEMA)


def check(p, kept, radius):
    a, b = np.array(p, float), np.array([p[i] for i in kept], float)
    among = np.linalg.norm(b[:, None] - b, axis=2)
    np.fill_diagonal(among, np.inf)
    assert among.min(initial=np.inf) > radius
    assert (np.linalg.norm(a[:, None] - b, axis=2).min(1) <= radius).all()


@pytest.mark.parametrize("kind", ["even", "grid", "copies", "line"])
def test_no_two_close_and_none_uncovered(spark, kind):
    g = np.random.default_rng(2)
    p = g.random((300, 3)) * (3, 3, 0.5)
    radius = 0.3
    if kind == "grid":
        p = np.round(p * 10) / 10  # many at exactly the radius, many equal
    elif kind == "copies":
        p[:150] = p[0]
    elif kind == "line":
        p = np.outer(np.arange(300) * 0.1, (1, 0, 0))
    df = table(spark, p)
    first = sorted(r.id for r in thin(df, radius, F.xxhash64("id"), ["id"]).collect())
    check(p.tolist(), first, radius)
    for parts in (7,):
        assert sorted(r.id for r in thin(df.repartition(parts, F.rand(parts)), radius, F.xxhash64("id"), ["id"]).collect()) == first


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (3, None, 0.0, 0.0), (4, 9.0, float("inf"), 0.0)], SCHEMA)
    assert [r.id for r in thin(df, 1.0, F.col("id"), ["id"]).collect()] == [1]
    assert thin(df.limit(0), 1.0, F.col("id"), ["id"]).isEmpty()
    with pytest.raises(ValueError, match="positive"):
        thin(df, 0.0, F.col("id"), ["id"])


def test_surface_samples_keep_their_distance(spark):
    faces = spark.createDataFrame([(0, [0.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 2.0, 0.0]), (1, [2.0, 0.0, 0.0], [2.0, 2.0, 0.0], [0.0, 2.0, 0.0]), (2, [5.0, 5.0, 5.0], [5.0, 5.0, 5.0], [5.0, 5.0, 5.0])], "face_id long, v0 array<double>, v1 array<double>, v2 array<double>")
    n = 300
    rows = sample_surface(faces, n, seed=1).collect()
    p = np.array([(r.x, r.y, r.z) for r in rows])
    radius = math.sqrt(4 / (3 * n))
    d = np.linalg.norm(p[:, None] - p, axis=2)
    np.fill_diagonal(d, np.inf)
    assert len(rows) == n and d.min() > radius and {r.face_id for r in rows} == {0, 1}
    assert abs(sum(r.face_id == 0 for r in rows) / n - 0.5) < 0.08
    few = sample_surface(faces, n, seed=1, radius=0.3).collect()
    assert 20 < len(few) < 80
    assert abs(sample_surface(faces, n, even=False).count() - n) <= 3


def test_numbers_by_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    got = {r.k: r.n for r in ordered.numbered(df, "k", "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(i * 7919 % 1009 for i in range(1000)))}
    assert ordered.numbered(df.limit(0), "k", "n").isEmpty()
