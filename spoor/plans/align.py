"""Rigid alignment of estimated poses and clouds to ground truth by the first pose of the file."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import apply, dot, product, quaternion_of, rotation_of, slerp_weights, unit
from ..operators.timejoin import asof_neighbours

XYZ, QUAT = ("x", "y", "z"), ("qx", "qy", "qz", "qw")


@dataclass
class Rigid:
    """Nine numbers of the rotation by row, and the translation."""

    r: Sequence[float]
    t: Sequence[float]


def poses_at(queries: DataFrame, track: DataFrame, ts: str = "ts") -> DataFrame:
    """Ground truth poses at the queries' times: positions linear, quaternions by slerp, ends held."""
    scaled = [c.alias(n) for c, n in zip(unit([F.col(q) for q in QUAT]), QUAT, strict=True)]
    near = asof_neighbours(queries, track.select(*[c for c in track.columns if c not in QUAT], *scaled), (*XYZ, *QUAT), ts)
    near = near.withColumn("before", F.coalesce("before", "after")).withColumn("after", F.coalesce("after", "before"))
    b, a = (lambda c: F.col(f"before.{c}")), (lambda c: F.col(f"after.{c}"))
    span = a("t") - b("t")
    alpha = F.when(span > 0, (F.col(ts) - b("t")) / span).otherwise(F.lit(0.0))
    rest = [c for c in queries.columns if c not in (*XYZ, *QUAT)]
    # a step at a time, so that what is used often is worked out once
    place = [((1 - alpha) * b(c) + alpha * a(c)).alias(c) for c in XYZ]
    rows = near.select(*rest, *place, alpha.alias("_alpha"), *[b(c).alias(f"_b{c}") for c in QUAT], *[a(c).alias(f"_a{c}") for c in QUAT])
    first, second = ([F.col(f"_{k}{c}") for c in QUAT] for k in "ba")
    rows = rows.withColumn("_dot", dot(first, second))
    wa, wb = slerp_weights(F.col("_dot"), F.col("_alpha"))
    rows = rows.withColumns({"_wa": wa, "_wb": wb})
    rows = rows.select(*rest, *XYZ, *[(F.col("_wa") * x + F.col("_wb") * y).alias(c) for x, y, c in zip(first, second, QUAT, strict=True)])
    return rows.select(*rest, *XYZ, *[c.alias(n) for c, n in zip(unit([F.col(q) for q in QUAT]), QUAT, strict=True)])


def rotations(poses: DataFrame) -> DataFrame:
    """The columns that aren't the quaternion, and its rotation as r0 to r8."""
    rest = [c for c in poses.columns if c not in QUAT]
    scaled = poses.select(*rest, *[c.alias(n) for c, n in zip(unit([F.col(q) for q in QUAT]), QUAT, strict=True)])
    return scaled.select(*rest, *[c.alias(f"r{i}") for i, c in enumerate(rotation_of([F.col(q) for q in QUAT]))])


def anchor(track: DataFrame, poses: DataFrame) -> Rigid:
    """The transform that takes the file's first pose to the ground truth at its time: 12 numbers."""
    first = poses.orderBy("row_idx").limit(1)
    if first.isEmpty() or track.isEmpty():
        raise RuntimeError("ground truth and poses must have rows")
    est = rotations(first).first()
    true = poses_at(first.select(F.col("t").alias("ts")), track).first()
    length = math.sqrt(sum(true[q] ** 2 for q in QUAT)) or 1.0
    x, y, z, w = (true[q] / length for q in QUAT)
    r = [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]
    s = [est[f"r{i}"] for i in range(9)]
    turn = [sum(r[3 * i + k] * s[3 * j + k] for k in range(3)) for i in range(3) for j in range(3)]
    move = [true[c] - sum(turn[3 * i + k] * est[XYZ[k]] for k in range(3)) for i, c in enumerate(XYZ)]
    return Rigid(turn, move)


def aligned_cloud(points: DataFrame, rigid: Rigid) -> DataFrame:
    """``move_points`` of a cloud that must have points."""
    if points.isEmpty():
        raise RuntimeError("the cloud to align is empty")
    return move_points(points, rigid)


def move_points(points: DataFrame, rigid: Rigid) -> DataFrame:
    out = apply([F.lit(float(v)) for v in rigid.r], [F.lit(float(v)) for v in rigid.t], [F.col(c) for c in XYZ])
    return points.select(*[c for c in points.columns if c not in XYZ], *[c.alias(n) for c, n in zip(out, XYZ, strict=True)])


def move_poses(poses: DataFrame, rigid: Rigid) -> DataFrame:
    turned = product([F.lit(float(v)) for v in rigid.r], [F.col(f"r{i}") for i in range(9)])
    rows = rotations(poses)
    rows = rows.select(*[c for c in rows.columns if c[0] != "r" or not c[1:].isdigit()], *[c.alias(f"_r{i}") for i, c in enumerate(turned)])
    quat = quaternion_of([F.col(f"_r{i}") for i in range(9)])
    rest = [c for c in poses.columns if c not in (*XYZ, *QUAT)]
    place = apply([F.lit(float(v)) for v in rigid.r], [F.lit(float(v)) for v in rigid.t], [F.col(c) for c in XYZ])
    return rows.select(*rest, *[c.alias(n) for c, n in zip(place, XYZ, strict=True)], *[c.alias(n) for c, n in zip(quat, QUAT, strict=True)])
