"""Rigid motion as column expressions: quaternions (x, y, z, w), rotations (nine numbers by row), transforms, slerp."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Cols = Sequence[Column]


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def in_range(distance: Column, low: float | None, high: float | None) -> Column:
    """Inclusive bounds, either open; a distance that is NaN is out as soon as there is a bound."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (distance >= F.lit(float(low)))
    if high is not None:
        keep = keep & (distance <= F.lit(float(high)))
    return keep & ~F.isnan(distance) if low is not None or high is not None else keep


def in_box(point: Cols, bounds: Sequence[tuple[float | None, float | None]]) -> Column:
    """Each axis within its inclusive bounds."""
    keep = F.lit(True)
    for c, (low, high) in zip(point, bounds, strict=True):
        keep = keep & in_range(c, low, high)
    return keep


def rotate_z(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    if abs(degrees) < 1e-12:
        return x, y
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return F.lit(c) * x - F.lit(s) * y, F.lit(s) * x + F.lit(c) * y


def unit(q: Cols) -> list[Column]:
    """The normalised quaternion; all zeros for the zero quaternion."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return [F.when(n == 0, F.lit(0.0)).otherwise(c / n) for c in q]


def rotation_of(q: Cols) -> list[Column]:
    """Nine numbers of a unit quaternion's rotation (see ``unit``); all zeros are no rotation."""
    x, y, z, w = q
    full = [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]
    return full


def quaternion_of(r: Cols) -> list[Column]:
    """The quaternion of a rotation whose w (trace over 0) or else largest component is positive."""
    trace = r[0] + r[4] + r[8]
    sw = F.sqrt(F.greatest(trace + 1, F.lit(0.0))) * 2
    sx = F.sqrt(F.greatest(1 + r[0] - r[4] - r[8], F.lit(0.0))) * 2
    sy = F.sqrt(F.greatest(1 + r[4] - r[0] - r[8], F.lit(0.0))) * 2
    sz = F.sqrt(F.greatest(1 + r[8] - r[0] - r[4], F.lit(0.0))) * 2
    by_w = [(r[7] - r[5]) / sw, (r[2] - r[6]) / sw, (r[3] - r[1]) / sw, sw / 4]
    by_x = [sx / 4, (r[1] + r[3]) / sx, (r[2] + r[6]) / sx, (r[7] - r[5]) / sx]
    by_y = [(r[1] + r[3]) / sy, sy / 4, (r[5] + r[7]) / sy, (r[2] - r[6]) / sy]
    by_z = [(r[2] + r[6]) / sz, (r[5] + r[7]) / sz, sz / 4, (r[3] - r[1]) / sz]
    return [
        F.when(trace > 0, by_w[i]).when((r[0] > r[4]) & (r[0] > r[8]), by_x[i]).when(r[4] > r[8], by_y[i]).otherwise(by_z[i]) for i in range(4)
    ]


def apply(r: Cols, t: Cols, p: Cols) -> list[Column]:
    """R p + t."""
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def product(a: Cols, b: Cols) -> list[Column]:
    """The product of two rotations."""
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    """(1 - alpha) a + alpha b."""
    return (1 - alpha) * a + alpha * b


def dot(a: Cols, b: Cols) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def slerp_weights(cosine: Column, alpha: Column) -> tuple[Column, Column]:
    """Weights of two unit quaternions with this dot product, on the shorter arc; nearly equal ones linearly."""
    sign = F.when(cosine < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    near = F.abs(cosine) > 0.9995
    theta = F.acos(F.least(F.abs(cosine), F.lit(1.0)))
    first = F.when(near, 1 - alpha).otherwise(F.sin((1 - alpha) * theta) / F.sin(theta))
    second = F.when(near, alpha).otherwise(F.sin(alpha * theta) / F.sin(theta))
    return first, sign * second
