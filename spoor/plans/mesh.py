"""Points spread over a triangle mesh by area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_finite
from ..operators.storage import written
from ..operators.thinning import thin
from ..operators.validation import at_places
from ..operators.voxel import AXES


def _minus(a: str, b: str):
    return [F.col(a)[i] - F.col(b)[i] for i in range(3)]


def sample_surface(faces: DataFrame, n: int = 2_000_000, seed: int = 0, even: bool = True, radius: float | None = None) -> DataFrame:
    """``n`` points of ``face_id, v0, v1, v2`` by area.

    ``even``: three times as many are drawn, points closer than ``radius`` to another are thinned out (by default the
    side of a draw's share of the area), and of what is left ``n`` stay, or all where they are fewer. A face gets its share of the draws
    rounded by a draw, so no count passes through one place; without ``even`` the number is therefore about ``n``. Draws follow from
    the seed, the face and the number of the point, so a task that runs again draws the same.
    """
    a, b = _minus("v1", "v0"), _minus("v2", "v0")
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    sized = faces.withColumn("area", F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2).where(is_finite(F.col("area")))
    total = sized.agg(F.sum("area")).first()[0]
    if not total:
        return faces.select("face_id", *[F.lit(0.0).alias(c) for c in AXES]).limit(0)
    draws = 3 * n if even else n
    draw = lambda *key: F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    count = F.floor(F.col("area") / F.lit(total) * draws + draw("face_id", F.lit("n"))).cast("int")
    each = sized.withColumn("_n", count).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    u, w = F.sqrt(draw("face_id", "_i", F.lit("u"))), draw("face_id", "_i", F.lit("w"))
    points = each.select("face_id", "_i", *[((1 - u) * F.col("v0")[k] + u * (1 - w) * F.col("v1")[k] + u * w * F.col("v2")[k]).alias(c) for k, c in enumerate(AXES)])
    if not even:
        return points.drop("_i")
    order = F.xxhash64(F.lit(seed), "face_id", "_i", F.lit("order"))
    kept = written(thin(points, radius or (total / draws) ** 0.5, order, ("face_id", "_i")).withColumn("_order", order), "kept")
    if kept.count() > n:
        last = at_places(kept, "_order", {"last": n - 1}).first()[0]
        kept = kept.where(F.col("_order") <= last)
    return kept.select("face_id", *AXES)
