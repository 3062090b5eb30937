"""Even thinning: a set of points no two of which are within a radius, and near enough to every point that it leaves out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import norm
from .nearest import AXES, finite
from .spatial import CELL, _around, _in_cells
from .storage import drop_written, written

_FINE = ("fx", "fy", "fz")


def _distance() -> Column:
    return norm(*[F.col(a) - F.col(f"o{a}") for a in AXES])


def thin(points: DataFrame, radius: float, priority: Column, key: Sequence[str]) -> DataFrame:
    """Rows of ``points`` (``x, y, z``) more than ``radius`` apart, such that each left-out row has a kept one within it.

    Cells have a diagonal of one radius, so a cell keeps one point at most. In each round a cell's first point by ``priority``
    (ties: by ``key``, which names a row) is kept if it comes before those of all cells within the radius; points within the
    radius of a kept one go. What is kept follows from priorities and places alone, not from how rows are dealt. Every
    round keeps at least the first point of each neighbourhood, and few are needed. Points without finite coordinates go.
    """
    if not radius > 0:
        raise ValueError("the radius must be positive")
    size, fine = radius * (1 + 1e-9), radius / 3**0.5 * (1 - 1e-9)
    rank = F.struct(priority.alias("p"), *key)
    rows = points.where(finite()).select(*points.columns, rank.alias("_rank"), *[F.floor(F.col(a) / F.lit(fine)).alias(f) for f, a in zip(_FINE, AXES, strict=True)])
    whole = left = written(rows, "left")
    kept = []
    while not left.isEmpty():
        first = left.groupBy(*_FINE).agg(F.min(F.struct("_rank", *AXES)).alias("f")).select("f._rank", *[f"f.{a}" for a in AXES])
        first = written(first, "first")
        other = first.select(F.col("_rank").alias("_other"), *[F.col(a).alias(f"o{a}") for a in AXES])
        met = _around(first, size).join(_in_cells(other, size, "o"), list(CELL)).where((F.col("_other") < F.col("_rank")) & (_distance() <= radius))
        won = written(first.join(met.select("_rank").distinct(), "_rank", "left_anti"), "won")
        near = _around(won.select(*[F.col(a).alias(f"o{a}") for a in AXES]), size, "o")
        gone = _in_cells(left.select("_rank", *AXES), size).join(near, list(CELL)).where(_distance() <= radius).select("_rank").distinct()
        rest = written(left.join(gone, "_rank", "left_anti"), "left")
        drop_written(first, *([left] if kept else []))
        kept.append(won.select("_rank"))
        left = rest
    return whole.join(reduce(DataFrame.unionByName, kept), "_rank", "left_semi").select(*points.columns) if kept else points.limit(0)
