"""Spatial joins on a grid: pairs within a radius, the nearest point, segments free of obstacles."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import norm
from .nearest import AXES, finite, nearest_distance

__all__ = ["AXES", "collision_free", "nearest_distance", "pairs_within"]


def _cell(size: float, prefix: str = "") -> list[Column]:
    return [F.floor(F.col(prefix + a) / F.lit(size)) for a in AXES]


CELL = ("cx", "cy", "cz")
#: The cell itself and half of the 26 around it: of two neighbouring cells one sees the other.
_AHEAD = [s for s in product((-1, 0, 1), repeat=3) if s >= (0, 0, 0)]


def _in_cells(df: DataFrame, size: float, prefix: str = "", steps: list[tuple[int, ...]] | None = None) -> DataFrame:
    """Each row in its own cell, or once in each of the cells at ``steps`` from it, as cx, cy, cz."""
    cells = _cell(size, prefix)
    if steps is None:
        return df.withColumns(dict(zip(CELL, cells, strict=True)))
    around = F.array(*[F.struct(*[(c + k).alias(n) for n, c, k in zip(CELL, cells, s, strict=True)]) for s in steps])
    return df.select("*", F.inline(around))


def _around(df: DataFrame, size: float, prefix: str = "") -> DataFrame:
    """Each row once in its own and the 26 cells about it."""
    return _in_cells(df, size, prefix, list(product((-1, 0, 1), repeat=3)))


def pairs_within(points: DataFrame, radius: float) -> DataFrame:
    """``source, target, weight``: pairs of ``id, x, y, z`` rows at most ``radius`` apart, source < target.

    A row is put in its own cell and 13 neighbours; the other half of the neighbours see it. Rows of one cell meet once, by id.
    """
    size = radius * (1 + 1e-9) if radius > 0 else 1.0
    points = points.where(finite())
    own = [c.alias(f"o{n}") for n, c in zip(CELL, _cell(size), strict=True)]
    a = _in_cells(points.select("id", *AXES, *own), size, steps=_AHEAD)
    b = _in_cells(points.select(F.col("id").alias("other"), *[F.col(c).alias(f"t{c}") for c in AXES]), size, "t")
    d = norm(*[F.col(c) - F.col(f"t{c}") for c in AXES])
    same = reduce(lambda x, y: x & y, [F.col(n) == F.col(f"o{n}") for n in CELL])
    met = a.join(b, list(CELL)).where((d <= radius) & F.when(same, F.col("id") < F.col("other")).otherwise(F.col("id") != F.col("other")))
    return met.select(F.least("id", "other").alias("source"), F.greatest("id", "other").alias("target"), d.alias("weight"))


def collision_free(edges: DataFrame, obstacles: DataFrame, step: float = 0.2, margin: float = 0.0) -> DataFrame:
    """Edges whose samples all lie farther than ``margin`` from every obstacle.

    Edges have ``source, target, weight``, the ends' coordinates (sx.. and tx..) and clearances (sr, tr). An edge's
    clearance is at least (sr + tr - weight) / 2 everywhere; only edges for which that is not over the margin are
    sampled, every ``step`` at most with both ends, and dropped if a sample has an obstacle in reach. Samples and
    obstacles meet in cells of the margin's size, the fewer of the two copied to the neighbouring cells; with a margin of 0
    they meet by their coordinates.
    """
    if margin < 0:
        return edges
    bound = (F.col("sr") + F.col("tr") - F.col("weight")) / 2
    n = F.greatest(F.lit(2), (F.ceil(F.col("weight") / F.lit(step)) + 1).cast("int"))
    ends = [f"{p}{c}" for p in "st" for c in AXES]
    unsure = edges.where((F.col("weight") > 0) & (bound <= margin + 1e-9)).select("source", "target", *ends, n.alias("_n"))
    at = F.col("_i") / (F.col("_n") - 1)
    samples = unsure.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    samples = samples.select("source", "target", *[(F.col(f"s{c}") + at * (F.col(f"t{c}") - F.col(f"s{c}"))).alias(c) for c in AXES])
    walls = obstacles.where(finite()).select(*[F.col(c).alias(f"o{c}") for c in AXES])
    if margin == 0:
        hit = samples.join(walls, reduce(lambda x, y: x & y, [F.col(c) == F.col(f"o{c}") for c in AXES]), "left_semi")
    else:
        size = margin * (1 + 1e-9)
        few = walls.count() <= (unsure.agg(F.sum("_n")).first()[0] or 0)
        met = (_in_cells(samples, size) if few else _around(samples, size)).join(_around(walls, size, "o") if few else _in_cells(walls, size, "o"), list(CELL))
        hit = met.where(norm(*[F.col(c) - F.col(f"o{c}") for c in AXES]) <= margin)
    return edges.join(hit.select("source", "target").distinct(), ["source", "target"], "left_anti")
