"""The nearest obstacle of every point, by an adaptive partition of the obstacles' space.

Obstacles are cut into cells along their own quantiles, sixteen to a cell and level, until a cell has at most ``LEAF`` of
them; each cell knows the box that its obstacles fill. Points go down this tree by joins on the parent cell, and take
along only the cells that can hold their nearest obstacle: a box's nearest place must not lie farther than the
farthest that some box's nearest obstacle can lie (each face of a box touches an obstacle). The first leaf's obstacles then
bound the distance, and the leaves within that bound are compared. So neither far points nor dense ones meet all obstacles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import is_finite
from .storage import drop_written, written

AXES = ("x", "y", "z")
#: Obstacles of a leaf. Cells are numbered with four bits a level, below a leading one.
LEAF, LEVELS = 16, 15
_CUTS = 14


@dataclass
class Cells:
    """``levels`` of ``node, up`` (the cell above) and its box; ``leaves`` are the obstacles with their last cell."""

    levels: list[DataFrame]
    leaves: DataFrame

    def drop(self) -> None:
        drop_written(*self.levels, self.leaves)


def finite(columns: tuple[str, ...] = AXES) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & is_finite(F.col(c)) for c in columns])


def _boxes(rows: DataFrame) -> DataFrame:
    bounds = [f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    cuts = [F.percentile_approx(a, [(i + 1) / (_CUTS + 1) for i in range(_CUTS)], 200).alias(f"cuts{a}") for a in AXES]
    return rows.groupBy("node", "up").agg(F.count(F.lit(1)).alias("n"), *bounds, *cuts)


def cells(obstacles: DataFrame, leaf: int = LEAF) -> Cells:
    """The tree over the distinct finite obstacles. A cell that holds too many after ``LEVELS`` levels stays a leaf as it is."""
    rows = written(obstacles.where(finite()).select(*[F.col(a).cast("double").alias(a) for a in AXES]).distinct().select("*", F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("up")), "obstacles")
    levels = []
    for depth in range(LEVELS + 1):
        boxes = written(_boxes(rows), "cells")
        levels.append(boxes.select("node", "up", *[f"{n}{a}" for a in AXES for n in ("lo", "hi")]))
        large = boxes.where(F.col("n") > leaf)
        if depth == LEVELS or large.isEmpty():
            return Cells(levels, rows)
        # along the widest side; the middle of the box is a cut too, so both of its halves get smaller
        side = F.greatest(*[F.struct((F.col(f"hi{a}") - F.col(f"lo{a}")).alias("width"), F.lit(i).alias("axis"), F.col(f"cuts{a}").alias("cuts"), ((F.col(f"hi{a}") + F.col(f"lo{a}")) / 2).alias("middle")) for i, a in enumerate(AXES)])
        plan = large.select(F.col("node").alias("_of"), side.alias("side")).select("_of", "side.axis", F.array_distinct(F.array_append("side.cuts", F.col("side.middle"))).alias("cuts"))
        at = F.get(F.array(*AXES), F.col("axis"))
        child = F.col("node") * 16 + F.size(F.filter("cuts", lambda c: c < at))
        down = rows.join(plan, F.col("node") == F.col("_of"), "left").select(*AXES, F.when(F.col("_of").isNull(), F.col("node")).otherwise(child).alias("node"), F.col("node").alias("up"))
        deeper = written(down, "obstacles")
        drop_written(rows)
        rows = deeper
    raise AssertionError("the last level returns")


def _near() -> Column:
    """Square of the distance from a point to a box."""
    d = [F.greatest(F.col(f"lo{a}") - F.col(f"p{a}"), F.col(f"p{a}") - F.col(f"hi{a}"), F.lit(0.0)) for a in AXES]
    return reduce(lambda x, y: x + y, [v * v for v in d])


def _far() -> Column:
    """Square of the distance within which a box surely has an obstacle: one lies on the nearer face of some side."""
    p = [(F.col(f"p{a}"), F.col(f"lo{a}"), F.col(f"hi{a}")) for a in AXES]
    face = [F.least(F.abs(x - lo), F.abs(x - hi)) for x, lo, hi in p]
    edge = [F.greatest(F.abs(x - lo), F.abs(x - hi)) for x, lo, hi in p]
    return F.least(*[reduce(lambda x, y: x + y, [(face[i] if i == k else edge[i]) * (face[i] if i == k else edge[i]) for i in range(3)]) for k in range(3)])


_PLACE = [f"p{a}" for a in AXES]
#: Squares are compared with room for their rounding.
_ROOM = 1 + 1e-12


def candidates(points: DataFrame, tree: Cells) -> DataFrame:
    """``px, py, pz, node, near``: the leaves that may hold the nearest obstacle of each distinct finite place."""
    asks = points.where(finite()).select(*[F.col(a).cast("double").alias(f"p{a}") for a in AXES]).distinct().withColumn("node", F.lit(0).cast("long"))
    for level in tree.levels:
        asks = asks.join(level.withColumnRenamed("node", "_node"), F.col("node") == F.col("up")).select(*_PLACE, F.col("_node").alias("node"), _near().alias("near"), _far().alias("far"))
        asks = asks.withColumn("reach", F.min("far").over(W.partitionBy(*_PLACE))).where(F.col("near") <= F.col("reach") * _ROOM)
    return asks.select(*_PLACE, "node", "near")


def _compared(asks: DataFrame, tree: Cells) -> DataFrame:
    """Each candidate leaf's obstacles beside the place, with the square of their distance."""
    d = reduce(lambda x, y: x + y, [(F.col(a) - F.col(f"p{a}")) * (F.col(a) - F.col(f"p{a}")) for a in AXES])
    return asks.join(tree.leaves.drop("up"), "node").withColumn("square", d)


def compared(points: DataFrame, tree: Cells) -> DataFrame:
    """All pairs of a place and an obstacle whose distance is worked out: those of the nearest leaf, then those within its bound."""
    asks = written(candidates(points, tree), "asks")
    first = asks.groupBy(*_PLACE).agg(F.min(F.struct("near", "node")).alias("best")).select(*_PLACE, F.col("best.node").alias("node"))
    reached = written(_compared(first, tree).groupBy(*_PLACE, "node").agg(F.min("square").alias("square")), "reached")
    bound = reached.select(*[F.col(c).alias(f"_{c}") for c in _PLACE], F.col("node").alias("_node"), F.col("square").alias("bound"))
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in _PLACE])
    rest = asks.join(bound, same).where((F.col("near") <= F.col("bound") * _ROOM) & (F.col("node") != F.col("_node"))).select(*_PLACE, "node")
    return reached.select(*_PLACE, "square").unionByName(_compared(rest, tree).select(*_PLACE, "square"))


def nearest_distance(points: DataFrame, obstacles: DataFrame, name: str = "clearance_radius") -> DataFrame:
    """``points`` with the distance to their nearest obstacle.

    Null for a point without finite coordinates, and for all if there is no finite obstacle. Obstacles without finite
    coordinates are passed over. Repeated points each get it; other columns stay, one called ``name`` is replaced.
    """
    points = points.drop(name)
    tree = cells(obstacles)
    best = written(compared(points, tree).groupBy(*_PLACE).agg(F.sqrt(F.min("square")).alias(name)), "nearest")
    tree.drop()
    return points.join(best, reduce(lambda x, y: x & y, [F.col(a) == F.col(f"p{a}") for a in AXES]), "left").select(*points.columns, name)
