"""Proximity graph of a trajectory among obstacles: clearances, adaptive radius, overlapping and free edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.nearest import finite
from ..operators.spatial import AXES, collision_free, nearest_distance, pairs_within
from ..operators.storage import written
from ..operators.validation import interpolated


@dataclass
class Topology:
    nodes: DataFrame
    edges: DataFrame


def finite_points(points: DataFrame) -> DataFrame:
    return points.where(finite())


def adaptive_radius(nodes: DataFrame) -> float:
    """Twice the upper quartile of the clearances; 1 where that is not positive. One number comes to the driver."""
    found = interpolated(nodes, "clearance_radius", 0.75).first()[0]
    return found * 2 if found and found > 0 else 1.0


def candidate_edges(nodes: DataFrame, radius: float) -> DataFrame:
    """Pairs within the radius whose clearance balls touch, with both ends' data."""
    pairs = pairs_within(nodes, radius)
    ends = lambda p: nodes.select(F.col("id").alias({"s": "source", "t": "target"}[p]), *[F.col(c).alias(f"{p}{c}") for c in AXES], F.col("clearance_radius").alias(f"{p}r"))
    return pairs.join(ends("s"), "source").join(ends("t"), "target").where(F.col("weight") <= F.col("sr") + F.col("tr"))


def extract(nodes: DataFrame, obstacles: DataFrame, max_edge_distance: float | None = None, step: float = 0.2, margin: float = 0.0) -> Topology:
    """``nodes`` are ``id, x, y, z``; empty inputs or a pose that isn't finite are errors."""
    bad = nodes.agg(F.count(F.lit(1)), F.count_if(~finite())).first()
    if not bad[0] or bad[1]:
        raise ValueError("the trajectory must have rows, and finite positions")
    free = finite_points(obstacles)
    if free.isEmpty():
        raise ValueError("the cloud has no finite point")
    nodes = written(nearest_distance(nodes, free), "nodes")
    radius = adaptive_radius(nodes) if max_edge_distance is None else max_edge_distance
    edges = collision_free(candidate_edges(nodes, radius), free, step, margin)
    return Topology(nodes, edges.select("source", "target", "weight"))


def to_json(graph: Topology) -> DataFrame:
    """The document as one row; arrays are sorted, so equal graphs give equal text."""
    n = graph.nodes.agg(F.sort_array(F.collect_list(F.struct("id", *AXES, "clearance_radius"))).alias("nodes"))
    e = graph.edges.agg(F.sort_array(F.collect_list(F.struct("source", "target", "weight"))).alias("edges"))
    # two tables of one row each
    return n.join(e, F.lit(True)).select(F.to_json(F.struct("nodes", "edges")).alias("document"))


DOCUMENT = "struct<nodes:array<struct<id:bigint,x:double,y:double,z:double,clearance_radius:double>>,edges:array<struct<source:bigint,target:bigint,weight:double>>>"


def from_json(documents: DataFrame) -> Topology:
    parsed = documents.select(F.from_json("document", DOCUMENT).alias("d"))
    return Topology(parsed.select(F.inline("d.nodes")), parsed.select(F.inline("d.edges")))
