"""Undirected graphs: degrees and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_written, written


def neighbours(edges: DataFrame) -> DataFrame:
    """``u, v`` both ways, each once; a self-loop is its own neighbour."""
    there = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    return there.unionByName(there.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree`` of every distinct node."""
    n = neighbours(edges).groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").distinct().join(n, F.col("id") == F.col("u"), "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def linked(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node that has a link to another; the component is its smallest node.

    Large-star and small-star steps in turn. Each round's table is written once to the shared folder; rounds grow with
    the logarithm of the largest component. A node with very many neighbours keeps one of them after the first steps.
    """
    a, b = F.col(a), F.col(b)
    edges = written(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    before = mark(edges)
    while before[0]:
        new = written(_small(_large(edges)), "edges")
        drop_written(edges)
        edges, after = new, mark(new)
        if after == before:
            break
        before = after
    # settled edges are stars around each component's smallest node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id that can be reached) of every distinct node; ends outside ``nodes`` don't count."""
    found = linked(edges, "source", "target")
    return nodes.select("id").distinct().join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
