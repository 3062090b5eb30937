"""Voxel downsampling of point clouds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_written, new_path, written

AXES = ("x", "y", "z")


def voxels(points: DataFrame, size: Sequence[float], by: Sequence[str] = (), origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """One centroid for each occupied cell (``vx, vy, vz``) of a grid with a fixed origin, for each of ``by``."""
    cells = [F.floor((F.col(a) - F.lit(float(o))) / F.lit(float(s))).cast("long").alias(f"v{a}") for a, s, o in zip(AXES, size, origin, strict=True)]
    return points.groupBy(*by, *cells).agg(*[F.avg(a).alias(a) for a in AXES], F.count(F.lit(1)).alias("n"))


def merged(per_frame: DataFrame) -> DataFrame:
    """The centroids of the frames' centroids. A cell is convex, so a centroid's cell is the one it came from."""
    return per_frame.groupBy("vx", "vy", "vz").agg(*[F.avg(a).alias(a) for a in AXES])


def folded(per_frame: DataFrame, batch: str, size: float) -> DataFrame:
    """Strict folding: after each batch of frames the cloud so far is downsampled again, on a grid from its own corner.

    One round a batch, in order; ``per_frame`` are the frames' centroids, which are worked out once and written by batch,
    so that a round reads its own batch alone. Of the clouds so far only the last is kept.
    """
    spark = per_frame.sparkSession
    path = new_path(spark, "frames")
    per_frame.select(F.col(batch).alias("_batch"), *AXES).write.partitionBy("_batch").parquet(path)
    frames = spark.read.parquet(path)
    cloud = None
    for (k,) in sorted(frames.select("_batch").distinct().collect()):
        part = frames.where(F.col("_batch") == k).select(*AXES)
        both = part if cloud is None else cloud.unionByName(part)
        low = both.agg(*[F.min(a).alias(a) for a in AXES]).first()
        folded_in = written(voxels(both, (size,) * 3, origin=[low[a] - size / 2 for a in AXES]).select(*AXES), "cloud")
        if cloud is not None:
            drop_written(cloud)
        cloud = folded_in
    return cloud
