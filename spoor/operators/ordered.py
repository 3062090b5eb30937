"""Order-dependent operators of a log: consecutive duplicates, batches, the corruption guard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written


def changes(log: DataFrame, values: Sequence[str], order: Sequence[str], by: Sequence[str] = (), bucket: float = 600e9) -> DataFrame:
    """Rows whose values differ from the row before in their log (``by``); a value of NaN differs from anything.

    The log is cut into buckets of the first column of ``order`` (nanoseconds, ten minutes each, by default). What a
    bucket's first row needs from before comes from a table of one row a bucket, so no task holds a whole log.
    """
    now = F.struct(*values)
    rows = log.withColumn("_bucket", F.floor(F.col(order[0]) / F.lit(bucket)))
    keys = [*by, "_bucket"]
    fresh = F.lit(False)
    for c in values:
        if log.schema[c].dataType.simpleString() in ("double", "float"):
            fresh = fresh | F.coalesce(F.isnan(c), F.lit(False))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(now.alias("v")), F.struct(*order)).alias("_last"))
    along = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_bucket")
    carried = last.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.lag("_last").over(along).alias("_carried"))
    marked = rows.withColumn("_lag", F.lag(F.struct(now.alias("v"))).over(W.partitionBy(*keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    both = marked.join(carried, reduce(lambda x, y: x & y, same), "left").withColumn("_before", F.coalesce("_lag", "_carried"))
    return both.where(F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(now) | fresh).select(*log.columns)


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``name``: each row's place in the order of a column without equal values, from 0.

    Rows are dealt by ranges of the column, once, into a written table; a range's first number comes from a table of one row a range.
    """
    split = written(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = split.groupBy("_p").agg(F.count(F.lit(1)).alias("c"))
    before = before.select(F.col("_p").alias("_of"), F.coalesce(F.sum("c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1
    return split.join(F.broadcast(before), F.col("_p") == F.col("_of")).withColumn(name, place.cast("long")).drop("_p", "_of", "_start")


def batches(accepted: DataFrame, order: str, size: int = 20) -> DataFrame:
    """``batch`` of each accepted frame, ``size`` to a batch."""
    return numbered(accepted, order, "_place").withColumn("batch", F.floor(F.col("_place") / size).cast("long")).drop("_place")


def disposition(frames: DataFrame, is_keyframe: Column, radius: float = 0.05, guard: bool = True) -> DataFrame:
    """What becomes of each frame: ``frame_idx, n_points, n_kept, centroid_norm`` and the keyframe test decide.

    The guard drops a frame with index over 5 whose centroid is within ``radius`` once an earlier one was accepted.
    It can't fire before the first acceptance, so that is the first frame that passes all other tests.
    """
    passes = is_keyframe & (F.col("n_points") > 0) & (F.col("n_kept") > 0)
    first = frames.agg(F.min(F.when(passes, F.col("frame_idx"))).alias("_first"))
    rows = frames.join(F.broadcast(first))  # one row
    fires = F.lit(guard) & (F.col("frame_idx") > 5) & (F.col("frame_idx") > F.col("_first")) & (F.col("centroid_norm") < radius)
    out = (
        F.when(~is_keyframe, "not_keyframe")
        .when(F.col("n_points") == 0, "empty")
        .when(F.coalesce(fires, F.lit(False)), "centroid_guard")
        .when(F.col("n_kept") == 0, "after_filters")
        .otherwise("accepted")
    )
    return rows.withColumn("disposition", out).drop("_first")
