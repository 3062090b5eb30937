"""Joins by time: within a tolerance, and as of a time with interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def within_tolerance(frames: DataFrame, times: DataFrame, tolerance: float, ts: str = "frame_ts", t: str = "t", by: Sequence[str] = ()) -> DataFrame:
    """Frames with a time at most ``tolerance`` away (inclusive); frames without a time of their own stay.

    An equi-join on time buckets of twice the tolerance, the times put in three; 0 is equality, below 0 nothing matches.
    ``by`` names columns of both that tell recordings apart (null is a recording too).
    """
    timeless = frames.where(F.col(ts).isNull())
    if tolerance < 0:
        return timeless
    width = F.lit(2.0 * tolerance if tolerance > 0 else 1.0)
    near = times.where(F.col(t).isNotNull()).select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col(t).alias("_t"), F.explode(F.array(*[F.floor(F.col(t) / width) + k for k in (-1, 0, 1)])).alias("_bucket"))
    timed = frames.where(F.col(ts).isNotNull()).withColumn("_bucket", F.floor(F.col(ts) / width))
    same = (timed["_bucket"] == near["_bucket"]) & (F.abs(near["_t"] - timed[ts]) <= tolerance)
    for c in by:
        same = same & timed[c].eqNullSafe(near[f"_of_{c}"])
    kept = timed.join(near, same, "left_semi").drop("_bucket")
    return kept.unionByName(timeless)


def asof_neighbours(queries: DataFrame, track: DataFrame, values: Sequence[str], ts: str = "ts", t: str = "t", tie: str = "row_idx", bucket: float = 3600.0, by: Sequence[str] = ()) -> DataFrame:
    """``queries`` with ``before`` (last track row with t < ts) and ``after`` (first with t >= ts), structs of t and values.

    ``by`` names columns of both that tell recordings apart (null is a recording too); each query sees its own alone.
    Rows of both sides meet in time buckets of ``bucket`` seconds; what a bucket needs from beyond its ends comes from a
    table of one row a bucket. No row is compared with another, and no single task holds the track.
    """
    point = F.struct(F.col(t).cast("double").alias("t"), *values)
    kind = queries.select(F.struct(*queries.columns).alias("q")).schema["q"].dataType
    point_kind = track.select(point.alias("p")).schema["p"].dataType
    of = [f"_of_{i}" for i in range(len(by))]
    keys = [F.col(c).alias(k) for c, k in zip(by, of, strict=True)]
    q = queries.select(*keys, F.struct(*queries.columns).alias("q"), F.lit(None).cast(point_kind).alias("p"), F.col(ts).cast("double").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("tie"))
    p = track.select(*keys, F.lit(None).cast(kind).alias("q"), point.alias("p"), F.col(t).cast("double").alias("at"), F.lit(1).alias("side"), F.col(tie).cast("long").alias("tie"))
    both = q.unionByName(p).withColumn("bucket", F.floor(F.col("at") / bucket))
    # at one time queries come first, so a point at the query's own time is after it
    # both ways as what came so far: Spark works a frame up to the last row out anew at each row
    so_far, order = (W.unboundedPreceding, -1), ("at", "side", "tie")
    ahead, back = (W.partitionBy(*of, "bucket").orderBy(*by_time).rowsBetween(*so_far) for by_time in (order, [F.col(c).desc() for c in order]))
    near = both.withColumn("b", F.last("p", True).over(ahead)).withColumn("a", F.last("p", True).over(back)).where("side = 0")
    key = F.struct("at", "tie")
    ends = both.groupBy(*of, "bucket").agg(F.min_by(F.when(F.col("side") == 1, F.col("p")), F.when(F.col("side") == 1, key)).alias("first"), F.max_by(F.when(F.col("side") == 1, F.col("p")), F.when(F.col("side") == 1, key)).alias("last"))
    along, against = ((W.partitionBy(*of).orderBy(c) if by else W.orderBy(c)).rowsBetween(*so_far) for c in (F.col("bucket"), F.col("bucket").desc()))
    ends = ends.select(*[F.col(k).alias(f"{k}e") for k in of], F.col("bucket").alias("_bucket"), F.last("last", True).over(along).alias("earlier"), F.last("first", True).over(against).alias("later"))
    same = F.col("bucket") == F.col("_bucket")
    for k in of:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}e"))
    return near.join(ends, same).select("q.*", F.coalesce("b", "earlier").alias("before"), F.coalesce("a", "later").alias("after"))


def interpolated(queries: DataFrame, track: DataFrame, values: Sequence[str] = ("x", "y", "z"), ts: str = "ts", **options) -> DataFrame:
    """``queries`` with ``values`` at their time: linear between neighbours, the end's own beyond the ends."""
    near = asof_neighbours(queries, track, values, ts, **options)
    alpha = (F.col(ts) - F.col("before.t")) / (F.col("after.t") - F.col("before.t"))
    out = [F.when(F.col("before").isNull(), F.col(f"after.{v}")).when(F.col("after").isNull(), F.col(f"before.{v}")).otherwise(F.col(f"before.{v}") + alpha * (F.col(f"after.{v}") - F.col(f"before.{v}"))).alias(v) for v in values]
    return near.select(*[c for c in queries.columns if c not in values], *out)
