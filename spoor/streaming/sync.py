"""Approximate time synchronisation of two streams of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bucket(t: str, slop: float):
    return F.floor(F.col(t).cast("double") / F.lit(2.0 * slop if slop > 0 else 1.0))


def matched(left: DataFrame, right: DataFrame, slop: float, late: str = "10 seconds", by: Sequence[str] = (), t: str = "t") -> DataFrame:
    """Every left row with the right row nearest in time, at most ``slop`` seconds apart (ties: the earlier, then the least).

    Both have a timestamp ``t`` and ``by``; the other columns come as structs ``left`` and ``right``. On streams this is an
    interval join with watermarks on both sides, ``late`` behind: rows later than that are dropped, and state is let go when the
    watermark has passed. A left row's match is told when the watermark passes its time, so nothing nearer can come. On
    tables it is the same join. Rows without time match nothing; equal left rows are one.
    """
    if slop < 0:
        raise ValueError("the slop can't be negative")
    here = left.where(F.col(t).isNotNull()).withWatermark(t, late).select(*by, F.col(t).alias("_t"), F.struct(*left.columns).alias("left"), _bucket(t, slop).alias("_bucket"))
    there = right.where(F.col(t).isNotNull()).withWatermark(t, late).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(t).alias("_u"), F.struct(*right.columns).alias("right"), F.explode(F.array(*[_bucket(t, slop) + k for k in (-1, 0, 1)])).alias("_near"))
    span = F.expr(f"INTERVAL {slop:.6f} SECONDS")
    on = (F.col("_bucket") == F.col("_near")) & (F.col("_u") >= F.col("_t") - span) & (F.col("_u") <= F.col("_t") + span)
    for c in by:
        on = on & (F.col(c) == F.col(f"_by_{c}"))
    pairs = here.join(there, on)
    apart = F.abs(F.unix_micros("_t") - F.unix_micros("_u"))
    best = pairs.groupBy(*by, "_t", "left").agg(F.min(F.struct(apart.alias("apart"), F.col("_u").alias("u"), "right")).alias("best"))
    return best.select(*by, F.col("_t").alias(t), "left", "best.right", (F.col("best.apart") / F.lit(1e6)).alias("apart"))
