"""Ground truth trajectory and topic profile of a message log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import frame_name, shortened, stamp_seconds
from ..operators.ordered import changes

POSE = ("x", "y", "z", "qx", "qy", "qz", "qw")


def extract(messages: DataFrame, parent: str = "root", child: str = "base_link", topic: str = "/tf") -> DataFrame:
    """``t`` and the pose each time it changes, from decoded messages (``transforms``), by log."""
    by = [c for c in ("traj_id",) if c in messages.columns]
    rows = messages.where(F.col("topic") == topic).select(*by, "log_ts_ns", "seq", F.posexplode("transforms").alias("pos", "tr"))
    rows = rows.where((frame_name(F.col("tr.frame_id")) == parent) & (frame_name(F.col("tr.child_frame_id")) == child))
    rows = rows.select(*by, "log_ts_ns", "seq", "pos", stamp_seconds(F.col("tr.sec"), F.col("tr.nanosec"), F.col("log_ts_ns")).alias("t"), *[F.col(f"tr.{c}") for c in POSE])
    return changes(rows, POSE, ("log_ts_ns", "seq", "pos"), by).select(*by, "t", *POSE)


def profile(messages: DataFrame, connections: DataFrame, max_example_chars: int = 500) -> DataFrame:
    """Every topic's connections, types, and its first message, of any type, as a preview (an error's text where it can't be read)."""
    preview = F.coalesce(F.to_json("value"), F.concat(F.lit("<"), F.col("error"), F.lit(">")), F.lit("<undecoded>"))
    first = messages.groupBy("topic").agg(F.min_by(F.struct("log_ts_ns", preview.alias("text")), F.struct("log_ts_ns", "seq")).alias("m"))
    topics = connections.groupBy("topic").agg(F.count(F.lit(1)).alias("n_connections"), F.sort_array(F.collect_set("msgtype")).alias("msgtypes"))
    return topics.join(first, "topic", "left").select("topic", "n_connections", "msgtypes", (F.col("m.log_ts_ns") / F.lit(1e9)).alias("first_t"), shortened(F.col("m.text"), max_example_chars).alias("example"))
