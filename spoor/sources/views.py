"""The canonical tables as views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import naive_micros
from ..operators.ordered import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key() -> F.Column:
    return F.get_json_object("props", "$.k").cast("double")


def tf_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of transform messages; topics are event types."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (naive_micros(F.col("ts")) * 1000).alias("log_ts_ns"),
        F.concat(F.lit("/"), "event_type").alias("topic"),
        F.when(F.col("user_id") % 10 < 7, "/root").otherwise("map").alias("frame_id"),
        F.when(F.col("user_id") % 2 == 0, "base_link").otherwise("//imu_frame").alias("child_frame_id"),
        F.col("event_type").isin("view", "click").cast("int").cast("double").alias("x"),
        ((F.col("user_id") % 4) / F.lit(4.0)).alias("y"),
    )


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth: one pose a purchase, with a yaw about z of twice ``h``."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    h = _key() / F.lit(100.0)
    return e.select(
        F.col("event_id").alias("row_idx"),
        (naive_micros(F.col("ts")) / F.lit(1e6)).alias("t"),
        ((F.col("user_id") % 50) / F.lit(10.0)).alias("x"),
        (F.col("value") / F.lit(100.0)).alias("y"),
        (_key() / F.lit(50.0)).alias("z"),
        F.lit(0.0).alias("qx"),
        F.lit(0.0).alias("qy"),
        F.sin(h).alias("qz"),
        F.cos(h).alias("qw"),
    )


def slam_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated poses in file order: one a view."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    h = (F.col("user_id") % 100) / F.lit(200.0)
    return e.select(
        F.col("event_id").alias("row_idx"),
        (naive_micros(F.col("ts")) / F.lit(1e6)).alias("t"),
        (F.col("value") / F.lit(50.0)).alias("x"),
        ((F.col("user_id") % 20) / F.lit(4.0)).alias("y"),
        (_key() / F.lit(25.0)).alias("z"),
        F.lit(0.0).alias("qx"),
        F.lit(0.0).alias("qy"),
        F.sin(h).alias("qz"),
        F.cos(h).alias("qw"),
    )


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.select(F.col("event_id").alias("frame_id"), (naive_micros(F.col("ts")) / F.lit(1e6)).alias("frame_ts"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of frames: a frame is a supplier's line items."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").alias("frame_id"),
        F.concat(F.lit("f"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.lit(".pcd")).alias("path"),
        (F.col("l_suppkey") * F.lit(0.5)).alias("frame_ts"),
        (F.col("l_quantity") - F.lit(25.5)).alias("x"),
        (F.col("l_extendedprice") / F.lit(1000.0) - F.lit(38.0)).alias("y"),
        (F.col("l_discount") * F.lit(100.0) - F.lit(5.0)).alias("z"),
    )


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cloud(spark, sf_dir).where("vec_id % 5 <> 0")
    return numbered(rows.select("vec_id", "x", "y", "z"), "vec_id", "id").select("id", "x", "y", "z")


def obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).where("vec_id % 5 = 0").select("x", "y", "z")


def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[F.get("embedding", F.lit(3 + i)).cast("double").alias(a) for i, a in enumerate(("qx", "qy", "qz", "qw"))])
