"""Text tables: trajectory CSV, pose lines, keyframe times; each loader's policy for bad rows is a visible filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_finite

#: Fixed value: the comment line of a pose file.
POSE_HEADER = "#timestamp x y z qx qy qz qw id"
TRAJECTORY = ("t", "x", "y", "z", "qx", "qy", "qz", "qw")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file in file order (``row_idx`` ascends with it)."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("row_idx"), "value")


def read_trajectory(spark: SparkSession, path: str, poses: bool = False) -> DataFrame:
    """``row_idx, t, x, y, z`` (with ``poses`` also the quaternion) of a CSV file; its header is skipped.

    Positions: rows with a field that is no number go. Poses: rows of under 8 fields go, any other bad number raises.
    """
    parts = F.split("value", ",")
    rows = _lines(spark, path).where("row_idx > 0 AND trim(value) <> ''")
    if poses:
        rows = rows.where(F.size(parts) >= 8)
        return rows.select("row_idx", *[F.trim(F.get(parts, F.lit(i))).cast("double").alias(c) for i, c in enumerate(TRAJECTORY)])
    out = rows.select("row_idx", *[F.trim(F.get(parts, F.lit(i))).try_cast("double").alias(c) for i, c in enumerate(TRAJECTORY[:4])])
    return out.dropna()


def read_named_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx, t, x, y, z`` of a CSV file by its header's names, whatever their order; a missing name is an error.

    A file without rows, or with a position that is no finite number, is an error too.
    """
    found = spark.read.option("header", True).csv(path)
    lacking = [c for c in TRAJECTORY[:4] if c not in found.columns]
    if lacking:
        raise ValueError(f"{path} lacks the columns {lacking}")
    rows = found.select(F.monotonically_increasing_id().alias("row_idx"), *[F.trim(c).try_cast("double").alias(c) for c in TRAJECTORY[:4]])
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z")))).alias("bad")).first()
    if not told["n"] or told["bad"]:
        raise ValueError(f"{path} has {told['n']} rows, {told['bad']} of them without a finite position")
    return rows


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx``, the eight numbers and ``pid`` (-1 if absent) of white-space separated lines, in file order."""
    rows = _lines(spark, path).select("row_idx", F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    parts = F.split("v", " ")
    rows = rows.where(F.size(parts) >= 8)
    return rows.select("row_idx", *[F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in enumerate(TRAJECTORY)], F.coalesce(F.get(parts, F.lit(8)).cast("int"), F.lit(-1)).alias("pid"))


def read_keyframe_times(spark: SparkSession, path: str) -> DataFrame:
    """The first number of each line; lines that begin with # or with no number go."""
    first = F.get(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), F.lit(0)).try_cast("double")
    return _lines(spark, path).where("NOT startswith(value, '#')").select(first.alias("t")).dropna()


def write_trajectory(df: DataFrame, path: str) -> None:
    """One CSV file with a header, by time; a trajectory is one file by its format."""
    df.select(*TRAJECTORY).coalesce(1).sortWithinPartitions("t").write.mode("overwrite").option("header", True).csv(path)


def pose_line(columns: Sequence[str], pid: str) -> Column:
    """Numbers at six decimals, then the id."""
    return F.concat_ws(" ", *[F.format_string("%.6f", F.col(c)) for c in columns], F.col(pid).cast("string"))


def write_poses(df: DataFrame, path: str) -> None:
    """One text file with a comment line first, in row order; a list of poses is one file by its format."""
    lines = df.select("row_idx", pose_line(TRAJECTORY, "pid").alias("value"))
    head = df.sparkSession.range(1).select(F.lit(None).cast("long").alias("row_idx"), F.lit(POSE_HEADER).alias("value"))
    head.unionByName(lines).coalesce(1).sortWithinPartitions(F.col("row_idx").asc_nulls_first()).select("value").write.mode("overwrite").text(path)


def resolve_output(path: str, fmt: str = "auto") -> str:
    """``path`` with the suffix of ``fmt``; as it is for auto or if it has that suffix already."""
    if fmt == "auto" or path.lower().endswith(f".{fmt}"):
        return path
    stem, dot, _ = path.rpartition(".")
    return f"{stem if dot and '/' not in path[len(stem):] else path}.{fmt}"
