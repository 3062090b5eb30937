"""Frames of points to one downsampled cloud: keyframes, guard, sensor origin, range, rotation, box, voxels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import in_box, in_range, norm, rotate_z
from ..operators.ordered import batches, disposition, numbered
from ..operators.storage import written
from ..operators.timejoin import interpolated, within_tolerance
from ..operators.voxel import AXES, folded, merged, voxels

Bounds = tuple[float | None, float | None]


@dataclass(frozen=True)
class MergeOptions:
    voxel_size: float
    min_range: float | None = None
    max_range: float | None = None
    crop: Sequence[Bounds] = field(default=((None, None),) * 3)
    rotate_z_deg: float = 0.0
    range_mode: str = "global_origin"
    keyframe_tolerance: float = 0.05
    centroid_guard: bool = True
    guard_radius: float = 0.05
    mode: str = "grid"

    def __post_init__(self):
        if not self.voxel_size > 0:
            raise ValueError("voxel_size must be positive")
        if self.range_mode not in ("global_origin", "sensor_local") or self.mode not in ("grid", "strict"):
            raise ValueError("unknown mode")
        for low, high in ((self.min_range, self.max_range), *self.crop):
            if low is not None and high is not None and low > high:
                raise ValueError("a lower bound is over its upper bound")
        if any(v is not None and v < 0 for v in (self.min_range, self.max_range)):
            raise ValueError("ranges can't be negative")


@dataclass
class Merged:
    cloud: DataFrame
    frames: DataFrame

    def summary(self) -> DataFrame:
        """Frames by disposition, and the points of accepted ones before and after the filters."""
        yes = F.col("disposition") == "accepted"
        return self.frames.groupBy("disposition").agg(F.count(F.lit(1)).alias("n_frames"), F.sum(F.when(yes, F.col("n_points")).otherwise(0)).alias("n_points"), F.sum(F.when(yes, F.col("n_kept")).otherwise(0)).alias("n_kept"))


def merge(points: DataFrame, options: MergeOptions, keyframes: DataFrame | None = None, track: DataFrame | None = None, files: DataFrame | None = None) -> Merged:
    """``points``: path, frame_ts, x, y, z, and optionally a viewpoint vx, vy, vz; ``files`` names frames without points.

    The order is range (about the sensor's origin, in unturned coordinates), rotation, box. The origin is the
    trajectory at the frame's time, else the viewpoint, else zero. It is an error if no frame is accepted.
    """
    o = options
    columns = ["path", "frame_ts", *[c for c in ("vx", "vy", "vz") if c in points.columns]]
    raw = points.groupBy("path").agg(*[F.first(c).alias(c) for c in columns[1:]], F.count(F.lit(1)).alias("n_points"), *[F.avg(a).alias(f"c{a}") for a in AXES])
    if files is not None:
        raw = files.select("path", F.col("frame_ts").alias("_ts")).join(raw, "path", "left").withColumn("frame_ts", F.coalesce("frame_ts", "_ts")).drop("_ts").fillna(0, ["n_points"])
    frames = numbered(raw, "path", "frame_idx")
    use_times = keyframes is not None and not keyframes.isEmpty()
    if use_times:
        near = within_tolerance(frames.select("path", "frame_ts"), keyframes, o.keyframe_tolerance).select("path").distinct().withColumn("is_key", F.lit(True))
        frames = frames.join(near, "path", "left").fillna(False, ["is_key"])
    else:
        frames = frames.withColumn("is_key", F.lit(True))
    origin = [F.lit(0.0)] * 3
    ranged = o.min_range is not None or o.max_range is not None
    if ranged and o.range_mode == "sensor_local":
        fall = [F.coalesce(F.col(f"v{a}"), F.lit(0.0)) if "vx" in columns else F.lit(0.0) for a in AXES]
        if track is not None and not track.isEmpty():
            at = interpolated(frames.where(F.col("frame_ts").isNotNull()).select("path", F.col("frame_ts").alias("ts")), track).select("path", *[F.col(a).alias(f"o{a}") for a in AXES])
            frames = frames.join(at, "path", "left")
            far = norm(*fall) >= 1e-6
            fall = [F.coalesce(F.col(f"o{a}"), F.when(far, v).otherwise(F.lit(0.0))) for a, v in zip(AXES, fall, strict=True)]
        frames = frames.select("*", *[v.alias(f"s{a}") for a, v in zip(AXES, fall, strict=True)])
        origin = [F.col(f"s{a}") for a in AXES]
    else:
        frames = frames.select("*", *[F.lit(0.0).alias(f"s{a}") for a in AXES])
        origin = [F.col(f"s{a}") for a in AXES]
    frames = written(frames, "frames")
    rows = points.select("path", *AXES).join(frames.where("is_key").select("path", "frame_idx", *[f"s{a}" for a in AXES]), "path")
    rows = rows.where(in_range(norm(*[F.col(a) - c for a, c in zip(AXES, origin, strict=True)]), o.min_range, o.max_range))
    x, y = rotate_z(F.col("x"), F.col("y"), o.rotate_z_deg)
    rows = rows.select("path", "frame_idx", x.alias("x"), y.alias("y"), "z").where(in_box([F.col(a) for a in AXES], o.crop))
    kept = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_kept"))
    frames = frames.join(kept, "path", "left").fillna(0, ["n_kept"]).withColumn("centroid_norm", norm(F.col("cx"), F.col("cy"), F.col("cz")))
    frames = written(disposition(frames, F.col("is_key"), o.guard_radius, o.centroid_guard), "frames")
    accepted = frames.where("disposition = 'accepted'").select("path", "frame_idx")
    if accepted.isEmpty():
        raise RuntimeError("no frame has points left after the filters")
    rows = rows.join(accepted.select("path"), "path", "left_semi")
    each = voxels(rows, (o.voxel_size,) * 3, by=("frame_idx",))
    if o.mode == "grid":
        return Merged(merged(each).select(*AXES), frames)
    in_batches = each.join(batches(accepted, "frame_idx").select("frame_idx", "batch"), "frame_idx")
    return Merged(folded(in_batches, "batch", o.voxel_size), frames)
