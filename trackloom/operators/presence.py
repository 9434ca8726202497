"""Presence of tracks over a camera's frames.

A track's state lives as long as the track is seen in every frame of its camera.
Segments number those stretches; all operators with state partition by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

TRACK = ("camera_name", "track_id")


def with_segments(tracks: DataFrame, clock: str = "frame_idx") -> DataFrame:
    """Adds ``seg``: equal for the rows of one stretch of consecutive frames. ``clock`` counts every frame, empty ones too."""
    return tracks.withColumn("seg", F.col(clock) - F.row_number().over(Window.partitionBy(*TRACK).orderBy(clock)))


def with_nonempty_clock(tracks: DataFrame, stretch: int = 100_000) -> DataFrame:
    """Adds ``tick``, which counts only the camera's frames that have detections.

    The frames are numbered once for each camera, without their detections, and
    joined back, so no window holds a camera's detections. They are numbered
    within stretches of frames, and the stretches' counts are carried over a
    small table, so no window holds all frames of a camera either.
    """
    frames = tracks.select("camera_name", "frame_idx").distinct().withColumn("part", F.floor(F.col("frame_idx") / stretch))
    counts = frames.groupBy("camera_name", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("camera_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("camera_name", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("camera_name", "part").orderBy("frame_idx"))
    ticks = frames.withColumn("own", own).join(carried, ["camera_name", "part"])
    ticks = ticks.select("camera_name", "frame_idx", (F.col("own") + F.col("before")).cast("long").alias("tick"))
    return tracks.join(ticks, ["camera_name", "frame_idx"])


def segments(tracks: DataFrame, clock: str = "frame_idx") -> DataFrame:
    """One row for each stretch: camera, track, first and last frame, rows."""
    found = with_segments(tracks, clock).groupBy(*TRACK, "seg").agg(
        F.min(clock).alias("first_frame"), F.max(clock).alias("last_frame"), F.count("*").alias("n_frames")
    )
    return found.drop("seg")


def departures(tracks: DataFrame) -> DataFrame:
    """Camera, track, its last tick and the next one, in which it is missing. Who is seen in the last tick has not left."""
    ticked = with_nonempty_clock(tracks)
    last = ticked.groupBy("camera_name").agg(F.max("tick").alias("final"))
    ended = segments(ticked, "tick")
    return ended.join(last, "camera_name").where("last_frame < final").select(
        *TRACK, F.col("last_frame").alias("last_tick"), (F.col("last_frame") + 1).alias("missing_tick")
    )


def in_segment() -> Window:
    return Window.partitionBy(*TRACK, "seg").orderBy("frame_idx")


def with_velocity(tracks: DataFrame) -> DataFrame:
    """Adds vx, vy (unit length, (0, 0) at rest) and ``moved`` (pixels) against the frame before; null in a stretch's first row."""
    fx, fy = geo.crossing_point("x1", "y1", "x2", "y2", "foot")
    df = tracks if "seg" in tracks.columns else with_segments(tracks)
    df = df.withColumns({"fx": fx, "fy": fy})
    w = in_segment()
    df = df.withColumns({"dx": F.col("fx") - F.lag("fx").over(w), "dy": F.col("fy") - F.lag("fy").over(w)})
    vx, vy = geo.unit(F.col("dx"), F.col("dy"))
    known = F.col("dx").isNotNull()
    return df.withColumns({
        "vx": F.when(known, vx), "vy": F.when(known, vy), "moved": F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    }).drop("dx", "dy")


def movement_direction(tracks: DataFrame, line_dx: float, line_dy: float, least_pixels: float = 1.0) -> DataFrame:
    """Adds ``movement``: forward, backward or none against a line's direction."""
    length = (line_dx**2 + line_dy**2) ** 0.5
    ux, uy = (line_dx / length, line_dy / length) if length else (0.0, 0.0)
    df = with_velocity(tracks)
    label: Column = F.when(F.col("moved") >= least_pixels, geo.movement(F.col("vx") * ux + F.col("vy") * uy)).otherwise("none")
    return df.withColumn("movement", label)
