"""Crossings of door lines and of room boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import presence

EVENT_COLUMNS = ("camera_name", "door_id", "track_id", "frame_idx", "event", "px", "py")


def calibrated(lines: DataFrame) -> DataFrame:
    """Lines of cameras all of whose lines are set; a line from the origin to the origin is not."""
    unset = (F.col("sx") == 0) & (F.col("sy") == 0) & (F.col("ex") == 0) & (F.col("ey") == 0)
    return lines.join(F.broadcast(lines.where(unset).select("camera_name").distinct()), "camera_name", "left_anti")


def line_crossings(tracks: DataFrame, lines: DataFrame, strict: bool = False, direction: bool = True) -> DataFrame:
    """ENTRY and EXIT events of tracks against door lines.

    A track's side counts outside the band around a line only. It crosses when
    its side differs from the last one that counted in the same stretch of
    presence. ``direction`` drops what a line's direction rules out, after the
    sides are known, so dropped crossings still move the state. ``strict``
    counts only between a line's ends and compares movement with the inward
    normal in place of the line itself.

    Lines are a small table of configuration and are broadcast: a shuffle by
    camera would put all rows of a camera into one task. Rows stay with their
    track, by which they are dealt already, so the window adds no shuffle.
    """
    df = presence.with_velocity(tracks) if direction else presence.with_segments(tracks)
    joined = df.join(F.broadcast(lines), "camera_name")
    px, py = geo.crossing_point("x1", "y1", "x2", "y2", F.coalesce(F.col("crossing_point"), F.lit("foot")))
    joined = joined.withColumns({"px": px, "py": py})
    ends = ("px", "py", "sx", "sy", "ex", "ey")
    counts = (geo.side(*ends) != 0) & (geo.line_distance(*ends) > F.col("band_width"))
    if strict:
        counts = counts & geo.within_segment(*ends)
    w = Window.partitionBy("camera_name", "track_id", "door_id", "seg").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    sided = joined.withColumn("side", F.when(counts, geo.side(*ends)))
    sided = sided.withColumn("before", F.last("side", ignorenulls=True).over(w))
    events = sided.where("side <> before").withColumn("event", F.when(F.col("side") == F.col("inside_sign"), "ENTRY").otherwise("EXIT"))
    return events.where(_allowed(strict)) if direction else events


def forward(strict: bool = False) -> tuple[Column, Column]:
    """The unit vector that movement is compared with: along the line or, ``strict``, the normal that points inside."""
    dx, dy = (F.col("ex") - F.col("sx")).cast("double"), (F.col("ey") - F.col("sy")).cast("double")
    ux, uy = geo.unit(dx, dy)
    if strict:  # inside is where the cross product has the inside's sign
        return -uy * F.col("inside_sign"), ux * F.col("inside_sign")
    return ux, uy


def _allowed(strict: bool) -> Column:
    ux, uy = forward(strict)
    ahead = F.col("vx") * ux + F.col("vy") * uy > 0.1
    moving = F.col("vx").isNotNull() & ((F.col("vx") != 0) | (F.col("vy") != 0))
    known = F.lower(F.col("direction"))
    ruled = F.when(known == "entry", (F.col("event") == "EXIT") | ~ahead).when(known == "exit", (F.col("event") == "ENTRY") | ~ahead).otherwise(False)
    return ~(moving & ruled)


def with_inside(tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds px, py, ``room`` and ``inside``; both null for a camera without a valid region. Regions are broadcast, as lines are."""
    valid = regions.where(geo.valid_polygon(F.col("polygon"))).select("camera_name", "room", "polygon", F.col("crossing_point").alias("region_point"))
    df = tracks.join(F.broadcast(valid), "camera_name", "left")
    px, py = geo.crossing_point("x1", "y1", "x2", "y2", F.coalesce(F.col("region_point"), F.lit("foot")))
    df = df.withColumns({"px": px, "py": py})
    inside = F.when(F.col("polygon").isNotNull(), geo.inside_polygon(F.col("px"), F.col("py"), F.col("polygon")))
    return df.withColumn("inside", inside).drop("polygon", "region_point")


def region_crossings(tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """Events where a track's point enters or leaves its camera's region; the first row of a stretch gives none."""
    df = with_inside(presence.with_segments(tracks), regions).where("inside is not null")
    df = df.withColumn("before", F.lag("inside").over(presence.in_segment()))
    events = df.where("inside <> before")
    return events.withColumns({"event": F.when(F.col("inside"), "ENTRY").otherwise("EXIT"), "door_id": F.lit("Room_Entry")})


def filter_tracks(tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """Tracks inside their camera's region; all of a camera without one."""
    return with_inside(tracks, regions).where("inside is null or inside")


def inside_counts(tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """For each camera and frame how many are inside and outside."""
    df = with_inside(tracks, regions).where("inside is not null")
    return df.groupBy("camera_name", "frame_idx").agg(F.count_if("inside").alias("n_inside"), F.count_if(F.expr("not inside")).alias("n_outside"))


def line_events_by_region(events: DataFrame, regions: DataFrame) -> DataFrame:
    """Line events that the region bears out: an ENTRY ends inside, an EXIT outside. Cameras without a region pass."""
    valid = regions.where(geo.valid_polygon(F.col("polygon"))).select("camera_name", "polygon")
    df = events.join(F.broadcast(valid), "camera_name", "left")
    inside = geo.inside_polygon(F.col("px"), F.col("py"), F.col("polygon"))
    return df.where(F.col("polygon").isNull() | F.when(F.col("event") == "ENTRY", inside).otherwise(~inside)).drop("polygon")


def merged_events(line_events: DataFrame, region_events: DataFrame) -> DataFrame:
    """Line events, and region events that no line event of the same track, frame and kind stands for.

    Both kinds meet in one window of a few rows, so neither is worked out twice.
    """
    line = line_events.select(*EVENT_COLUMNS, F.lit(True).alias("is_line"))
    both = line.unionByName(region_events.select(*EVENT_COLUMNS, F.lit(False).alias("is_line")))
    same = Window.partitionBy("camera_name", "frame_idx", "track_id", "event")
    return both.withColumn("has_line", F.max("is_line").over(same)).where("is_line or not has_line").select(*EVENT_COLUMNS)


def crossings(tracks: DataFrame, lines: DataFrame, regions: DataFrame, mode: str = "line") -> DataFrame:
    """Events by crossing mode: line, region or both; any other mode gives none."""
    line = line_crossings(tracks, calibrated(lines)).select(*EVENT_COLUMNS)
    region = region_crossings(tracks, regions).select(*EVENT_COLUMNS)
    if mode == "both":
        return merged_events(line, region)
    return line if mode == "line" else region if mode == "region" else line.limit(0)
