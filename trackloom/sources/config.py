"""Camera, line and region configuration from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo

CAMERAS = T.StructType().add("name", "string").add("source", "string").add("description", "string")
_LINE = "struct<door_id:string,door_name:string,start:array<int>,end:array<int>,inside_sign:int,band_width:int,direction:string,crossing_point:string>"
COUNTER = f"""room_name string, cameras array<struct<name:string,source:string,crossing_point:string,crossing_mode:string,
    door_lines:array<{_LINE}>,room_region:struct<polygon:array<array<int>>,crossing_point:string,crossing_mode:string>>>"""


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """name, source, description and kind of each camera of a JSON list."""
    return spark.read.schema(CAMERAS).option("multiLine", True).json(path).withColumn("kind", geo.source_kind(F.col("source")))


def read_counter(spark: SparkSession, path: str) -> DataFrame:
    """One row for each camera of a counter configuration; back slashes in sources become slashes."""
    df = spark.read.schema(COUNTER).option("multiLine", True).json(path)
    return df.select("room_name", F.explode("cameras").alias("c")).select("room_name", "c.*").withColumn("source", F.translate("source", "\\", "/"))


def door_lines(counter: DataFrame) -> DataFrame:
    """Lines with defaults: band 25, direction both, crossing point of the line, else of the camera, else foot."""
    line = counter.select(F.col("name").alias("camera_name"), F.col("crossing_point").alias("camera_point"), F.explode("door_lines").alias("l"))
    direction, point = F.lower(F.col("l.direction")), F.coalesce("l.crossing_point", "camera_point", F.lit("foot"))
    at = lambda c, i: F.element_at(F.col(f"l.{c}"), i)
    return line.select(
        "camera_name", "l.door_id", "l.door_name", at("start", 1).alias("sx"), at("start", 2).alias("sy"), at("end", 1).alias("ex"), at("end", 2).alias("ey"),
        F.coalesce("l.inside_sign", F.lit(1)).alias("inside_sign"), F.coalesce("l.band_width", F.lit(25)).alias("band_width"),
        F.when(direction.isin(*geo.DIRECTIONS), direction).otherwise("both").alias("direction"), F.when(point.isin(*geo.CROSSING_POINTS), point).otherwise("foot").alias("crossing_point"),
    )


def regions(counter: DataFrame) -> DataFrame:
    """Regions of three points or more, with the crossing point and mode of the region, else of the camera, else foot and line."""
    polygon = F.transform("room_region.polygon", lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))
    df = counter.select(
        F.col("name").alias("camera_name"), F.col("room_name").alias("room"), polygon.alias("polygon"),
        F.coalesce("room_region.crossing_point", "crossing_point", F.lit("foot")).alias("crossing_point"),
        F.coalesce("room_region.crossing_mode", "crossing_mode", F.lit("line")).alias("crossing_mode"),
    )
    return df.where(F.size("polygon") >= 3)


def with_region(existing: DataFrame, saved: DataFrame) -> DataFrame:
    """``existing`` regions after saving those in ``saved`` (camera_name, polygon, crossing_point, crossing_mode).

    Fewer than three points delete a camera's region; a crossing point or mode
    that isn't given stays as it was.
    """
    options = [c for c in ("crossing_point", "crossing_mode") if c in existing.columns]
    given = [F.col(c).alias(f"new_{c}") if c in saved.columns else F.lit(None).cast("string").alias(f"new_{c}") for c in options]
    s = saved.select("camera_name", F.col("polygon").alias("new"), *given, F.lit(True).alias("is_saved"))
    df = existing.join(s, "camera_name", "full")
    df = df.withColumn("polygon", F.when(F.col("is_saved"), F.when(F.size("new") >= 3, F.col("new"))).otherwise(F.col("polygon")))
    defaults = {"crossing_point": "foot", "crossing_mode": "line"}
    df = df.withColumns({c: F.coalesce(f"new_{c}", c, F.lit(defaults[c])) for c in options})
    return df.where("polygon is not null").select(*existing.columns)
