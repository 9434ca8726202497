"""The engine's input tables, made from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME_W, FRAME_H = 640, 720
SEED_OCCUPANCY = 3
#: camera_name, door_id, door_name, sx, sy, ex, ey, inside_sign, band_width, direction, crossing_point
LINES = [
    *[(f"Camera_{i}", "Door_A", "Front", 320, 200, 320, 700, 1, 25, "both", "foot") for i in (1, 2, 3, 4)],
    ("Camera_2", "Door_B", "Side", 100, 300, 500, 620, -1, 10, "entry", "center"),
    ("Camera_3", "Door_C", "Back", 540, 250, 100, 650, 1, 15, "exit", "mid-foot"),
]
LINE_COLUMNS = "camera_name string, door_id string, door_name string, sx int, sy int, ex int, ey int, inside_sign int, band_width int, direction string, crossing_point string"
POLYGON = [(100, 250), (540, 250), (540, 650), (100, 650)]
#: Cameras that have a region.
REGION_CAMERAS = ("Camera_1", "Camera_2", "Camera_3")
BATCH = 32
#: Events of a task at most, but for one user's: a few windows over wide rows hold several hundred bytes for each.
TASK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df  # stored without a zone; the session's is taken


def camera(user: str = "user_id"):
    return F.concat(F.lit("Camera_"), (F.col(user) % 4 + 1).cast("string"))


def by_user(events: DataFrame) -> DataFrame:
    """``events`` dealt by user to as many tasks as their number asks for; by their compressed bytes Spark would make far fewer of many events."""
    parts = -(-events.count() // TASK_ROWS)
    return events.repartition(parts, "user_id") if parts > 1 else events


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = by_user(table(spark, sf_dir, "events").withColumn("k", k)).withColumns({"frame_idx": (F.row_number().over(w) - 1).cast("long")})
    df = df.withColumns({
        "cx": F.floor(F.col("value") * 100).cast("long") % 640, "y2": 200 + (F.col("event_id") * 7 + F.col("k") * 3) % 500
    }).where("event_type <> 'error'")
    wide, x = F.col("k") % 30, F.col("cx")
    return df.select(
        "event_id", camera().alias("camera_name"), F.col("user_id").alias("track_id"), "frame_idx", "ts", ((x - 20 - wide).cast("double") + 0.5).alias("x1"), ((F.col("y2") - 60 - F.col("k")).cast("double") + 0.25).alias("y1"),
        ((x + 20 + wide).cast("double") + 0.75).alias("x2"), F.col("y2").cast("double").alias("y2"), (0.30 + (F.col("k") % 70).cast("double") / 100).alias("conf"),
    )


def door_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").where("event_type <> 'error'")
    kind = F.when(F.col("event_type").isin("signup", "view"), "ENTRY").otherwise("EXIT")
    return df.select(
        "event_id", "ts", F.lit("Room").alias("room"), camera().alias("camera_name"),
        F.concat(F.lit("Door_"), (F.col("user_id") % 3).cast("string")).alias("door_id"), F.col("user_id").alias("track_id"), kind.alias("event")
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", camera().alias("camera_name"), F.col("user_id").alias("track_id"))


def lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINES, LINE_COLUMNS)


def regions(spark: SparkSession) -> DataFrame:
    polygon = [{"x": x, "y": y} for x, y in POLYGON]
    return spark.createDataFrame(
        [(c, "Room", polygon, "foot") for c in REGION_CAMERAS],
        "camera_name string, room string, polygon array<struct<x:int,y:int>>, crossing_point string"
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pid, cid, embedding and label."""
    df = table(spark, sf_dir, "embeddings")
    return df.select(
        F.col("vec_id").alias("id"), F.col("label").cast("long").alias("pid"), (F.col("vec_id") % 6).alias("cid"), "embedding",
        F.col("label").cast("long").alias("label")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with an embedding each: the one whose number track and frame point at, or zeros in every eleventh frame."""
    from ..functions import geo

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = vectors.count()
    df = tracks(spark, sf_dir).withColumn("vec_id", (F.col("track_id") * 31 + F.col("frame_idx")) % n).join(vectors, "vec_id")
    zero = F.transform("e", lambda x: F.lit(0.0))
    edge = geo.edge_flag("x1", "y1", "x2", "y2", FRAME_W, FRAME_H)
    return df.withColumns({"embedding": F.when(F.col("frame_idx") % 11 == 0, zero).otherwise(F.col("e")), "is_edge": edge}).drop("e")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and night pools of images, from the documents' languages; night ones in two datasets."""
    kind = F.when(F.col("lang") == "en", "night").when(F.col("lang") == "fr", "day")
    df = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), kind.alias("kind"), F.when(F.col("doc_id") % 3 == 0, "b").otherwise("a").alias("dataset")
    )
    return df.where("kind is not null").select("dataset", F.col("path").cast("string").alias("path"), "kind")
