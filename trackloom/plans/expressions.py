"""Queries over the column expressions, and round trips through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, labels, vec
from ..operators import crossings, etl, occupancy, rates
from ..session import fresh_dir
from ..sources import annotations, results
from . import fixtures as fx

BOX = ("x1", "y1", "x2", "y2")
#: A region that is no rectangle, with a notch.
NOTCHED = [(80, 240), (560, 300), (480, 660), (330, 430), (120, 640)]


def box_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a box that can be followed, in whole pixels."""
    points = {kind.replace("-", "_"): geo.crossing_point(*BOX, kind) for kind in geo.CROSSING_POINTS}
    raw_x, raw_y = geo.foot("x1", "y2", "x2")
    return fx.tracks(spark, sf_dir).select(
        "event_id", points["foot"][0].alias("px"), *[y.alias(f"{kind}_y") for kind, (_, y) in points.items()], raw_x.cast("long").alias("raw_x"),
        raw_y.alias("raw_y")
    )


def line_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side of and distance from each line of the camera."""
    px, py = geo.crossing_point(*BOX, F.col("crossing_point"))
    ends = ("sx", "sy", "ex", "ey")
    rows = fx.tracks(spark, sf_dir).join(F.broadcast(fx.lines(spark)), "camera_name").withColumns({"px": px, "py": py})  # a configuration of a few lines
    ux, uy = geo.unit(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))
    within = geo.within_segment("px", "py", *ends)
    return rows.select(
        "event_id", "door_id", geo.side("px", "py", *ends).cast("long").alias("side"),
        F.round(geo.line_distance("px", "py", *ends), 6).alias("distance"), F.round(ux, 6).alias("ux"), F.round(uy, 6).alias("uy"),
        within.alias("within_ends")
    )


def calibrated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by line, for cameras whose lines are all set; Camera_3 gets one that is not."""
    unset = spark.createDataFrame([("Camera_3", "Door_D", "Unset", 0, 0, 0, 0, 1, 25, "both", "foot")], fx.LINE_COLUMNS)
    lines = crossings.calibrated(fx.lines(spark).unionByName(unset))
    return fx.tracks(spark, sf_dir).join(F.broadcast(lines), "camera_name").groupBy("camera_name", "door_id").agg(F.count("*").alias("n"))


def notched_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each foot is inside a polygon that is not convex."""
    px, py = geo.crossing_point(*BOX)
    return fx.tracks(spark, sf_dir).withColumns({"px": px, "py": py}).select("event_id", geo.inside_polygon(F.col("px"), F.col("py"), NOTCHED).alias("inside"))


def usable_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes large enough for an embedding by each rule, and the person's colour number."""
    size = (fx.FRAME_W, fx.FRAME_H)
    rules = {"for_embedding": geo.crop_is_usable(*BOX, *size), "for_saving": geo.crop_is_usable(*BOX, *size, 50, 50)}
    return fx.tracks(spark, sf_dir).select("event_id", *[c.alias(k) for k, c in rules.items()], geo.colour_seed(F.col("track_id") * 7919).alias("colour"))


def brightness_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by what is done about their brightness."""
    band = geo.brightness_band(F.floor("value") % 120)
    rows = fx.table(spark, sf_dir, "events").select(band.alias("b")).select("b.*")
    return rows.groupBy("clip", "gamma").agg(F.count("*").alias("n"))


def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, stem and suffix test of each source: pages' addresses, numbers of webcams and files of clips."""
    number = F.col("page_id").cast("string")
    source = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, number).otherwise(F.concat(F.lit("clips/rot"), number, F.lit(".part.JPG")))
    rows = fx.table(spark, sf_dir, "pages").select("page_id", source.alias("source"))
    return rows.select(
        "page_id", geo.source_kind(F.col("source")).alias("kind"), labels.stem(F.col("source")).alias("stem"),
        labels.has_suffix(F.col("source"), (".jpg", ".png")).alias("is_image")
    )


def rotation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotation that a dataset's name tells."""
    name = F.when(F.col("page_id") % 4 == 0, "dataset_full").otherwise(F.concat(F.lit("dataset_rot"), (F.col("page_id") % 17).cast("string"), F.lit(".yaml")))
    return fx.table(spark, sf_dir, "pages").groupBy(labels.rotation_number(name).cast("long").alias("rotation")).agg(F.count("*").alias("n"))


def display_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display coordinates on a small screen, back in the source's pixels."""
    scale = geo.display_scale(F.lit(float(fx.FRAME_W)), F.lit(float(fx.FRAME_H)), 512.0, 450.0)
    return fx.tracks(spark, sf_dir).select("event_id", F.round(scale, 6).alias("scale"), geo.to_source(F.col("y2") + 0.1, scale).cast("long").alias("source_y"))


def band_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the zone about each line, with the observations of its camera."""
    quad = geo.band_quad("sx", "sy", "ex", "ey", "band_width")
    seen = fx.tracks(spark, sf_dir).groupBy("camera_name").agg(F.count("*").alias("n"))
    rows = fx.lines(spark).select("camera_name", "door_id", F.posexplode(quad).alias("corner", "p"))
    return rows.join(seen, "camera_name").select(
        "camera_name", "door_id", F.col("corner").cast("long").alias("corner"), F.col("p.x").cast("long").alias("x"),
        F.col("p.y").cast("long").alias("y"), "n"
    )


def reported_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of sources as they report them, with the default for impossible ones."""
    fps = geo.fps_or_default(F.floor("value") % 80)
    return fx.table(spark, sf_dir, "events").groupBy(fps.cast("double").alias("fps")).agg(F.count("*").alias("n"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and distances of each vector and the one after it."""
    rows = fx.features(spark, sf_dir).select("id", vec.doubles("embedding").alias("a"))
    after = rows.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    told = {"cosine": vec.cosine(a, b), "squared": vec.squared_distance(a, b), "distance": vec.distance(a, b), "length": vec.norm(vec.normalize(a))}
    return rows.join(after, "id").select("id", *[F.round(c, 6).alias(k) for k, c in told.items()], vec.is_nonzero(a).alias("is_nonzero"))


def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stepped rate of each epoch, an epoch being a hundred events."""
    epochs = fx.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("epoch")).agg(F.count("*").alias("n"))
    return epochs.select("epoch", "n", F.round(labels.stepped_rate(3e-4, F.col("epoch"), 15), 12).alias("lr"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = {
        "image_id": F.concat_ws("_", "camera_name", "frame_idx"), "order": F.col("event_id"), "x": F.col("x1"), "y": F.col("y1"),
        "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")
    }
    return fx.tracks(spark, sf_dir).select(*[c.alias(k) for k, c in shape.items()], F.lit(fx.FRAME_W).alias("width"), F.lit(fx.FRAME_H).alias("height"))


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each image's label file."""
    return etl.label_files(etl.yolo_labels(_boxes(spark, sf_dir), 70.0))


def dataset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each directory has as many images as it should; one is missing."""
    files = fx.images(spark, sf_dir).select(F.concat_ws("/", "dataset", "kind").alias("subdir"))
    expected = spark.createDataFrame([("a/day", 10), ("a/night", 10), ("b/day", 1_000_000), ("c/day", 1)], "subdir string, at_least long")
    return etl.verify(files, expected)


def capped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty day images in hash order: the feature is the cap."""
    return etl.capped(fx.images(spark, sf_dir).where("kind = 'day'"), 20).select("path")


def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each image's candidates (a copy, the image itself, a spare) the first that exists."""
    images = fx.images(spark, sf_dir)
    files = images.select(F.when(F.col("kind") == "day", F.concat(F.lit("copy/"), "path")).otherwise(F.col("path")).alias("path"))
    listed = F.array(*[F.struct(F.lit(k).alias("priority"), F.concat(F.lit(top), "path").alias("path")) for k, top in enumerate(("copy/", "", "spare/"))])
    candidates = images.select(F.col("path").alias("name"), F.explode(listed).alias("c")).select("name", "c.*")
    return annotations.first_existing(candidates, files)


def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.frame_counts(fx.tracks(spark, sf_dir))


def frame_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, their rate and milliseconds a frame, from a time for each."""
    runs = fx.table(spark, sf_dir, "events").select((F.col("event_id") % 37 + 1).cast("double").alias("elapsed_s"))
    return rates.latency(runs).select("frames", F.round("fps", 6).alias("fps"), F.round("ms_per_frame", 6).alias("ms_per_frame"))


def last_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last epoch's row of a training log."""
    log = fx.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("epoch")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("loss"))
    return results.last_result(log)


def logged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log written as daily CSV files with headers and read back, counted by day and door."""
    path = f"{fresh_dir(spark, 'log')}/log"
    results.append_event_log(results.event_log(occupancy.timeline(fx.door_events(spark, sf_dir), fx.SEED_OCCUPANCY)), path)
    log = spark.read.option("header", True).schema("timestamp string, camera_name string, door_id string, door_name string, event string, track_id long, occupancy_after long, event_date string").csv(path)
    return log.groupBy("event_date", "door_id", "event").agg(F.count("*").alias("n"), F.max("occupancy_after").alias("highest"))


QUERIES = (
    box_points, line_sides, calibrated_lines, notched_region, usable_crops, brightness_bands, source_kinds, rotation_numbers, display_points, band_zones,
    reported_rates, vector_pairs, learning_rates, label_files, dataset_check, capped_images, first_candidates, frame_counts, frame_latency, last_epoch,
    logged_events,
)
