"""Queries over sources and sinks: files written in the layout that others use, read back by the engine's readers.

Files are made from whole tables. A name of an image is its camera and frame.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, labels, vec
from ..operators import crossings, etl, metrics, occupancy, rates
from ..session import fresh_dir
from ..sources import annotations, config, results
from ..sources import files as sinks
from . import fixtures as fx

SIDES = ("x", "y", "w", "h")
#: Sources of the four cameras.
SOURCES = ("rtsp://door/1", "0", "clips\\door.mp4", "HTTPS://door/4")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each observation: image, order, whole-pixel box and frame size."""
    t = fx.tracks(spark, sf_dir)
    x, y = geo.truncated("x1"), geo.truncated("y1")
    return t.select(
        F.concat_ws("_", "camera_name", "frame_idx").alias("image_id"), "camera_name", F.col("event_id").alias("order"), x.alias("x"), y.alias("y"),
        (geo.truncated("x2") - x).alias("w"), (geo.truncated("y2") - y).alias("h"),
    )


def gathered(rows: DataFrame, *cols) -> DataFrame:
    """``rows`` of each image as an array in their order; an image's boxes are few."""
    return rows.groupBy("image_id", "camera_name").agg(F.array_sort(F.collect_list(F.struct("order", *cols))).alias("rows"))


def put(spark: SparkSession, what: str, named: DataFrame) -> str:
    folder = fresh_dir(spark, what)
    sinks.write_files(named, folder)
    return folder


def told(found: DataFrame, *more: str) -> DataFrame:
    return found.select("image_id", *more, *[F.col(c).cast("long").alias(c) for c in SIDES])


# configuration


def _document(spark: SparkSession, name: str, document) -> str:
    """A configuration of a few cameras as a file."""
    return put(spark, "config", spark.createDataFrame([(name, json.dumps(document))], "name string, text string")) + f"/{name}"


def camera_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by camera of a list of cameras, with the kind of its source."""
    path = _document(spark, "cameras.json", [{"name": f"Camera_{i + 1}", "source": s} for i, s in enumerate(SOURCES)])
    counts = fx.tracks(spark, sf_dir).groupBy("camera_name").agg(F.count("*").alias("n"))
    return config.read_cameras(spark, path).join(counts, F.col("name") == F.col("camera_name")).select("name", "source", "kind", "n")


def counter_document() -> dict:
    """A counter's cameras: a line without a point of its own, one without a band, one of a made-up direction."""
    line = lambda c: {"door_id": c[1], "door_name": c[2], "start": [c[3], c[4]], "end": [c[5], c[6]], "inside_sign": c[7]}
    cameras = []
    for i, source in enumerate(SOURCES):
        name = f"Camera_{i + 1}"
        own = {"name": name, "source": source, "door_lines": [line(c) for c in fx.LINES if c[0] == name]}
        if i == 1:
            own |= {"crossing_point": "top", "crossing_mode": "both"}
            own["door_lines"][1] |= {"crossing_point": "mid-foot", "direction": "EXIT", "band_width": 40}
        if i == 2:
            own["door_lines"][0] |= {"crossing_point": "knee", "direction": "sideways"}
        if i < 3:
            own["room_region"] = {"polygon": [list(p) for p in fx.POLYGON[: 4 - (i == 2) * 2]]}
        cameras.append(own)
    return {"room_name": "Room", "cameras": cameras}


def counter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a counter's configuration with their defaults, and observations within each one's band."""
    lines = config.door_lines(config.read_counter(spark, _document(spark, "counter.json", counter_document())))
    px, py = geo.crossing_point("x1", "y1", "x2", "y2", F.col("crossing_point"))
    rows = fx.tracks(spark, sf_dir).join(lines, "camera_name").withColumns({"px": px, "py": py})
    near = geo.line_distance("px", "py", "sx", "sy", "ex", "ey") <= F.col("band_width")
    return rows.groupBy(
        "camera_name", "door_id", "direction", "crossing_point", F.col("band_width").cast("long").alias("band_width")
    ).agg(F.count_if(near).alias("n"))


def counter_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a counter's configuration after saving: one gets a point more, one is deleted, one is new."""
    existing = config.regions(config.read_counter(spark, _document(spark, "counter.json", counter_document())))
    point = "polygon array<struct<x:int,y:int>>"
    saved = [(
        "Camera_1", [(50, 50), (300, 60), (310, 700), (40, 640)], "center", None
    ), ("Camera_2", [(1, 1), (2, 2)], None, "region"), ("Camera_4", [(0, 0), (640, 0), (640, 720)], None, None)]
    after = config.with_region(existing, spark.createDataFrame(saved, f"camera_name string, {point}, crossing_point string, crossing_mode string"))
    counts = crossings.inside_counts(fx.tracks(spark, sf_dir), after).groupBy("camera_name").agg(F.sum("n_inside").alias("n_inside"))
    return after.join(counts, "camera_name", "left").select(
        "camera_name", "room", F.size("polygon").cast("long").alias("points"), "crossing_point", "crossing_mode", "n_inside"
    )


def polygon_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of two to five corners, some with a corner at the origin, by whether they are valid."""
    x, y = F.floor("value") % 7, F.col("event_id") % 5
    corner = lambda k: F.struct(((x + k) % 4).cast("int").alias("x"), ((y + k) % 3).cast("int").alias("y"))
    polygon = F.slice(F.array(*[corner(k) for k in range(5)]), F.lit(1), (F.col("event_id") % 4 + 2).cast("int"))
    return fx.table(spark, sf_dir, "events").select("event_id", geo.valid_polygon(polygon).alias("is_valid"))


# annotations


def _crowd(spark: SparkSession, sf_dir: str, visible: bool) -> DataFrame:
    tag = F.when(F.col("order") % 7 == 0, "mask").otherwise("person").alias("tag")
    seen = F.when(F.col("order") % 2 == 0, F.array("x", "y", F.lit(9), F.lit(9))).alias("vbox")
    full = F.when(F.col("order") % 5 != 0, F.array(*SIDES)).alias("fbox")
    images = gathered(boxes(spark, sf_dir), tag, full, seen)
    path = f"{fresh_dir(spark, 'crowd')}/in"
    images.select(F.col("image_id").alias("ID"), F.transform("rows", lambda r: r.dropFields("order")).alias("gtboxes")).write.json(path)
    return told(annotations.read_ndjson(spark, path, visible), "order")


def crowd_full_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON, by their full boxes; persons without one are left out."""
    return _crowd(spark, sf_dir, False)


def crowd_visible_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the visible boxes, or else the full ones."""
    return _crowd(spark, sf_dir, True)


def _city(spark: SparkSession, sf_dir: str) -> str:
    label = F.element_at(F.array(*map(F.lit, ("Pedestrian", "person", "rider", "people"))), (F.col("order") % 4 + 1).cast("int")).alias("lbl")
    sides = [F.col(c).cast("double").alias(f"bb{name}") for c, name in zip(SIDES, ("left", "top", "width", "height"))]
    images = gathered(boxes(spark, sf_dir), label, *sides, (F.col("order") % 3).cast("int").alias("occl"))
    size = F.when(F.col("camera_name") != "Camera_2", F.lit(fx.FRAME_H))
    text = F.to_json(F.struct(
        size.alias("imgHeight"), F.when(F.col("camera_name") != "Camera_2", F.lit(fx.FRAME_W)).alias("imgWidth"),
        F.struct(F.transform("rows", lambda r: r.dropFields("order")).alias("list")).alias("annotation")
    ))
    return put(spark, "city", images.select(F.concat(
        "camera_name", F.lit("/"), "image_id", F.lit("_gtBboxCityPersons.json")
    ).alias("name"), text.alias("text")))


def city_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file for each image in a folder for each city: label shares of persons, by the name that each image gets."""
    rows = annotations.read_city_json(spark, _city(spark, sf_dir)).withColumn("image_id", labels.city_image_name(F.col("city"), F.col("image_id")))
    return etl.yolo_labels(rows, 10.0).select(
        "image_id", F.col("order").cast("long").alias("place"), *[F.round(c, 12).alias(c) for c in ("xc", "yc", "w", "h")]
    )


def city_boxes_unoccluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons that aren't marked as occluded, by image size."""
    rows = annotations.read_city_json(spark, _city(spark, sf_dir), skip_occluded=True)
    return rows.groupBy(
        "city", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height")
    ).agg(F.count("*").alias("n"), F.sum("h").alias("heights"))


def _corners(spark: SparkSession, sf_dir: str) -> str:
    identity = F.element_at(F.array(*map(F.lit, ("Pedestrian", "person", "RIDER", "bicyclist", "car"))), (F.col("order") % 5 + 1).cast("int")).alias("identity")
    pos = F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    pos = F.when(F.col("order") % 11 == 0, F.slice(pos, 1, 3)).when(F.col("order") % 13 != 0, pos).alias("pos")
    images = gathered(boxes(spark, sf_dir), identity, pos, F.when(F.col("order") % 2 == 0, (F.col("order") % 10) / 10).alias("occluded"))
    known = F.col("camera_name") != "Camera_4"
    text = F.to_json(F.struct(
        F.when(known, F.lit(fx.FRAME_W)).alias("imagewidth"), F.when(known, F.lit(fx.FRAME_H)).alias("imageheight"),
        F.transform("rows", lambda r: r.dropFields("order")).alias("children")
    ))
    return put(spark, "corners", images.select(F.concat(
        F.lit("labels/"), "camera_name", F.lit("/"), "image_id", F.lit(".json")
    ).alias("name"), text.alias("text")))


def corner_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file for each image with corners of persons; heights are tested as the label's line tells them."""
    rows = annotations.read_corner_json(spark, _corners(spark, sf_dir)).withColumn(
        "image_id", labels.mode_image_name("night", F.col("city"), F.col("image_id"))
    )
    found = etl.yolo_labels(rows, least_clipped_height=90.0)
    return found.select("image_id", F.col("order").cast("long").alias("place"), *[F.round(c, 12).alias(c) for c in ("xc", "yc", "w", "h")])


def corner_boxes_with_riders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons and riders that are hidden by half at most."""
    rows = annotations.read_corner_json(spark, _corners(spark, sf_dir), riders=True, most_occluded=0.5)
    return rows.groupBy("city").agg(F.count("*").alias("n"), F.sum("w").alias("widths"))


def _counted(spark: SparkSession, sf_dir: str) -> str:
    line = F.concat_ws(" ", F.col("order") % 5 + 1, "x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    line = F.when(F.col("order") % 9 == 0, F.concat_ws(" ", F.col("order") % 5 + 1, "x", "y")).otherwise(line).alias("line")
    images = gathered(boxes(spark, sf_dir), line)
    n = F.when(F.col("image_id").endswith("7"), F.lit("many")).otherwise(F.greatest(F.size("rows") - 1, F.lit(1)).cast("string"))
    text = F.concat(n, F.lit("\r\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), " \n\n"), F.lit("\n"))
    return put(spark, "counted", images.select(F.concat("image_id", F.lit(".jpg.txt")).alias("name"), text.alias("text")))


def counted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that count their lines: pedestrians, without what stands behind the last counted line."""
    return told(annotations.read_counted_text(spark, _counted(spark, sf_dir)))


def counted_boxes_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pedestrians, riders and persons seen in part."""
    return told(annotations.read_counted_text(spark, _counted(spark, sf_dir), riders=True, partial=True))


def _documents(spark: SparkSession, sf_dir: str) -> str:
    """A document for each camera with images, annotations and categories; that of Camera_3 has no person category."""
    rows = boxes(spark, sf_dir).withColumn("number", F.regexp_extract("image_id", "([0-9]+)$", 1).cast("long"))
    images = rows.select("camera_name", "number", "image_id").distinct().where("number % 10 <> 3").groupBy("camera_name").agg(F.array_sort(F.collect_list(F.struct(
        F.col("number").alias("id"), F.lit(fx.FRAME_W).alias("width"), F.lit(fx.FRAME_H).alias("height"), F.concat(F.lit("sub/"), "image_id", F.lit(".png")).alias("file_name")))).alias("images"))
    marks = rows.groupBy("camera_name").agg(F.array_sort(F.collect_list(F.struct(
        F.col("order").alias("id"), F.col("number").alias("image_id"), (F.col("order") % 3 + 4).alias("category_id"), F.array(*SIDES).alias("bbox")))).alias("annotations"))
    names = F.when(
        F.col("camera_name") == "Camera_3", F.array(F.lit("car"), F.lit("dog"), F.lit("cat"))
    ).otherwise(F.array(F.lit("car"), F.lit("Pedestrian"), F.lit("person")))
    categories = F.transform(names, lambda name, i: F.struct((i + 4).alias("id"), name.alias("name")))
    text = F.to_json(F.struct("images", "annotations", categories.alias("categories")))
    return put(spark, "coco", images.join(marks, "camera_name").select(F.concat("camera_name", F.lit(".json")).alias("name"), text.alias("text")))


def document_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the first person category, or of the first of all, in images that the document has."""
    return told(annotations.read_coco(spark, _documents(spark, sf_dir)))


def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of persons in each document."""
    found = annotations.person_counts(spark, _documents(spark, sf_dir))
    return found.select(labels.stem(F.col("document")).alias("document"), "persons", "images")


def image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images under a folder in order of their paths, by suffix in any case; other files are no images."""
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".txt", ".JPeg", ".webp", ".gif"))), (F.col("page_id") % 6 + 1).cast("int"))
    pages = fx.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("d"), F.col("page_id") % 3, F.lit("/page"), "page_id", suffix).alias("name"), F.lit("x").alias("text")
    )
    found = annotations.image_files(spark, put(spark, "images", pages)).orderBy("path")
    return found.select(labels.folder(F.col("path")).alias("folder"), "image_id", F.col("length").cast("long").alias("length"))


def written_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file for each image, read back: its lines, and whether it ends without a line break."""
    rows = boxes(spark, sf_dir).withColumns({"width": F.lit(fx.FRAME_W), "height": F.lit(fx.FRAME_H)})
    files = etl.label_files(etl.yolo_labels(rows, 70.0)).select(F.concat("image_id", F.lit(".txt")).alias("name"), "text")
    back = spark.read.text(put(spark, "labels", files), wholetext=True).withColumn("image_id", labels.stem(F.col("_metadata.file_path")))
    lines = F.split("value", "\n")
    return back.select("image_id", F.size(lines).cast("long").alias("n_lines"), F.col("value").endswith("\n").alias("ends_open"))


# results


def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's summary as JSON and back, door by door."""
    path = f"{fresh_dir(spark, 'summary')}/summary"
    results.write_json(occupancy.session_summary(fx.door_events(spark, sf_dir), fx.SEED_OCCUPANCY), path)
    doors = "map<string,struct<entered:long,exited:long>>"
    back = spark.read.schema(f"room string, final_occupancy long, total_entered long, total_exited long, peak_occupancy long, per_door {doors}").json(path)
    return back.select(
        "room", "final_occupancy", "peak_occupancy", F.explode("per_door").alias("door_id", "d")
    ).select("room", "final_occupancy", "peak_occupancy", "door_id", "d.entered", "d.exited")


def occupancy_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after the last event."""
    found = occupancy.snapshot(fx.door_events(spark, sf_dir), fx.SEED_OCCUPANCY)
    return found.select("room", "current_occupancy", "total_entered", "total_exited", "peak_occupancy", F.size("per_door").cast("long").alias("doors"))


def rotation_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of each rotation read back: lines and different images."""
    members = etl.rotation_members(etl.rotations(fx.images(spark, sf_dir)))
    path = f"{fresh_dir(spark, 'manifests')}/train"
    results.write_manifests(members, path)
    back = spark.read.schema("value string, rotation long").text(path)
    return back.groupBy("rotation").agg(F.count("*").alias("n_lines"), F.count_distinct("value").alias("n_images"))


def rotation_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The description of each rotation's data set, written and read back whole."""
    rotations = etl.rotations(fx.images(spark, sf_dir)).where("rotation >= 0").select("rotation").distinct()
    named = results.rotation_yaml(rotations, "data").select(F.concat(F.lit("rot"), "rotation", F.lit(".yaml")).alias("name"), "text")
    back = spark.read.text(put(spark, "yaml", named), wholetext=True)
    return back.select(labels.stem(F.col("_metadata.file_path")).alias("name"), F.col("value").alias("text"))


def validation_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven images for each of three data sets, in total and in hash order: the feature is the cap."""
    return etl.validation_set(fx.images(spark, sf_dir), 7, 3).select("path")


def day_only_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without night images there is one rotation, of the day ones."""
    return etl.rotation_report(etl.rotations(fx.images(spark, sf_dir).where("kind = 'day'")))


def later_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans from the third rotation on, and the second one's by itself."""
    plan = etl.training_plan(etl.rotations(fx.images(spark, sf_dir)))
    both = etl.in_range(plan, start_from=2).withColumn("asked", F.lit("from 2")).unionByName(etl.in_range(plan, only=1).withColumn("asked", F.lit("only 1")))
    return both.select("asked", "rotation", "lr", "weights_in")


def chained_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training log as JSON lines and back; a rotation that failed leaves no weights, so the next one starts from older ones."""
    rotations = etl.rotations(fx.images(spark, sf_dir)).where("rotation >= 0").groupBy("rotation").agg(F.count("*").alias("n"))
    left = F.when(F.col("rotation") % 3 != 1, F.concat(F.lit("rot"), "rotation", F.lit(".pt"))).alias("weights_out")
    path = f"{fresh_dir(spark, 'log')}/log"
    results.write_json(rotations.select("rotation", "n", left), path)
    return results.chained_weights(spark.read.schema("rotation long, n long, weights_out string").json(path))


def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the events by type as a report in percent, written as JSON and read back."""
    share = lambda kind: F.avg(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0)).alias(kind)
    path = f"{fresh_dir(spark, 'report')}/report"
    results.write_json(results.percent_report(fx.table(spark, sf_dir, "events").agg(share("view"), share("click"), share("error"))), path)
    return spark.read.schema("view double, click double, error double").json(path)


def sweep_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sweep appended in two runs; rows that can't be read are skipped."""
    k = F.col("l_linenumber")
    rows = fx.table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q")
    )
    conf = F.when(F.col("l_returnflag") == "N", F.lit("bad")).otherwise((F.lit(0.05) * k).cast("decimal(4,2)").cast("string"))
    shaped = rows.select(
        conf.alias("Conf"), F.lit("0.45").alias("IOU"), (k * 32).alias("Img_Size"), (F.col("n") % 100 / 100).alias("Precision"),
        (F.col("q") % 100 / 100).alias("Recall"), F.lit(0.5).alias("mAP50"), F.lit(0.25).alias("mAP50-95")
    )
    path = f"{fresh_dir(spark, 'sweep')}/sweep"
    results.append_rows(shaped.where(k <= 3), path)
    results.append_rows(shaped.where(k > 3), path)
    return results.read_sweep(spark, path)


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of runs: JSON first, else the last line of a CSV whose header has blanks; broken JSON counts as none."""
    runs = fx.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("run")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    folder, kind = F.concat(F.lit("run"), F.col("run").cast("string"), F.lit("/results")), F.col("run") % 4
    as_json = F.when(kind == 1, F.lit("{ broken")).otherwise(F.to_json(F.struct(F.lit("json").alias("epoch"), F.col("n").cast("string").alias("loss"))))
    as_csv = F.concat(F.lit(" epoch, loss ,extra\n\n1, 2, 3\n"), F.lit("csv ,  "), F.col("last").cast("string"), F.lit("\n\n"))
    files = runs.where(kind.isin(0, 1, 3)).select(F.concat(folder, F.lit(".json")).alias("name"), as_json.alias("text"))
    files = files.unionByName(runs.where(kind.isin(0, 1, 2)).select(F.concat(folder, F.lit(".csv")).alias("name"), as_csv.alias("text")))
    found = results.read_results(spark, put(spark, "runs", files))
    return found.select("run", "source", F.col("values")["epoch"].alias("epoch"), F.col("values")["loss"].alias("loss"))


def data_set_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each data set's checks of its directories together."""
    files = fx.images(spark, sf_dir).select(F.concat_ws("/", "dataset", "kind").alias("subdir"))
    expected = spark.createDataFrame([("a/day", 10), ("a/night", 10), ("b/day", 1_000_000), ("b/night", 1), ("c/day", 1)], "subdir string, at_least long")
    return etl.verdict(etl.verify(files, expected).withColumn("dataset", F.split("subdir", "/")[0]))


def frame_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections for each frame of a camera, and for none."""
    found = fx.tracks(spark, sf_dir).groupBy("camera_name").agg(F.count("*").alias("n"), F.count_distinct("frame_idx").alias("frames"))
    ratio = geo.safe_ratio(F.col("n"), F.col("frames"))
    return found.select("camera_name", F.round(ratio, 6).alias("per_frame"), geo.safe_ratio(F.col("n"), F.col("frames") * 0).alias("of_none"))


def written_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that a live source's file has, repeated so that it keeps the pace."""
    found = rates.duplicated_frames(fx.arrivals(spark, sf_dir), fps=0.01, longest_s=800.0)
    return found.groupBy("camera_name").agg(F.count("*").alias("written"), F.max("copy").cast("long").alias("most"))


def combined_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplet loss of neighbours with a cross entropy over the first ten numbers of each vector."""
    rows = fx.features(spark, sf_dir)
    part = lambda k, name: rows.where(F.col("id") % 3 == k).select(F.floor(F.col("id") / 3).alias("t"), vec.doubles("embedding").alias(name))
    triplet = metrics.triplet_loss(part(0, "anchor").join(part(1, "positive"), "t").join(part(2, "negative"), "t"))
    logits = rows.select(F.slice(vec.doubles("embedding"), 1, 10).alias("logits"), (F.col("id") % 10).alias("label"))
    both = metrics.combined_loss(triplet, logits, 1.0, 0.5).select(F.round("loss", 6).alias("loss"), F.lit("both").alias("kind"))
    return both.unionByName(metrics.combined_loss(triplet, None, 2.0).select(F.round("loss", 6).alias("loss"), F.lit("triplet").alias("kind")))


QUERIES = (
    camera_list, counter_lines, counter_regions, polygon_validity, crowd_full_boxes, crowd_visible_boxes, city_boxes, city_boxes_unoccluded, corner_boxes,
    corner_boxes_with_riders, counted_boxes, counted_boxes_of_all, document_boxes, document_counts, image_listing, written_labels, summary_file,
    occupancy_snapshot, rotation_manifests, rotation_descriptions, validation_images, day_only_rotation, later_rotations, chained_weights, metrics_report,
    sweep_results, run_results, data_set_verdict, frame_ratios, written_frames, combined_loss,
)
