"""Queries by name. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, vec
from ..operators import boxes, crossings, etl, gallery, metrics, occupancy, presence, rates, similarity, tracklets
from ..session import dropped, fresh_dir, written
from ..sources import live, results
from ..streaming import latest, processors, rooms, tracks
from . import expressions, expressions_oracle, files, files_oracle, oracle
from . import fixtures as fx

EVENTS = list(crossings.EVENT_COLUMNS)


def door_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: line crossings counted by camera and door."""
    found = crossings.line_crossings(fx.tracks(spark, sf_dir), fx.lines(spark))
    return occupancy.per_door(found, ("camera_name", "door_id"))


def line_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossings.line_crossings(fx.tracks(spark, sf_dir), fx.lines(spark), direction=False).select(*EVENTS)


def line_crossings_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossings.line_crossings(fx.tracks(spark, sf_dir), fx.lines(spark), strict=True, direction=False).select(*EVENTS)


def direction_filtered_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossings.line_crossings(fx.tracks(spark, sf_dir), fx.lines(spark)).select(*EVENTS)


def region_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossings.region_crossings(fx.tracks(spark, sf_dir), fx.regions(spark)).select(*EVENTS)


def crossings_mode_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossings.crossings(fx.tracks(spark, sf_dir), fx.lines(spark), fx.regions(spark), "both").select(*EVENTS)


def region_filtered_line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crossings.line_crossings(fx.tracks(spark, sf_dir), fx.lines(spark), direction=False)
    return crossings.line_events_by_region(found, fx.regions(spark)).select(*EVENTS)


def filtered_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossings.filter_tracks(fx.tracks(spark, sf_dir), fx.regions(spark)).select("event_id", "camera_name", "track_id", "frame_idx")


def inside_outside_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossings.inside_counts(fx.tracks(spark, sf_dir), fx.regions(spark))


def movement_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = presence.movement_direction(fx.tracks(spark, sf_dir), 400.0, 320.0)
    return found.select("event_id", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"), "movement")


def edge_partial_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = ("x1", "y1", "x2", "y2")
    return fx.tracks(spark, sf_dir).select(
        "event_id", geo.edge_flag(*box, fx.FRAME_W, fx.FRAME_H).alias("is_edge"), geo.crop_is_usable(*box, fx.FRAME_W, fx.FRAME_H).alias("has_crop")
    )


def confident_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tracks(spark, sf_dir).where(F.col("conf") >= 0.45).groupBy("camera_name").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("mean_conf"))


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tracks(spark, sf_dir).withColumn("id", F.col("track_id"))
    found = boxes.overlapping(rows, rows, ["camera_name", "frame_idx"], ordered=True)
    return found.select("camera_name", "frame_idx", "a_id", "b_id", F.round("iou", 6).alias("iou"))


def occupancy_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.timeline(fx.door_events(spark, sf_dir), fx.SEED_OCCUPANCY).select("event_id", "event", "occupancy", "peak")


def per_door_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.per_door(fx.door_events(spark, sf_dir))


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occupancy.session_summary(fx.door_events(spark, sf_dir), fx.SEED_OCCUPANCY)
    return found.select(
        "room", "session_elapsed_s", "final_occupancy", "total_entered", "total_exited", "peak_occupancy",
        F.date_format("peak_time", "yyyy-MM-dd HH:mm:ss.SSS").alias("peak_time"), F.size("per_door").cast("long").alias("doors")
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.event_log(occupancy.timeline(fx.door_events(spark, sf_dir), fx.SEED_OCCUPANCY))


def fps_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rates.per_second(fx.arrivals(spark, sf_dir))
    return found.select("camera_name", F.date_format("second", "yyyy-MM-dd HH:mm:ss").alias("second"), "n", F.round("rolling_mean", 6).alias("rolling_mean"))


def rolling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rates.rolling_rate(fx.arrivals(spark, sf_dir))
    return found.select("event_id", F.round("rate", 6).alias("rate"), F.round("rolling_rate", 6).alias("rolling_rate"))


def inside_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's inside, by every foot of its camera taken as a point inside; those on the line are refused."""
    fx_, fy_ = geo.crossing_point("x1", "y1", "x2", "y2", "foot")
    rows = fx.tracks(spark, sf_dir).select("camera_name", fx_.alias("px"), fy_.alias("py")).join(F.broadcast(fx.lines(spark)), "camera_name")
    sign = geo.inside_sign("px", "py", "sx", "sy", "ex", "ey")
    return rows.groupBy("camera_name", "door_id", sign.cast("long").alias("inside_sign")).agg(F.count("*").alias("n"))


def latest_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.latest(fx.arrivals(spark, sf_dir), "hour").select("camera_name", "event_id", F.col("rn").cast("long").alias("rn"))


def frame_duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.frame_copies(fx.arrivals(spark, sf_dir), fps=0.01, longest_s=800.0).select("event_id", "copies")


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = fx.tracks(spark, sf_dir).withColumn("track_id", F.when(F.col("frame_idx") >= 5, F.col("track_id")))
    return rates.source_stats(pending)


def max_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.first_frames(fx.tracks(spark, sf_dir), 10).groupBy("camera_name").agg(F.count("*").alias("n"))


def event_flash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.recent_events(fx.door_events(spark, sf_dir), 86400.0).select("camera_name", "event_id", F.col("rn").cast("long").alias("rn"))


def presence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.segments(fx.tracks(spark, sf_dir))


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.departures(fx.tracks(spark, sf_dir))


def departure_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracklets.departure_views(fx.observations(spark, sf_dir))
    return found.select("camera_name", "track_id", "last_tick", F.array_join(F.transform("views", lambda v: v.cast("string")), ",").alias("views"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.features(spark, sf_dir)
    found = similarity.top_k(rows.where("id % 100 = 0"), rows, 5)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "gallery_id", F.round("similarity", 6).alias("similarity"))


def cmc_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.features(spark, sf_dir)
    return metrics.cmc_map(rows.where("id % 5 = 0"), rows.where("id % 5 <> 0"))


def similarity_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.similarity_separation(fx.features(spark, sf_dir))


def triplet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.features(spark, sf_dir)
    part = lambda k, name: rows.where(F.col("id") % 3 == k).select(F.floor(F.col("id") / 3).alias("t"), vec.doubles("embedding").alias(name))
    return metrics.triplet_loss(part(0, "anchor").join(part(1, "positive"), "t").join(part(2, "negative"), "t"))


def batch_hard_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.batch_hard_loss(fx.features(spark, sf_dir).withColumn("batch", F.floor(F.col("id") / fx.BATCH)), strict=True)


def batch_hard_loss_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.batch_hard_loss(fx.features(spark, sf_dir).withColumn("batch", F.floor(F.col("id") / fx.BATCH)))
    return found.select("batch", "anchors", F.round("loss", 3).alias("loss"))


def tracklet_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracklets.maturity(fx.observations(spark, sf_dir), 3, 5).drop("seg")


def tracklet_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracklets.queries(fx.observations(spark, sf_dir), 3, 5)
    return found.select(
        "camera_name", "track_id", "mature_frame", F.size("views").cast("long").alias("views"), F.posexplode("embedding").alias("i", "v")
    ).select("camera_name", "track_id", "mature_frame", "views", "i", F.round("v", 6).alias("v"))


def identity_match_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gallery.match_tracklets(fx.features(spark, sf_dir).select("id", "embedding"), 0.3, block=64)  # small blocks, so that bounds decide which ones meet
    return found.select("id", "matched_id", F.round("similarity", 6).alias("similarity"), "global_id")


def gallery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.features(spark, sf_dir)
    found = gallery.match_tracklets(rows.select("id", "embedding"), 0.3).select("id", "global_id")
    return gallery.statistics(found.join(rows.select("id", F.col("cid").alias("camera_name")), "id"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by site: forty tracks and four cameras each, so there are more sites as there are more tracks."""
    site = F.concat(F.lit("Site_"), F.floor(F.col("track_id") / 40).cast("string"))
    return fx.observations(spark, sf_dir).withColumns({"site_id": site, "t": F.col("frame_idx") / 25.0})


SITE_LIMITS = gallery.Limits(strict=0.35, edge=0.30, re_entry=0.25)


def identity_resolve_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities over the cameras of each site; sites run in parallel."""
    return gallery.resolve(_sites(spark, sf_dir), SITE_LIMITS, 3, 5)


def stream_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream."""
    return _streamed(spark, _sites(spark, sf_dir), lambda s: processors.stream_identities(s, SITE_LIMITS, 3, 5), "frame_idx", "site_id")


def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracklets.reservoir(fx.features(spark, sf_dir).select("id", "pid"), "id", "pid").select("pid", "id", "anchor")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tracks(spark, sf_dir)
    return rows.select(
        F.concat_ws("_", "camera_name", "frame_idx").alias("image_id"), F.col("event_id").alias("order"), F.col("x1").alias("x"),
        F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.lit(fx.FRAME_W).alias("width"),
        F.lit(fx.FRAME_H).alias("height")
    )


def yolo_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = etl.yolo_labels(_boxes(spark, sf_dir), 70.0)
    return found.select(
        "image_id", "order", *[F.round(c, 10).alias(c) for c in ("xc", "yc", "w", "h")]
    )  # shares of the frame end within ten digits or never, so none is a tie


def yolo_normalize_unclipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = etl.yolo_labels(_boxes(spark, sf_dir), clipped=False)
    return found.select(
        "image_id", "order", *[F.round(c, 10).alias(c) for c in ("xc", "yc", "w", "h")]
    )  # shares of the frame end within ten digits or never, so none is a tie


def annotation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    images = rows.select("image_id").distinct()
    files = images.where(~F.col("image_id").endswith("0"))
    return etl.conversion_counts(images, rows, files, etl.yolo_labels(rows, 100.0))


def rotation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = etl.rotations(fx.images(spark, sf_dir))
    return found.groupBy("rotation", "kind", "dataset").agg(F.count("*").alias("n"))


def rotation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.rotation_report(etl.rotations(fx.images(spark, sf_dir)))


def rotation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.rotation_members(etl.rotations(fx.images(spark, sf_dir))).select("rotation", "path", "kind")


def training_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.training_plan(etl.rotations(fx.images(spark, sf_dir)))


def sweep_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = etl.sweep_grid(spark, [0.15, 0.25, 0.35], [0.45, 0.55, 0.65], [640, 960])
    done = spark.createDataFrame([(0.15, 0.45, 640), (0.25, 0.55, 960), (0.35, 0.65, 640), (0.35, 0.65, 640)], "conf double, iou double, imgsz int")
    return etl.remaining(grid, done)


def training_history_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = fx.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return metrics.best_so_far(history).select("epoch", "loss", "is_best", "best", F.round("lr", 12).alias("lr"))


STEPS, STEP_FILES = 3, 4
#: Rows of such a file at most, but for one key's: many rows make more than ``STEP_FILES`` of them.
FILE_ROWS = 100_000


def _arrived(rows: DataFrame, order: str, *keys: str) -> tuple[str, int]:
    """``rows`` as files that arrive in ``STEPS`` steps of ``order``; a step has a key's rows in one file. They are worked out once.

    Returns the folder and the number of files of a step.
    """
    path = fresh_dir(rows.sparkSession, "stream")
    rows = written(rows, "arriving")
    files = max(STEP_FILES, -(-rows.count() // (STEPS * FILE_ROWS)))
    at = F.col(order).cast("double")
    cuts = rows.agg(F.percentile_approx(at, [k / STEPS for k in range(1, STEPS)])).first()[0] or []
    step = sum((at > x).cast("int") for x in cuts) if cuts else F.lit(0)
    for k in range(len(cuts) + 1):
        rows.where(step == k).repartition(files, *keys).write.mode("append").parquet(f"{path}/in")
    dropped(rows)
    return path, files


def _source(spark: SparkSession, path: str, files: int, rows: DataFrame) -> DataFrame:
    """The files as a stream, a step's number of them in each micro-batch."""
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")


def _streamed(spark: SparkSession, rows: DataFrame, make: Callable[[DataFrame], DataFrame], order: str, *keys: str) -> DataFrame:
    """``rows`` written as files, read as a stream to its end in several micro-batches, and what the stream wrote."""
    path, files = _arrived(rows, order, *keys)
    stream = make(_source(spark, path, files, rows))
    processors.run_to_end(stream, f"{path}/out", f"{path}/state")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


TRACK = ("camera_name", "track_id")


def stream_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, fx.tracks(spark, sf_dir), lambda s: processors.stream_crossings(s, fx.lines(spark)), "frame_idx", *TRACK).select(*EVENTS)


def stream_direction_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda s: processors.stream_crossings(s, fx.lines(spark), direction=True)
    return _streamed(spark, fx.tracks(spark, sf_dir), make, "frame_idx", *TRACK).select(*EVENTS)


def stream_region_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda s: processors.stream_region_crossings(s, fx.regions(spark))
    return _streamed(spark, fx.tracks(spark, sf_dir), make, "frame_idx", *TRACK).select(*EVENTS)


def stream_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.door_events(spark, sf_dir)
    path, files = _arrived(rows, "ts", "event_id")
    processors.count_to_end(_source(spark, path, files, rows), f"{path}/out", f"{path}/state", fx.SEED_OCCUPANCY)
    return spark.read.schema(processors.COUNTED).parquet(f"{path}/out/rows").select("event_id", "event", "occupancy")


def _told(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    """What the stream of tracks, with a heartbeat at its end, tells of the kind; a frame's time follows from its number, so all cameras keep pace."""
    rows = fx.observations(spark, sf_dir).withColumn("at", F.timestamp_millis(86_400_000 + F.col("frame_idx") * 40)).drop("ts")
    path, files = _arrived(rows, "frame_idx", *TRACK)
    beat = rows.agg((F.max("at") + F.make_interval(mins=F.lit(10))).alias("at")).where("at is not null")
    beat.select(*[F.col(c) if c == "at" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).write.mode("append").parquet(f"{path}/in")
    stream = tracks.stream_tracks(_source(spark, path, files, rows), "vec_id", 3, 5)
    processors.run_to_end(stream, f"{path}/out", f"{path}/state")
    return spark.read.schema(stream.schema).parquet(f"{path}/out").where(F.col("what") == what)


def stream_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, "departure").select(*TRACK, "last_tick", "missing_tick")


def stream_departure_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each track the last departure that has views."""
    found = _told(spark, sf_dir, "departure").where(F.size("views") > 0)
    newest = found.groupBy(*TRACK).agg(F.max_by(F.struct("last_tick", "views"), "last_tick").alias("r"))
    return newest.select(*TRACK, "r.last_tick", F.array_join(F.transform("r.views", lambda v: v.cast("string")), ",").alias("views"))


def stream_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, "maturity").select(*TRACK, "mature_frame", "n_stable", "n_usable")


#: Seconds by which the events of the streamed summary are out of order at most.
LATE_S = 3 * 86_400


def _out_of_order(rows: DataFrame) -> tuple[str, int]:
    """``rows`` as files that arrive by their ``arrival``, and two heartbeats of their source, rows with a time only, long after them."""
    path, files = _arrived(rows, "arrival", "event_id")
    for day in (60, 61):
        beat = rows.agg((F.max("ts") + F.make_interval(days=F.lit(day))).alias("ts")).where("ts is not null")
        beat.select(*[F.col(c) if c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).write.mode("append").parquet(f"{path}/in")
    return path, files


def _shuffled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("arrival", F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(LATE_S)))


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest rows of each camera and hour of a stream that is out of order, with what was dropped for them."""
    rows = _shuffled(fx.arrivals(spark, sf_dir).select("camera_name", "event_id", "ts"))
    path, files = _out_of_order(rows)
    stream = latest.stream_latest(_source(spark, path, files, rows), 3600, 2, f"{LATE_S} seconds")
    processors.run_to_end(stream, f"{path}/out", f"{path}/state")
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select("camera_name", "event_id", "rn", "dropped")


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session of a room whose events arrive out of order by up to ``LATE_S``, and whose source gives two heartbeats at its end."""
    rows = fx.door_events(spark, sf_dir).select("room", "event_id", "ts", "event", "door_id")
    shuffled = _shuffled(rows)
    path, files = _out_of_order(shuffled)
    stream = rooms.stream_summary(_source(spark, path, files, shuffled), fx.SEED_OCCUPANCY, f"{LATE_S} seconds", 3600, 30 * 86_400)
    processors.run_to_end(stream, f"{path}/out", f"{path}/state")
    found = spark.read.schema(stream.schema).parquet(f"{path}/out")
    elapsed = F.round((F.unix_micros("session_end") - F.unix_micros("session_start")) / 1e6, 1)
    doors = F.size(F.from_json("doors", "map<string,array<long>>")).cast("long")
    return found.select(
        "room", elapsed.alias("session_elapsed_s"), "final_occupancy", "total_entered", "total_exited", "peak_occupancy",
        F.date_format("peak_time", "yyyy-MM-dd HH:mm:ss.SSS").alias("peak_time"), doors.alias("doors")
    )


def live_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks replayed through the live source, whose connections fail: each row once."""
    rows = fx.tracks(spark, sf_dir).select("camera_name", "frame_idx", "event_id", "track_id")
    path = fresh_dir(spark, "feed")
    live.stage_feed(rows, f"{path}/feed")
    trouble = json.dumps({"Camera_1": {"3": ["drop", 5]}, "Camera_3": {"0": ["drop", 2], "40": ["drop", 1]}})
    stream = live.live(spark, f"{path}/feed", rows.schema, speed=20, wait_s=0.05, trouble=trouble)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(processingTime="1 second").start(f"{path}/out")
    live.until_read(query, f"{path}/feed", 20)
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals by camera and second of a stream, of the seconds that its watermark has closed."""
    rows = fx.arrivals(spark, sf_dir)
    path, files = _arrived(rows, "ts", "event_id")
    processors.run_to_end(processors.rates(_source(spark, path, files, rows)), f"{path}/out", f"{path}/state")
    found = spark.read.parquet(f"{path}/out")
    return found.select("camera_name", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("second"), "n")


QUERIES = (
    door_entries, line_crossings, line_crossings_strict, direction_filtered_crossings, region_crossings, crossings_mode_both, region_filtered_line_events,
    filtered_tracks, inside_outside_counts, movement_direction, edge_partial_flags, confident_detections, iou_pairs, occupancy_timeline, per_door_counts,
    session_summary, event_log, fps_per_second, latest_buffer, frame_duplication, source_stats, max_frames, event_flash, presence_segments, departures,
    departure_views, cosine_topk, cmc_map, similarity_separation, triplet_loss, batch_hard_loss, batch_hard_loss_compat, tracklet_maturity, tracklet_mean,
    identity_match_set, gallery_stats, identity_resolve_stateful, reservoir_sample, yolo_normalize, yolo_normalize_unclipped, annotation_counts,
    rotation_plan, rotation_report, rotation_members, training_plan, sweep_remaining, training_history_best, stream_crossings, stream_direction_crossings,
    stream_region_crossings, stream_occupancy, stream_rates, stream_identities, stream_departures, stream_departure_views, stream_maturity, stream_summary,
    live_tracks, stream_latest, rolling_rates, inside_signs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*QUERIES, *expressions.QUERIES, *files.QUERIES)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query."""
    return oracle.oracle_sql() | expressions_oracle.oracle_sql() | files_oracle.oracle_sql()
