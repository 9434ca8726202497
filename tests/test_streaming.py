"""Streams against their batch form: several micro-batches, a stop and a resume, expiry and watermarks."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import crossings, occupancy
from trackloom.streaming import processors

TRACK = "camera_name string, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double"
LINE = "camera_name string, door_id string, sx int, sy int, ex int, ey int, inside_sign int, band_width int, direction string, crossing_point string"
LINES = [
    ("c", "d", 20, -300, 120, 500, 1, 15, "both", "foot"), ("c", "e", 20, -300, 120, 500, -1, 5, "Entry", "center"),
    ("c", "x", 150, -300, 50, 500, 1, 10, "exit", "top")
]
EVENT = ["camera_name", "door_id", "track_id", "frame_idx", "event", "px", "py"]


def walk(seed, tracks=8, frames=90):
    rng, rows = random.Random(seed), []
    for t in range(tracks):
        x, y = rng.randint(-50, 200), rng.randint(0, 200)
        for f in range(frames):
            x, y = x + rng.randint(-40, 40), y + rng.randint(-40, 40)
            if rng.random() > 0.1:
                rows.append(("c", t, f, x - 10 + 0.5, y - 60 + 0.25, x + 11 + 0.75, y + 0.5))
    return rows


def feed(spark, df, folder, cuts, make, out, state):
    """Files for each stretch between ``cuts``; the stream runs to its end after every second one, so it stops and goes on."""
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        df.where(f"frame_idx >= {low} and frame_idx < {high}").coalesce(1).write.mode("append").parquet(folder)
        if k % 2 or k == len(cuts) - 2:
            stream = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder))
            processors.run_to_end(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)


def told(df):
    return sorted(tuple(r) for r in df.select(*EVENT).collect())


@pytest.mark.parametrize("strict", [False, True])
def test_streamed_directions_equal_the_batch(spark, tmp_path, strict):
    df, lines = spark.createDataFrame(walk(5), TRACK), spark.createDataFrame(LINES, LINE)
    make = lambda s: processors.stream_crossings(s, lines, direction=True, strict=strict)
    found = feed(spark, df, str(tmp_path / "in"), (0, 25, 50, 90), make, str(tmp_path / "out"), str(tmp_path / "state"))
    want = told(crossings.line_crossings(df, lines, strict=strict))
    assert told(found) == want
    assert len(want) > 10
    assert len(want) < crossings.line_crossings(df, lines, strict=strict, direction=False).count()


def test_streamed_regions_equal_the_batch(spark, tmp_path):
    polygon = [{"x": x, "y": y} for x, y in ((1, 1), (160, 10), (90, 220), (60, 60))]
    regions = spark.createDataFrame(
        [("c", "R", polygon, "foot"), ("b", "R", polygon[:2], "foot")],
        "camera_name string, room string, polygon array<struct<x:int,y:int>>, crossing_point string"
    )
    df = spark.createDataFrame(walk(6), TRACK)
    found = feed(
        spark, df, str(tmp_path / "in"), (0, 30, 60, 90), lambda s: processors.stream_region_crossings(s, regions), str(tmp_path / "out"),
        str(tmp_path / "state")
    )
    want = told(crossings.region_crossings(df, regions))
    assert told(found) == want
    assert len(want) > 5


def test_rooms_are_counted_over_batches_and_a_stop(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab" if i < 150 else "abc"), i, i * 977, rng.choice(("ENTRY", "EXIT", "EXIT", "other"))) for i in range(300)]
    df = spark.createDataFrame(rows, "room string, event_id long, s long, event string").withColumn("ts", F.timestamp_seconds(F.col("s") * 60)).drop("s")
    for k, (low, high) in enumerate(((0, 60), (60, 150), (150, 220), (220, 300))):
        df.where(f"event_id >= {low} and event_id < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k % 2:
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            processors.count_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"), 2)
    found = spark.read.schema(processors.COUNTED).parquet(str(tmp_path / "out" / "rows"))
    assert len(list((tmp_path / "out" / "rows").glob("batch=*"))) == 4
    want = occupancy.timeline(df, 2)
    key = ["room", "event_id", "occupancy"]
    assert sorted(tuple(r) for r in found.select(*key).collect()) == sorted(tuple(r) for r in want.select(*key).collect())


def test_counts_start_from_a_table(spark):
    rows = [("a", 1, "ENTRY"), ("a", 2, "EXIT"), ("b", 3, "EXIT"), ("b", 4, "ENTRY")]
    df = spark.createDataFrame(rows, "room string, event_id long, event string").withColumn("ts", F.timestamp_seconds("event_id"))
    start = spark.createDataFrame([("a", 5)], "room string, initial long")
    assert sorted((r.room, r.event_id, r.occupancy, r.peak) for r in occupancy.timeline(df, start).collect()) == [("a", 1, 6, 6), ("a", 2, 5, 6), ("b", 3, 0, 0), ("b", 4, 1, 1)]


@pytest.mark.parametrize("keep_s, events", [(5, 0), (600, 1)])
def test_a_track_that_is_gone_is_forgotten(spark, tmp_path, keep_s, events):
    """The next frame of a track comes after its state's time: with it gone there is no side to have crossed from. Timers go off in runs that end."""
    lines = spark.createDataFrame([("c", "d", 100, -500, 100, 500, 1, 5, "both", "foot")], LINE)
    steps = [(1, 0, 0.0, 100), (2, 0, 0.0, 200), (3, 0, 0.0, 201), (1, 1, 200.0, 202)]
    for track, frame, x, s in steps:
        row = spark.createDataFrame([("c", track, frame, x, 0.0, x + 20.0, 50.0)], TRACK).withColumn("ts", F.timestamp_seconds(F.lit(s)))
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(row.schema).parquet(str(tmp_path / "in"))
        made = processors.stream_crossings(stream, lines, keep_s=keep_s)
        processors.run_to_end(made, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.schema(made.schema).parquet(str(tmp_path / "out")).count() == events


def test_state_of_tracks_that_are_gone_is_dropped(spark, tmp_path):
    """Of forty tracks, a second each, the state store keeps those of the last seconds."""
    lines = spark.createDataFrame([("c", "d", 100, -500, 100, 500, 1, 5, "both", "foot")], LINE)
    df = spark.createDataFrame([("c", t, 0, 0.0, 0.0, 20.0, 50.0) for t in range(40)], TRACK).withColumn("ts", F.timestamp_seconds(F.col("track_id") + 100))
    for k in range(0, 40, 8):
        df.where(f"track_id >= {k} and track_id < {k + 8}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    processors.run_to_end(processors.stream_crossings(stream, lines, keep_s=3, late="1 second"), str(tmp_path / "out"), str(tmp_path / "state"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.STATE_STORE)
    try:
        left = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "last").load().count()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert 0 < left < 8


def test_rates_leave_out_what_is_too_late(spark, tmp_path):
    """A second is told once the watermark has passed it; rows behind the watermark change nothing."""
    at = lambda *seconds: spark.createDataFrame([("c", float(s)) for s in seconds], "camera_name string, s double").select("camera_name", F.timestamp_seconds("s").alias("ts")).coalesce(1)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for rows in (at(1.1, 1.2, 2.5, 30.0), at(1.5, 25.0, 26.0), at(60.0)):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        processors.run_to_end(processors.rates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "10 seconds"), out, state)
    found = spark.read.parquet(out).select(F.unix_seconds("window.start").alias("s"), "n")
    assert sorted((r.s, r.n) for r in found.collect()) == [(1, 2), (2, 1), (25, 1), (26, 1), (30, 1)]


def test_the_log_of_a_stream_is_appended_by_day(spark, tmp_path):
    from trackloom.sources import results

    rows = [(1, "2024-01-01 23:59:59.123", "ENTRY", 1), (2, "2024-01-02 00:00:01.5", "EXIT", 0)]
    df = spark.createDataFrame(rows, "track_id long, s string, event string, occupancy long")
    df = df.select(F.col("s").cast("timestamp").alias("ts"), F.lit("c").alias("camera_name"), F.lit("d").alias("door_id"), "event", "track_id", "occupancy")
    for part in (df.where("track_id = 1"), df.where("track_id = 2")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = results.event_log(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        processors.append_log(log, str(tmp_path / "log"), str(tmp_path / "state"), every=None).awaitTermination()
    back = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert sorted((r.timestamp, r.door_name, str(r.event_date)) for r in back.collect()) == [
        ("2024-01-01 23:59:59.123", "d", "2024-01-01"), ("2024-01-02 00:00:01.500", "d", "2024-01-02")
    ]


def test_tracks_share_calls_and_state(spark, tmp_path):
    """Three hundred tracks of a camera are two keys of the state store, and their events are the batch's."""
    lines = spark.createDataFrame(LINES[:1], LINE)
    rows = [("c", t, f, x, 0.0, x + 20.0, 50.0) for t in range(300) for f, x in ((0, -100.0), (1, 300.0), (3, -100.0), (4, 300.0 if t % 2 else -100.0))]
    df = spark.createDataFrame(rows, TRACK)
    found = feed(spark, df, str(tmp_path / "in"), (0, 1, 5), lambda s: processors.stream_crossings(s, lines), str(tmp_path / "out"), str(tmp_path / "state"))
    assert told(found) == told(crossings.line_crossings(df, lines, direction=False)) and found.count() == 450
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.STATE_STORE)
    try:
        kept = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "last").load().count()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert kept == 2
