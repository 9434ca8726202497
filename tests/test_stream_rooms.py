"""Summaries of streamed rooms against the batch, with events in any order and a stop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import occupancy
from trackloom.streaming import latest, processors, rooms

EVENTS = "room string, event_id long, us long, event string, door_id string"


def made(seed, n=300, names="ab"):
    rng = random.Random(seed)
    return [(rng.choice(names), i, rng.randrange(3_000) * 1_000_000, rng.choice(("ENTRY", "EXIT", "EXIT", "ENTRY", "other")), rng.choice("xyz")) for i in range(n)]


def counted(events, initial):
    """Final count, peak and first time of the peak, by a loop."""
    count = peak = max(0, initial)
    at = events[0][0]
    for us, _, delta, _ in events:
        count = max(0, count + delta)
        if delta > 0 and count > peak:
            peak, at = count, us
    return count, peak, at


@pytest.mark.parametrize("initial", [0, 2, 40])
def test_summaries_join_at_any_cut(initial):
    for seed in range(60):
        rng = random.Random(seed)
        events = [(i * 7, i, rng.choice((1, -1, -1, 1, 0)), rng.choice("xyz")) for i in range(rng.randrange(1, 40))]
        whole = rooms.summary_of(events)
        assert rooms.told(whole, initial) == counted(events, initial)
        cuts = sorted(rng.sample(range(1, len(events)), min(3, len(events) - 1)))
        parts = [rooms.summary_of(events[a:b]) for a, b in zip([0, *cuts], [*cuts, len(events)])]
        while len(parts) > 1:  # in any order of joining neighbours
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [json.loads(json.dumps(rooms.joined(parts[k], parts[k + 1])))]
        assert rooms.told(parts[0], initial) == rooms.told(whole, initial)
        assert parts[0]["doors"] == whole["doors"] and parts[0]["entered"] == whole["entered"]


@pytest.mark.parametrize("stops", [1, 10])
def test_streamed_sessions_equal_the_batch(spark, tmp_path, stops):
    df = spark.createDataFrame(made(1), EVENTS).withColumn("ts", F.timestamp_micros("us")).drop("us")
    beat = lambda s: spark.createDataFrame([(None, None, s * 1_000_000, None, None)], EVENTS).withColumn("ts", F.timestamp_micros("us")).drop("us")
    parts = [*df.randomSplit([1.0] * 4, 3), beat(20_000), beat(20_001)]
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, part in enumerate(parts, 1):
        part.select("room", "event_id", "event", "door_id", "ts").coalesce(1).write.mode("append").parquet(folder)
        if k % stops == 0 or k == len(parts):
            stream = spark.readStream.schema("room string, event_id long, event string, door_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
            processors.run_to_end(rooms.stream_summary(stream, 3, "3000 seconds", bucket_s=60), out, state)
    found = {r.room: r for r in spark.read.schema(rooms.SESSION).parquet(out).collect()}
    want = {r.room: r for r in occupancy.session_summary(df, 3).collect()}
    assert set(found) == set(want) == {"a", "b"}
    for room, r in want.items():
        own = found[room]
        for name in ("session_start", "final_occupancy", "total_entered", "total_exited", "peak_occupancy", "peak_time"):
            assert own[name] == r[name], (room, name)
        assert {k: tuple(v) for k, v in json.loads(own.doors).items()} == {k: (v.entered, v.exited) for k, v in r.per_door.items() if v.entered or v.exited}


def test_sessions_are_closed_by_time(spark, tmp_path):
    rows = [("a", 1, 100_000_000, "ENTRY", "x"), ("a", 2, 160_000_000, "ENTRY", "x"), ("a", 3, 10_000_000_000, "EXIT", "y"), ("b", 4, 10_500_000_000, "ENTRY", "y")]
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for row in [*rows, (None, None, 30_000_000_000, None, None), (None, None, 30_001_000_000, None, None)]:
        df = spark.createDataFrame([row], EVENTS).withColumn("ts", F.timestamp_micros("us")).drop("us")
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    processors.run_to_end(rooms.stream_summary(stream, 0, idle_s=600), out, state)
    found = spark.read.schema(rooms.SESSION).parquet(out).collect()
    assert sorted((r.room, r.final_occupancy, r.peak_occupancy, r.total_exited) for r in found) == [("a", 0, 0, 1), ("a", 2, 2, 0), ("b", 1, 1, 0)]


@pytest.mark.parametrize("stops", [1, 10])
def test_rings_keep_the_newest_and_count_the_rest(spark, tmp_path, stops):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, 100 + rng.randrange(300)) for i in range(400)]
    rng.shuffle(rows)
    df = lambda part: spark.createDataFrame(part, "camera_name string, event_id long, s long").select("camera_name", "event_id", F.timestamp_seconds("s").alias("ts"))
    parts = [rows[:150], rows[150:151], rows[151:], [(None, None, 9000)]]
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, part in enumerate(parts, 1):
        df(part).coalesce(1).write.mode("append").parquet(folder)
        if k % stops == 0 or k == len(parts):
            stream = spark.readStream.schema(df(part).schema).option("maxFilesPerTrigger", 1).parquet(folder)
            processors.run_to_end(latest.stream_latest(stream, 10, 2, "400 seconds"), out, state)
    found = sorted(tuple(r) for r in spark.read.schema(latest.NEWEST).parquet(out).drop("us").collect())
    groups = {}
    for camera, event, s in rows:
        groups.setdefault((camera, s // 10), []).append((s, event))
    want = [(c, t, e, k, max(0, len(x) - 2)) for (c, t), x in groups.items() for k, (_, e) in enumerate(sorted(x, reverse=True)[:2], 1)]
    assert found == sorted(want)
