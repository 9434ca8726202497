"""Tracks of a stream against the batch operators: several micro-batches, a stop and a resume, state that goes with the watermark."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import presence, tracklets
from trackloom.streaming import processors, tracks

OBSERVED = "camera_name string, track_id long, frame_idx long, embedding array<double>, is_edge boolean, vec_id long"


def observed(seed, cameras=2, walkers=6, frames=60):
    rng, rows = random.Random(seed), []
    for c in range(cameras):
        for t in range(walkers):
            here = rng.random() < 0.7
            for f in range(frames):
                here = here if rng.random() < 0.85 else not here
                if here and f % 9:  # every ninth frame is empty
                    rows.append((f"c{c}", t, f, [0.0, 0.0] if rng.random() < 0.2 else [1.0, 2.0], rng.random() < 0.3, len(rows)))
    return rows


def timed(df):
    return df.withColumn("at", F.timestamp_millis(F.col("frame_idx") * 40))


def feed(spark, df, tmp_path, cuts, stops, beat_min=10, **how):
    """A file for each stretch of frames; the stream runs to its end after every ``stops`` of them."""
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, (low, high) in enumerate(zip(cuts, cuts[1:]), 1):
        if high == cuts[-1]:  # the source's heartbeat, long after its last frame
            beat = df.agg((F.max("at") + F.make_interval(mins=F.lit(beat_min))).alias("at"))
            beat = beat.select(*[F.col(c) if c == "at" else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        df.where(f"frame_idx >= {low} and frame_idx < {high}").coalesce(1).write.mode("append").parquet(folder)
        if high == cuts[-1] and beat_min:
            beat.coalesce(1).write.mode("append").parquet(folder)
        if k % stops == 0 or k == len(cuts) - 1:
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
            processors.run_to_end(tracks.stream_tracks(stream, "vec_id", 3, 5, **how), out, state)
    return spark.read.schema(tracks.TOLD).parquet(out)


@pytest.mark.parametrize("stops", [10, 1])
def test_streamed_tracks_equal_the_batch(spark, tmp_path, stops):
    df = timed(spark.createDataFrame(observed(1), OBSERVED))
    found = feed(spark, df, tmp_path, (0, 13, 14, 30, 47, 60), stops).cache()
    left = sorted(tuple(r) for r in found.where("what = 'departure'").select("camera_name", "track_id", "last_tick", "missing_tick").collect())
    assert left == sorted(tuple(r) for r in presence.departures(df).collect()) and len(left) > 20
    ripe = sorted(tuple(r) for r in found.where("what = 'maturity'").select("camera_name", "track_id", "mature_frame", "n_stable", "n_usable").collect())
    assert ripe == sorted(tuple(r) for r in tracklets.maturity(df, 3, 5).drop("seg").collect()) and ripe
    newest = found.where("size(views) > 0").groupBy("camera_name", "track_id").agg(F.max_by(F.struct("last_tick", "views"), "last_tick").alias("r"))
    views = sorted((r.camera_name, r.track_id, r.r.last_tick, list(r.r.views)) for r in newest.collect())
    assert views == sorted((r.camera_name, r.track_id, r.last_tick, list(r.views)) for r in tracklets.departure_views(df).collect())


def test_state_goes_with_the_watermark(spark, tmp_path):
    """Each track is there for a second; the state store never holds more than those of the time that is kept."""
    rows = [("c", f // 25, f, [1.0], False, f) for f in range(25 * 40)]
    df = timed(spark.createDataFrame(rows, OBSERVED))
    cuts = tuple(range(0, 1001, 50))
    found = feed(spark, df, tmp_path, cuts, 100, beat_min=0, keep_s=4, late="1 second")
    assert found.where("what = 'departure'").count() == 39
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.STATE_STORE)
    try:
        stored = {}
        for operator in (0, 1):
            for name in ("counts", "last"):
                try:
                    stored[name] = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("operatorId", operator).option("stateVarName", name).load().count()
                except Exception:  # noqa: BLE001  # the other operator of the chain has this variable
                    continue
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert 0 < stored["counts"] < 12
    assert stored["last"] <= 5 * 12
