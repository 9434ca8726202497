"""Rates, buffers and per-source statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_second(events: DataFrame, rolling: int = 30) -> DataFrame:
    """Arrivals of each camera and second, and their mean over the last ``rolling`` seconds that have any."""
    counted = events.groupBy("camera_name", F.date_trunc("second", "ts").alias("second")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("camera_name").orderBy("second").rowsBetween(-(rolling - 1), 0)
    return counted.withColumn("rolling_mean", F.avg("n").over(w))


def rolling_rate(events: DataFrame, frames: int = 30, order: tuple[str, ...] = ("ts", "event_id"), bucket: str = "day") -> DataFrame:
    """Adds ``rate``, one over the seconds since the camera's frame before, and ``rolling_rate``, its mean over the last ``frames`` frames.

    A first frame, and one at the same time as the one before, has no rate and
    is left out of means. Frames are taken in order within buckets of time; a
    bucket also gets the last frames of the buckets before it, of which as many
    as frames are looked at, so a busy camera is spread over many tasks.
    """
    df = events.withColumn("bucket", F.date_trunc(bucket, order[0]))
    w = Window.partitionBy("camera_name", "bucket")
    last = df.withColumn("rn", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).where(F.col("rn") <= frames + 1)
    last = last.groupBy("camera_name", "bucket").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("tail"))
    before = Window.partitionBy("camera_name").orderBy("bucket").rowsBetween(-(frames + 1), -1)
    tails = last.withColumn("tail", F.flatten(F.collect_list("tail").over(before)))
    tails = tails.withColumn("tail", F.slice("tail", F.greatest(F.lit(1), F.size("tail") - frames), frames + 1)).where(F.size("tail") > 0)
    tails = tails.select("camera_name", "bucket", F.explode("tail").alias("r")).select("camera_name", "bucket", *[F.col(f"r.{c}").alias(c) for c in order])
    own = df.select("*", F.lit(False).alias("carried")).unionByName(tails.withColumn("carried", F.lit(True)), allowMissingColumns=True)
    since = (F.unix_micros(order[0]) - F.lag(F.unix_micros(order[0])).over(w.orderBy(*order))) / 1e6
    own = own.withColumn("rate", F.when(since > 0, 1 / since))
    mean = F.avg("rate").over(w.orderBy(*order).rowsBetween(-(frames - 1), 0))
    return own.withColumn("rolling_rate", mean).where("not carried").select(*events.columns, "rate", "rolling_rate")


def latest(events: DataFrame, tick: str = "second", keep: int = 2, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The ``keep`` newest rows of each camera and tick: a buffer that drops the oldest."""
    w = Window.partitionBy("camera_name", F.date_trunc(tick, order[0])).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)


def frame_copies(events: DataFrame, fps: float = 25.0, longest_s: float = 5.0, order: tuple[str, ...] = ("ts", "event_id"), bucket: str = "hour") -> DataFrame:
    """Adds ``copies``: how often a live frame is written so that the file keeps the source's pace.

    The time before a frame is looked up within buckets of time; a bucket's
    first frame takes it from a table of the buckets' last ones, so a busy
    camera is spread over many tasks.
    """
    df = events.withColumn("bucket", F.date_trunc(bucket, order[0]))
    last = df.groupBy("camera_name", "bucket").agg(F.max(order[0]).alias("last"))
    carried = last.withColumn("carried", F.lag("last").over(Window.partitionBy("camera_name").orderBy("bucket"))).drop("last")
    before = F.coalesce(F.lag(order[0]).over(Window.partitionBy("camera_name", "bucket").orderBy(*order)), "carried")
    df = df.join(carried, ["camera_name", "bucket"]).withColumn("elapsed", (F.unix_micros(order[0]) - F.unix_micros(before)) / 1e6)
    copies = F.greatest(F.lit(1), F.least(F.bround(F.col("elapsed") * fps).cast("long"), F.lit(int(longest_s * fps))))
    return df.withColumn("copies", F.when(F.col("elapsed").isNull(), 1).otherwise(copies).cast("long")).select(*events.columns, "copies")


def duplicated_frames(events: DataFrame, **how) -> DataFrame:
    """A row for each written frame."""
    return frame_copies(events, **how).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def first_frames(tracks: DataFrame, n: int) -> DataFrame:
    """Each camera's first ``n`` frames."""
    return tracks.where(F.col("frame_idx") < n)


def source_stats(tracks: DataFrame, identity: str = "track_id", elapsed_s: float | None = None) -> DataFrame:
    """Frames, detections and persons of each source. ``persons_compat`` counts pending ones (null) as one more person."""
    pending = F.max(F.when(F.col(identity).isNull(), 1).otherwise(0))
    persons = F.count_distinct(identity)
    out = tracks.groupBy("camera_name").agg(
        F.count_distinct("frame_idx").alias("frames"), F.count("*").alias("detections"), persons.alias("persons"), (persons + pending).alias("persons_compat")
    )
    out = out.withColumn("per_frame", F.round(F.col("detections") / F.greatest("frames", F.lit(1)), 3))
    return out if elapsed_s is None else out.withColumn("avg_fps", F.lit(0.0) if elapsed_s <= 0 else F.round(F.col("frames") / elapsed_s, 3))


def recent_events(events: DataFrame, seconds: float = 3.0, most: int = 8, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each camera's events of the last ``seconds`` before its newest, ``most`` at most."""
    newest = events.groupBy("camera_name").agg(F.max(order[0]).alias("newest"))
    near = events.join(newest, "camera_name").where(F.unix_micros("newest") - F.unix_micros(order[0]) <= int(seconds * 1e6))
    w = Window.partitionBy("camera_name").orderBy(*[F.desc(c) for c in order])
    return near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("newest")


def latency(runs: DataFrame, elapsed: str = "elapsed_s") -> DataFrame:
    total = F.sum(elapsed)
    n = F.count("*")
    fps, each = F.when(total > 0, n / total).otherwise(0.0), F.when(n > 0, total * 1000 / n).otherwise(0.0)
    return runs.agg(n.alias("frames"), fps.alias("fps"), each.alias("ms_per_frame"))
