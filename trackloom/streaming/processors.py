"""Crossings, identities and occupancy of unbounded tracks.

Row-based windows don't exist on streams, so the state that batch operators
read from earlier rows is kept by key: a track's last side and place, a site's
gallery. Rows of a micro-batch are handled in the order of their frames. A track
that misses a frame of its camera starts anew, which its next row's frame number
shows. Tracks share keys in buckets of neighbouring numbers, as a call and an
access to the state for each track would take most of the time. A key's rows of one micro-batch are in one task, so micro-batches are to
be bounded by the source (``maxFilesPerTrigger``). A room's count, for which all
doors of a room matter, is carried from batch to batch and distributed within.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import geo
from ..operators import crossings, gallery, occupancy
from ..session import ship_package

# a stateful processor is also loaded by a worker on the driver, which shipped archives don't reach
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(gallery)

CROSSED = "camera_name string, track_id long, door_id string, frame_idx long, event string, px long, py long"
COUNTED = "room string, event_id long, ts timestamp, event string, occupancy long"


#: Tracks that share a state value; their numbers are neighbours.
TOGETHER = 256


def bucket(track: str = "track_id") -> Column:
    """The bucket of a track: a call of a processor, and what it reads and writes of the state, serve all its tracks at once."""
    return F.floor(F.col(track) / TOGETHER).cast("long").alias("bucket")


class CrossingProcessor(StatefulProcessor):
    """Key: camera and bucket of tracks. Input rows carry the side that counts (null within the band), the foot and the line's direction.

    The state is, for each track and door, the last frame, side and foot, and
    when it may go. The bucket's timer is set to the first of those times.
    """

    keep_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "data binary, timer long")

    @staticmethod
    def allowed(event: str, direction: str, along: float | None) -> bool:
        """Whether the line's direction lets an event pass; ``along`` is the movement's share along it, None at rest or in a first row."""
        if along is None or direction not in ("entry", "exit"):
            return True
        return event == direction.upper() and along > 0.1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values("frame_idx", kind="stable")
        known, timer = self._read()
        out = []
        for (track, door), own in data.groupby(["track_id", "door_id"], sort=False, dropna=False):
            track = None if pd.isna(track) else int(track)
            frame, before, fx, fy, due = known.get((track, door), (None,) * 5)
            for r in own.itertuples(index=False):
                if frame is not None and r.frame_idx != frame + 1:
                    before = fx = None
                along = None
                if fx is not None and (length := math.hypot(r.fx - fx, r.fy - fy)) > 0:
                    along = ((r.fx - fx) * r.ux + (r.fy - fy) * r.uy) / length
                frame, fx, fy = int(r.frame_idx), float(r.fx), float(r.fy)
                if pd.notna(r.side):
                    side = int(r.side)
                    if before is not None and before != side:
                        event = "ENTRY" if side == r.inside_sign else "EXIT"
                        if self.allowed(event, r.direction, along):
                            out.append((key[0], track, door, frame, event, int(r.px), int(r.py)))
                    before = side
            if self.keep_ms is not None:
                due = max(due or 0, int(own["at"].max().timestamp() * 1000) + self.keep_ms)
            known[track, door] = frame, before, fx, fy, due
        self._keep(known, timer)
        if out:
            found = pd.DataFrame(out, columns=[c.split()[0] for c in CROSSED.split(", ")])
            found["track_id"] = pd.array(found["track_id"], "Int64")
            yield found

    def _read(self) -> tuple[dict, int | None]:
        if not self.last.exists():
            return {}, None
        data, timer = self.last.get()
        return pickle.loads(data), timer

    def _keep(self, known: dict, timer: int | None) -> None:
        """``timer`` is the one that is set."""
        due = min((x[-1] for x in known.values()), default=None) if self.keep_ms is not None else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if known:
            self.last.update((pickle.dumps(known), due))
        else:
            self.last.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Of the bucket's tracks those go whose time the watermark has passed."""
        known, _ = self._read()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self._keep({k: x for k, x in known.items() if x[-1] > passed}, None)
        return iter(())

    def close(self) -> None:
        pass


def _watermarked(tracks: DataFrame, keep_s: int | None, late: str) -> DataFrame:
    """``tracks`` with their event time as ``at``, under a watermark if state is to go with it."""
    if keep_s is None:
        return tracks.withColumn("at", F.lit(None).cast("timestamp"))
    return tracks.withColumn("at", F.col("ts")).withWatermark("at", late)


def _crossed(rows: DataFrame, keep_s: int | None) -> DataFrame:
    processor = CrossingProcessor()
    processor.keep_ms = None if keep_s is None else 1000 * keep_s
    fx, fy = geo.crossing_point("x1", "y1", "x2", "y2", "foot")
    keyed = rows.select(
        "camera_name", bucket(), "track_id", "door_id", "frame_idx", "side", "inside_sign", "px", "py", fx.cast("double").alias("fx"), fy.cast("double").alias("fy"),
        F.coalesce("ux", F.lit(0.0)).alias("ux"), F.coalesce("uy", F.lit(0.0)).alias("uy"), F.coalesce("direction", F.lit("both")).alias("direction"), "at",
    )
    mode = "None" if keep_s is None else "EventTime"
    return keyed.groupBy("camera_name", "bucket").transformWithStateInPandas(processor, CROSSED, "Append", mode)


def stream_crossings(
    tracks: DataFrame, lines: DataFrame, keep_s: int | None = None, direction: bool = False, strict: bool = False, late: str = "10 seconds"
) -> DataFrame:
    """Line crossings of a stream of tracks, as :func:`crossings.line_crossings` finds them. Sides are computed before the rows are keyed.

    On a stream without end, ``keep_s`` is how many seconds of event time (``ts``)
    a track that is gone keeps its state: a timer drops it when the watermark,
    ``late`` behind the newest row, has passed. Rows later than that are left out.
    """
    ship_package(tracks.sparkSession)
    df = _watermarked(tracks, keep_s, late).join(F.broadcast(lines), "camera_name")
    px, py = geo.crossing_point("x1", "y1", "x2", "y2", F.coalesce(F.col("crossing_point"), F.lit("foot")))
    df = df.withColumns({"px": px, "py": py})
    ends = ("px", "py", "sx", "sy", "ex", "ey")
    counts = (geo.side(*ends) != 0) & (geo.line_distance(*ends) > F.col("band_width"))
    if strict:
        counts = counts & geo.within_segment(*ends)
    ux, uy = crossings.forward(strict)
    ruled = F.lower("direction") if direction else F.lit("both")
    return _crossed(df.withColumns({"side": F.when(counts, geo.side(*ends)), "ux": ux, "uy": uy, "direction": ruled}), keep_s)


def stream_region_crossings(tracks: DataFrame, regions: DataFrame, keep_s: int | None = None, late: str = "10 seconds") -> DataFrame:
    """Events where a track of a stream enters or leaves its camera's region; ``keep_s`` and ``late`` as in :func:`stream_crossings`."""
    ship_package(tracks.sparkSession)
    df = crossings.with_inside(_watermarked(tracks, keep_s, late), regions).where("inside is not null")
    none = F.lit(0.0)
    side = {"side": F.when(F.col("inside"), 1).otherwise(-1), "inside_sign": F.lit(1), "door_id": F.lit("Room_Entry")}
    return _crossed(df.withColumns(side | {"ux": none, "uy": none, "direction": F.lit("both")}), keep_s)


class GalleryProcessor(StatefulProcessor):
    """Key: site. The state is the site's gallery, pending tracks and last frames, bounded by its limits; ``ttl_ms`` drops a site that is gone."""

    limits: gallery.Limits | None = None
    stable, most = 15, 45
    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.site = handle.getValueState("site", "data binary", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.limits, self.stable, self.most
        site = gallery.Site.of_kept(self.site.get()[0], *known) if self.site.exists() else gallery.Site(*known)
        found = site.rows(pd.concat(list(rows)).sort_values(gallery.ORDER))
        self.site.update((site.kept(),))
        yield gallery.as_resolved(key[0], found)

    def close(self) -> None:
        pass


def stream_identities(observations: DataFrame, limits: gallery.Limits | None = None, stable: int = 15, most: int = 45, ttl_ms: int | None = None) -> DataFrame:
    """:func:`gallery.resolve` for a stream; the rows of a frame come in one micro-batch, and frames of a site in order."""
    ship_package(observations.sparkSession)
    processor = GalleryProcessor()
    processor.limits, processor.stable, processor.most, processor.ttl_ms = limits, stable, most, ttl_ms
    mode = "ProcessingTime" if ttl_ms else "None"
    return gallery.observed(observations).groupBy("site_id").transformWithStateInPandas(processor, gallery.RESOLVED, "Append", mode)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, written as Parquet exactly once; a later call with the same folders goes on from there."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        query.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def count_to_end(events: DataFrame, path: str, checkpoint: str, initial: int = 0) -> None:
    """Clamped occupancy after each event of a stream (room, event_id, ts, event), written under ``path``/rows.

    A micro-batch is counted as :func:`occupancy.timeline` counts, spread over
    buckets of time, from the counts that the batch before left under
    ``path``/counts. A batch that is repeated writes the same folders again, so
    its rows are there once.
    """

    def count(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = None
        if number > 0:
            known = spark.read.schema("room string, initial long").parquet(f"{path}/counts/batch={number - 1}")
            fresh = batch.select("room").distinct().join(known, "room", "left_anti").select("room", occupancy.initial_count(initial).alias("initial"))
            start = known.unionByName(fresh)
        else:
            start = batch.select("room").distinct().select("room", occupancy.initial_count(initial).alias("initial"))
        timed = occupancy.timeline(batch.select("room", "event_id", "ts", "event"), start)
        timed.select("room", "event_id", "ts", "event", "occupancy").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        rows = spark.read.schema(COUNTED).parquet(f"{path}/rows/batch={number}")
        last = rows.groupBy("room").agg(F.max_by("occupancy", F.struct("ts", "event_id")).alias("initial"))
        left = last if known is None else last.unionByName(known.join(last, "room", "left_anti"))
        left.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    events.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_log(log: DataFrame, path: str, checkpoint: str, every: str | None = "10 seconds"):
    """A stream of event-log rows appended as CSV, a folder for each day; without ``every`` it stops at the end of what is there."""
    dated = log.withColumn("event_date", F.substring("timestamp", 1, 10))
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return dated.writeStream.format("csv").option("header", True).partitionBy("event_date").option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


def rates(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Arrivals by camera and second of a stream with a watermark: rows later than that are left out, and a second is told once it can't change."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 second"), "camera_name").agg(F.count("*").alias("n"))
