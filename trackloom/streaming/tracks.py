"""Departures, last views and maturity of tracks while their cameras' streams run.

Two stateful operators in a chain. A camera's clock sees only which tracks are in
which frame. A frame is complete when a later one arrives, or when the watermark
has passed its time; only frames with detections count, and a track that was in
the complete frame before and isn't in this one has left: the clock tells it so
in a row of its own. A track's operator gets its observations and those rows, in
the order of frames; it keeps the last few usable views as a list and the counts
of its stretch. Tracks share its keys in buckets of neighbouring numbers.

Time is event time. A track's time is ``keep`` behind its last row; when
the watermark has passed it, all its state goes, so what is kept is bounded by
the tracks of that time, and a track that comes back later starts anew. Rows of
a frame that is complete already are too late and left out.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import vec
from ..operators import tracklets
from ..session import ship_package
from .processors import bucket

# a stateful processor is also loaded by a worker on the driver, which shipped archives don't reach
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT_VIEWS = 5
GONE = "camera_name string, track_id long, frame_idx long, last_tick long, missing_tick long, at timestamp"
TOLD = (
    "camera_name string, track_id long, what string, last_tick long, missing_tick long, views array<long>, mature_frame long, n_stable long, n_usable long, "
    "at timestamp"
)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _frame_of(rows: list[tuple], ddl: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_names(ddl))
    for column, kind in (c.split() for c in ddl.split(", ")):
        if kind == "long":
            out[column] = pd.array(out[column], "Int64")
    return out


class CameraClock(StatefulProcessor):
    """Key: camera. Keeps the tracks of the last complete frame and of the one that is open; ``frame`` is complete if it has no timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "frame long, tick long, before long, timer long")
        self.present = handle.getMapState("present", "track_id long", "tick long")
        self.opened = handle.getMapState("opened", "track_id long", "frame long")

    def _read(self) -> tuple:
        frame, tick, before, timer = self.clock.get() if self.clock.exists() else (None, 0, None, None)
        present, opened = ({k[0] for k in state.keys()} if state.exists() else set() for state in (self.present, self.opened))
        return frame, tick, before, timer, present, opened

    def _keep(self, frame: int, tick: int, before: int | None, timer: int | None, present: set, opened: set) -> None:
        self.clock.update((frame, tick, before, timer))
        for state, tracks in ((self.present, present), (self.opened, opened)):
            state.clear()
            for t in tracks:
                state.updateValue((t,), (tick,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        data = pd.concat(list(rows)).sort_values("frame_idx")
        frame, tick, before, timer, present, opened = self._read()
        set_timer, gone = timer, []
        for f, tracks in data.groupby("frame_idx", sort=True):
            f, at = int(f), tracks["at"].max()
            if frame is not None and (f < frame or (f == frame and timer is None)):
                continue
            if frame is not None and f > frame and timer is not None:
                tick += 1
                gone += [(key[0], t, before, tick - 1, tick, at) for t in sorted(present - opened)]
                present, opened, before = opened, set(), frame
            frame, timer = f, int(at.timestamp() * 1000)
            opened |= set(tracks["track_id"].astype(int).tolist())
        if timer != set_timer:
            if set_timer is not None:
                self.handle.deleteTimer(set_timer)
            self.handle.registerTimer(timer)
        self._keep(frame, tick, before, timer, present, opened)
        if gone:
            yield _frame_of(gone, GONE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the open frame: no row of it can come."""
        frame, tick, before, _, present, opened = self._read()
        tick += 1
        at = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        gone = [(key[0], t, before, tick - 1, tick, at) for t in sorted(present - opened)]
        self._keep(frame, tick, frame, None, opened, set())
        if gone:
            yield _frame_of(gone, GONE)

    def close(self) -> None:
        pass


class TrackProcessor(StatefulProcessor):
    """Key: camera and bucket of tracks. Input rows are observations and, with ``missing_tick``, what the camera's clock tells.

    The state is, for each track, its counts and when it may go, and its last
    views. The bucket's timer is set to the first of those times.
    """

    stable, most, keep_ms, views = tracklets.STABLE_FRAMES, tracklets.ANY_FRAMES, 3_600_000, KEPT_VIEWS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "data binary, timer long")
        self.last = handle.getValueState("last", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        data = pd.concat(list(rows))
        data = data.assign(told=data["missing_tick"].notna()).sort_values(["frame_idx", "told"], kind="stable")
        counts, last, timer = self._read()
        out = []
        for track, own in data.groupby("track_id", sort=False, dropna=False):
            track = None if pd.isna(track) else int(track)
            frame, usable, stable, mature, due = counts.get(track, (None, 0, 0, False, 0))
            views = last.get(track, [])
            for r in own.itertuples(index=False):
                if r.told:
                    out.append((key[0], track, "departure", int(r.last_tick), int(r.missing_tick), views, None, None, None, r.at))
                    views = []
                    continue
                if frame is None or r.frame_idx != frame + 1:
                    usable = stable = 0
                frame = int(r.frame_idx)
                if r.usable:
                    usable += 1
                    stable += not r.is_edge
                    views = [*views, int(r.view)][-self.views :]
                if not mature and (stable >= self.stable or usable >= self.most):
                    mature = True
                    out.append((key[0], track, "maturity", None, None, None, frame, stable, usable, r.at))
            counts[track] = frame, usable, stable, mature, max(due, int(own["at"].max().timestamp() * 1000) + self.keep_ms)
            last[track] = views
        self._keep(counts, last, timer)
        if out:
            yield _frame_of(out, TOLD)

    def _read(self) -> tuple[dict, dict, int | None]:
        if not self.counts.exists():
            return {}, {}, None
        data, timer = self.counts.get()
        return pickle.loads(data), pickle.loads(self.last.get()[0]), timer

    def _keep(self, counts: dict, last: dict, timer: int | None) -> None:
        """``timer`` is the one that is set."""
        due = min((x[-1] for x in counts.values()), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if counts:
            self.counts.update((pickle.dumps(counts), due))
            self.last.update((pickle.dumps(last),))
        else:
            self.counts.clear()
            self.last.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Of the bucket's tracks those go whose time the watermark has passed."""
        counts, last, _ = self._read()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        counts = {t: x for t, x in counts.items() if x[-1] > passed}
        self._keep(counts, {t: last[t] for t in counts}, None)
        return iter(())

    def close(self) -> None:
        pass


def stream_tracks(
    observations: DataFrame, view: str, stable: int = tracklets.STABLE_FRAMES, most: int = tracklets.ANY_FRAMES, keep_s: int = 3600, late: str = "10 seconds"
) -> DataFrame:
    """Rows of ``TOLD`` as soon as they are known: each departure with its last usable views, and each track's first mature frame.

    ``observations`` is a stream of camera_name, track_id, frame_idx, embedding,
    is_edge, ``at`` (the frame's event time) and the column ``view``, which names
    an observation. Cameras may be ``late`` against each other by so much. Rows
    without a camera are a source's heartbeat: they only move the watermark on.
    """
    ship_package(observations.sparkSession)
    seen = observations.select(
        "camera_name", F.col("track_id").cast("long"), F.col("frame_idx").cast("long"), "at", vec.is_nonzero(F.col("embedding")).alias("usable"), "is_edge",
        F.col(view).cast("long").alias("view")
    ).withWatermark("at", late)
    clock = seen.select("camera_name", "track_id", "frame_idx", "at").groupBy("camera_name")
    gone = clock.transformWithStateInPandas(CameraClock(), GONE, "Append", "EventTime", eventTimeColumnName="at")
    nothing = lambda kind: F.lit(None).cast(kind)
    both = seen.select("*", nothing("long").alias("last_tick"), nothing("long").alias("missing_tick")).unionByName(
        gone.select("*", nothing("boolean").alias("usable"), nothing("boolean").alias("is_edge"), nothing("long").alias("view"))
    )
    processor = TrackProcessor()
    processor.stable, processor.most, processor.keep_ms = stable, most, keep_s * 1000
    return both.withColumn("bucket", bucket()).groupBy("camera_name", "bucket").transformWithStateInPandas(processor, TOLD, "Append", "EventTime", eventTimeColumnName="at")
