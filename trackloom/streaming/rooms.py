"""Summaries of rooms' sessions while their streams run: peak, its first time, totals and doors.

What a stretch of events does to a clamped count can be told without knowing the
count before it: with running sums s from the stretch's beginning and l the
lowest of them so far, a count x becomes max(x + s, s - l). So a stretch has a
summary of bounded size - its sum, its lowest running sum, the highest s and the
highest s - l at an entry with the first time of each, and totals by door - and
the summary of two stretches follows from theirs.

A room's events wait by buckets of time, in any order, until the watermark has
passed the bucket's end; a timer then tells the bucket's summary, so an event
that is late, but not later than the watermark, changes one bucket. The summaries
of a room are folded in order of time; when none has come for a while of event
time, a timer closes the session. Events later than the watermark are left out.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship_package

# a stateful processor is also loaded by a worker on the driver, which shipped archives don't reach
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FAR = -(1 << 60)
PART = "room string, bucket long, summary string, at timestamp"
SESSION = (
    "room string, session_start timestamp, session_end timestamp, final_occupancy long, total_entered long, total_exited long, peak_occupancy long, "
    "peak_time timestamp, doors string, at timestamp"
)


def summary_of(events: list[tuple[int, int, int, str | None]]) -> dict:
    """Of events in order: microseconds, event id, 1, -1 or 0, and door."""
    s = entered = exited = 0
    low, doors = -_FAR, {}
    top, spread = (_FAR, 0), (_FAR, 0)
    for us, _, delta, door in events:
        s += delta
        low = min(low, s)
        if delta:
            own = doors.setdefault(door or "", [0, 0])
            own[delta < 0] += 1
        if delta > 0:
            entered += 1
            top = (s, us) if s > top[0] else top
            spread = (s - low, us) if s - low > spread[0] else spread
        elif delta < 0:
            exited += 1
    return {
        "sum": s, "low": low, "top": top, "spread": spread, "entered": entered, "exited": exited, "doors": doors, "first": events[0][0], "last": events[-1][0]
    }


def _first_of(*found: tuple[int, int]) -> tuple[int, int]:
    """The highest, and of equal ones the earliest."""
    return tuple(min(found, key=lambda x: (-x[0], x[1])))


def joined(a: dict, b: dict) -> dict:
    """The summary of a stretch and the one behind it."""
    doors = {k: list(v) for k, v in a["doors"].items()}
    for door, (i, o) in b["doors"].items():
        own = doors.setdefault(door, [0, 0])
        doors[door] = [own[0] + i, own[1] + o]
    up, back = a["sum"], a["sum"] - a["low"]
    return {
        "sum": up + b["sum"], "low": min(a["low"], up + b["low"]), "top": _first_of(a["top"], (up + b["top"][0], b["top"][1])),
        "spread": _first_of(a["spread"], (back + b["top"][0], b["top"][1]), b["spread"]), "entered": a["entered"] + b["entered"],
        "exited": a["exited"] + b["exited"], "doors": doors, "first": a["first"], "last": b["last"],
    }


def told(summary: dict, initial: int) -> tuple[int, int, int]:
    """Final count, peak and the first time of the peak, of a count that begins at ``initial``."""
    x = max(0, initial)
    peak, at = _first_of((x + summary["top"][0], summary["top"][1]), tuple(summary["spread"]))
    return max(x + summary["sum"], summary["sum"] - summary["low"]), max(x, peak), at if peak > x else summary["first"]


def _timestamp(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class BucketProcessor(StatefulProcessor):
    """Key: room and bucket. Events wait in a list until the bucket's end is behind the watermark."""

    bucket_ms = 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "us long, event_id long, delta long, door string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return iter(())
        if not self.events.exists():
            self.handle.registerTimer((int(key[1]) + 1) * self.bucket_ms)
        for part in rows:
            doors = part["door"].where(part["door"].notna(), None).tolist()
            self.events.appendList(list(zip(part["us"].tolist(), part["event_id"].tolist(), part["delta"].tolist(), doors)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        summary = summary_of(sorted(self.events.get(), key=lambda e: (e[0], e[1])))
        self.events.clear()
        at = max((int(key[1]) + 1) * self.bucket_ms, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"room": [key[0]], "bucket": [int(key[1])], "summary": [json.dumps(summary)], "at": [_timestamp(1000 * at)]})

    def close(self) -> None:
        pass


class SessionProcessor(StatefulProcessor):
    """Key: room. The state is one summary, of the session so far."""

    initial, bucket_ms, idle_ms = 0, 60_000, 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.so_far = handle.getValueState("so_far", "summary string, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values("bucket")
        text, timer = self.so_far.get() if self.so_far.exists() else (None, None)
        summary = json.loads(text) if text else None
        for part in map(json.loads, data["summary"]):
            summary = part if summary is None else joined(summary, part)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (int(data["bucket"].max()) + 1) * self.bucket_ms + self.idle_ms
        self.handle.registerTimer(timer)
        self.so_far.update((json.dumps(summary), timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        summary = json.loads(self.so_far.get()[0])
        self.so_far.clear()
        final, peak, at = told(summary, self.initial)
        row = (
            key[0], _timestamp(summary["first"]), _timestamp(summary["last"]), final, summary["entered"], summary["exited"], peak, _timestamp(at),
            json.dumps(summary["doors"], sort_keys=True), _timestamp(1000 * timerValues.getCurrentWatermarkInMs())
        )
        yield pd.DataFrame([row], columns=[c.split()[0] for c in SESSION.split(", ")])

    def close(self) -> None:
        pass


def stream_summary(events: DataFrame, initial: int = 0, late: str = "10 seconds", bucket_s: int = 60, idle_s: int = 3600) -> DataFrame:
    """A row of ``SESSION`` for each session of a room that is over; ``doors`` is JSON: entered and exited by door.

    ``events`` is a stream of room, event_id, ts, event and door_id. Rows without
    a room are a source's heartbeat: they only move the watermark on. The second
    operator sees the watermark one heartbeat later than the first.
    """
    ship_package(events.sparkSession)
    delta = F.when(F.col("event") == "ENTRY", 1).when(F.col("event") == "EXIT", -1).otherwise(0).cast("long")
    us = F.unix_micros("ts")
    # heartbeats go as far as the first operator: a filter here would be pushed below the watermark, which then wouldn't see them
    rows = events.withWatermark("ts", late).select(
        "room", F.floor(us / (bucket_s * 1_000_000)).cast("long").alias("bucket"), us.alias("us"), "event_id", delta.alias("delta"),
        F.col("door_id").alias("door"), "ts"
    )
    buckets, sessions = BucketProcessor(), SessionProcessor()
    buckets.bucket_ms = sessions.bucket_ms = bucket_s * 1000
    sessions.initial, sessions.idle_ms = initial, idle_s * 1000
    parts = rows.groupBy("room", "bucket").transformWithStateInPandas(buckets, PART, "Append", "EventTime", eventTimeColumnName="at")
    return parts.groupBy("room").transformWithStateInPandas(sessions, SESSION, "Append", "EventTime", eventTimeColumnName="at")
