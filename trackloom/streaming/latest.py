"""The newest rows of each camera and tick of a stream: a ring of a few slots that drops the oldest and counts what it drops.

A tick is a stretch of event time. Its ring is told, with the drops, by a timer
when the watermark has passed the tick's end; rows may come in any order until
then, later ones are left out.
"""

from __future__ import annotations

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

NEWEST = "camera_name string, tick long, event_id long, us long, rn long, dropped long"


class RingProcessor(StatefulProcessor):
    """Key: camera and tick. The state is ``slots`` rows at most and a count."""

    slots, tick_ms = 2, 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "us long, event_id long")
        self.dropped = handle.getValueState("dropped", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return iter(())
        if self.ring.exists():
            held, dropped = [(int(u), int(e)) for u, e in self.ring.get()], self.dropped.get()[0]
        else:
            held, dropped = [], 0
            self.handle.registerTimer((int(key[1]) + 1) * self.tick_ms)
        for part in rows:  # no more than the slots and one part are held
            every = sorted(held + list(zip(part["us"].tolist(), part["event_id"].tolist())))
            dropped += max(0, len(every) - self.slots)
            held = every[-self.slots :]
        self.ring.put(held)
        self.dropped.update((dropped,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, dropped = sorted(((int(u), int(e)) for u, e in self.ring.get()), reverse=True), self.dropped.get()[0]
        self.ring.clear()
        self.dropped.clear()
        rows = [(key[0], int(key[1]), e, u, rn, dropped) for rn, (u, e) in enumerate(held, 1)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in NEWEST.split(", ")])

    def close(self) -> None:
        pass


def stream_latest(events: DataFrame, tick_s: int = 1, keep: int = 2, late: str = "10 seconds") -> DataFrame:
    """Rows of ``NEWEST``: of each tick the ``keep`` newest of a camera's rows, newest first, and how many were dropped for them.

    ``events`` is a stream of camera_name, event_id and ts; rows without a camera only move the watermark on.
    """
    ship_package(events.sparkSession)
    us = F.unix_micros("ts")
    rows = events.withWatermark("ts", late).select(
        "camera_name", F.floor(us / (tick_s * 1_000_000)).cast("long").alias("tick"), us.alias("us"), F.col("event_id").cast("long"), "ts"
    )
    processor = RingProcessor()
    processor.slots, processor.tick_ms = keep, 1000 * tick_s
    return rows.groupBy("camera_name", "tick").transformWithStateInPandas(processor, NEWEST, "Append", "EventTime")
