"""Occupancy of rooms from entry and exit events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")


def timeline(
    events: DataFrame, initial: int | DataFrame = 0, room: tuple[str, ...] = ("room",), order: tuple[str, ...] = ORDER, bucket: str = "day"
) -> DataFrame:
    """Adds ``occupancy`` and ``peak`` after each event, in event order, never below zero.

    With S the plain running sum, the clamped count is S less the least of zero
    and the lowest S so far, so no row depends on another's clamped value. Sums
    and minima are taken within buckets of time and then carried over a table
    of the buckets, so even one very busy room is spread over many tasks.
    ``initial`` is the count before the first event, of all rooms or, as a table
    with the rooms' columns and ``initial``, of each; rooms it leaves out have 0.
    """
    df = events.withColumns({
        "delta": F.when(F.col("event") == "ENTRY", 1).when(F.col("event") == "EXIT", -1).otherwise(0).cast("long"),
        "bucket": F.date_trunc(bucket, order[0])
    })
    own = Window.partitionBy(*room, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("s", F.sum("delta").over(own))
    df = df.withColumn("low", F.min("s").over(own))
    before = Window.partitionBy(*room).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*room, "bucket").agg(F.sum("delta").alias("total"), F.min("s").alias("lowest"))
    if isinstance(initial, DataFrame):
        totals = totals.join(initial.select(*room, F.greatest(F.lit(0), "initial").cast("long").alias("start")), list(room), "left")
        totals = totals.withColumn("start", F.coalesce("start", F.lit(0)))
    else:
        totals = totals.withColumn("start", initial_count(initial))
    totals = totals.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)) + F.col("start"))
    totals = totals.withColumn("floor", F.min(F.col("base") + F.col("lowest")).over(before)).select(*room, "bucket", "base", "floor", "start")
    df = df.join(totals, [*room, "bucket"])
    lowest = F.least(F.lit(0), F.col("floor"), F.col("base") + F.col("low"))  # least skips a null floor
    df = df.withColumn("occupancy", F.col("base") + F.col("s") - lowest)
    # the peak, carried the same way; it is looked at when someone enters
    entered = F.when(F.col("event") == "ENTRY", F.col("occupancy"))
    df = df.withColumn("high", F.max(entered).over(own))
    highs = df.groupBy(*room, "bucket").agg(F.max(entered).alias("top"))
    highs = highs.withColumn("carried", F.max("top").over(before)).select(*room, "bucket", "carried")
    df = df.join(highs, [*room, "bucket"])
    peak = F.greatest("start", "high", "carried")
    return df.withColumn("peak", peak).drop("delta", "bucket", "s", "low", "base", "floor", "start", "high", "carried")


def initial_count(initial: int):
    return F.lit(max(0, initial)).cast("long")


def per_door(events: DataFrame, by: tuple[str, ...] = ("door_id",)) -> DataFrame:
    return events.groupBy(*by).agg(F.count_if(F.col("event") == "ENTRY").alias("entered"), F.count_if(F.col("event") == "EXIT").alias("exited"))


def session_summary(events: DataFrame, initial: int = 0, room: tuple[str, ...] = ("room",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """For each room: start, length, final and peak occupancy, totals, and doors as a map.

    The peak's time is that of the first event that reaches it, or the start if
    none exceeds the initial count.
    """
    seen = timeline(events, initial, room, order)
    last = F.struct(*order)
    entered = F.when(F.col("event") == "ENTRY", F.struct(F.col("occupancy").alias("o"), *[(-F.unix_micros(order[0])).alias("t")]))
    out = seen.groupBy(*room).agg(
        F.min(order[0]).alias("session_start"), F.max(order[0]).alias("session_end"), F.max_by("occupancy", last).alias("final_occupancy"),
        F.count_if(F.col("event") == "ENTRY").alias("total_entered"), F.count_if(F.col("event") == "EXIT").alias("total_exited"), F.max(entered).alias("top"),
    )
    doors = per_door(events, (*room, "door_id")).groupBy(*room).agg(F.map_from_entries(F.collect_list(F.struct("door_id", F.struct("entered", "exited")))).alias("per_door"))
    over = F.coalesce(F.col("top")["o"] > initial_count(initial), F.lit(False))
    out = out.withColumns({
        "peak_occupancy": F.when(over, F.col("top")["o"]).otherwise(initial_count(initial)),
        "peak_time": F.when(over, F.timestamp_micros(-F.col("top")["t"])).otherwise(F.col("session_start")),
        "session_elapsed_s": F.round((F.unix_micros("session_end") - F.unix_micros("session_start")) / 1e6, 1),
    })
    return out.drop("top", "session_end").join(doors, list(room))


def snapshot(events: DataFrame, initial: int = 0, room: tuple[str, ...] = ("room",)) -> DataFrame:
    """Occupancy, totals, peak and doors after the last event."""
    return session_summary(events, initial, room).select(
        *room, F.col("final_occupancy").alias("current_occupancy"), "total_entered", "total_exited", "peak_occupancy", "per_door"
    )
