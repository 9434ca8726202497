"""The live source: every row once through failures, restarts and slow reads; the sixth failure in a row ends the query."""

import json
import time

import pytest

from trackloom.sources import live

ROWS = "camera_name string, frame_idx long, x long"
WITH = ROWS + ", reconnects int"


def staged(spark, tmp_path, frames=100):
    rows = [(f"c{c}", f, 1000 * c + f) for c in range(3) for f in range(frames) if f % 7] + [("c0", 1, -1)]
    fps = spark.createDataFrame([("c0", 50.0), ("c1", 0.0)], "camera_name string, fps double")
    path = f"file://{tmp_path}/feed"
    live.stage_feed(spark.createDataFrame(rows, ROWS), path, fps)
    return rows, path


def run(spark, tmp_path, path, **options):
    stream = live.live(spark, path, WITH, wait_s=0.05, **options)
    return stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start(str(tmp_path / "out"))


def told(spark, tmp_path):
    return spark.read.schema(WITH).parquet(str(tmp_path / "out")).collect()


def test_rates_and_offsets(spark, tmp_path):
    _, path = staged(spark, tmp_path)
    reader = live.LiveReader(spark.createDataFrame([], ROWS).schema, {"path": path})
    assert {c: r["fps"] for c, r in reader.cameras.items()} == {"c0": 50.0, "c1": 25.0, "c2": 25.0}
    assert reader.initialOffset() == {"c0": 0, "c1": 0, "c2": 0}
    for r in reader.cameras.values():
        r["began"] = time.time() - 2.0
    seen = reader.latestOffset()
    assert seen["c0"] == 100 and 50 <= seen["c1"] == seen["c2"] <= 60
    parts = reader.partitions({"c0": 100, "c1": 3}, seen)
    assert sorted((p.camera, p.low) for p in parts) == [("c1", 3), ("c2", 0)]


def test_every_row_comes_once_through_failures_and_a_restart(spark, tmp_path):
    rows, path = staged(spark, tmp_path)
    trouble = {"c0": {"30": ["drop", 5], "90": ["stall", 1]}, "c2": {"0": ["drop", 1]}}
    query = run(spark, tmp_path, path, trouble=json.dumps(trouble), speed=5, timeout_s=0.5)
    query.processAllAvailable()
    query.stop()
    live.until_read(run(spark, tmp_path, path, trouble=json.dumps(trouble), speed=5, timeout_s=0.5), path, 5)
    found = told(spark, tmp_path)
    assert sorted((r.camera_name, r.frame_idx, r.x) for r in found) == sorted(rows)
    most = {c: max(r.reconnects for r in found if r.camera_name == c) for c in ("c0", "c1", "c2")}
    assert most["c0"] >= 5 and most["c1"] == 0 and most["c2"] == 1


def test_the_sixth_failure_ends_the_query(spark, tmp_path):
    _, path = staged(spark, tmp_path)
    query = run(spark, tmp_path, path, trouble=json.dumps({"c1": {"40": ["drop", 6]}}), speed=1000)
    with pytest.raises(Exception, match="no frame after 5 reconnects"):
        live.until_read(query, path, 1000)


def test_slow_reads_count_as_failures(spark, tmp_path):
    _, path = staged(spark, tmp_path, 10)
    reader = live.LiveReader(spark.createDataFrame([], WITH).schema, {"path": path, "timeout_s": "0.4", "wait_s": "0", "trouble": json.dumps({"c0": {"5": ["stall", 2]}})})
    found = [r for batch in reader.read(live.Frames("c0", 0, 10, 3.0)) for r in batch.to_pylist()]
    assert [r["frame_idx"] for r in found] == [1, 1, 2, 3, 4, 5, 6, 8, 9]
    assert [r["reconnects"] for r in found][0] == 0 and found[-1]["reconnects"] >= 2
