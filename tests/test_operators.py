"""Operators against plain simulations and by their properties."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geo, labels, vec
from trackloom.operators import boxes, crossings, etl, gallery, metrics, occupancy, presence, rates, similarity, tracklets
from trackloom.sources import annotations, config, results

TRACK = "camera_name string, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double"
LINE = "camera_name string, door_id string, sx int, sy int, ex int, ey int, inside_sign int, band_width int, direction string, crossing_point string"


def walk(seed, tracks=6, frames=60):
    rng, rows = random.Random(seed), []
    for t in range(tracks):
        x, y = rng.randint(-50, 200), rng.randint(0, 200)
        for f in range(frames):
            x, y = x + rng.randint(-40, 40), y + rng.randint(-40, 40)
            if rng.random() > 0.1:
                rows.append(("c", t, f, x - 10 + 0.5, y - 60 + 0.25, x + 11 + 0.75, y + 0.5))
    return rows


def simulate(rows, line):
    """The band rule, one frame after the other."""
    _, _, sx, sy, ex, ey, inside, band, *_ = line
    state, out = {}, []
    by_frame = {}
    for r in rows:
        by_frame.setdefault(r[2], []).append(r)
    for f in range(max(by_frame) + 1):
        now = by_frame.get(f, [])
        state = {t: s for t, s in state.items() if t in {r[1] for r in now}}
        for r in now:
            x1, _, x2, y2 = (int(v) for v in r[3:])
            px, py = (x1 + x2) // 2, y2
            c = (ex - sx) * (py - sy) - (ey - sy) * (px - sx)
            if c == 0 or abs(c) / ((ex - sx) ** 2 + (ey - sy) ** 2) ** 0.5 <= band:
                continue
            side = 1 if c > 0 else -1
            if r[1] in state and state[r[1]] != side:
                out.append((r[1], f, "ENTRY" if side == inside else "EXIT"))
            state[r[1]] = side
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_crossings_follow_the_band_rule(spark, seed):
    rows, line = walk(seed), ("c", "d", 20, -300, 120, 500, 1, 15, "both", "foot")
    found = crossings.line_crossings(spark.createDataFrame(rows, TRACK), spark.createDataFrame([line], LINE), direction=False)
    assert sorted((r.track_id, r.frame_idx, r.event) for r in found.collect()) == simulate(rows, line)


def test_one_unset_line_disables_its_camera(spark):
    lines = [
        ("c", "d", 20, -300, 120, 500, 1, 15, "both", "foot"), ("c", "e", 0, 0, 0, 0, 1, 15, "both", "foot"),
        ("k", "d", 1, 1, 2, 2, 1, 15, "both", "foot")
    ]
    assert [r.camera_name for r in crossings.calibrated(spark.createDataFrame(lines, LINE)).collect()] == ["k"]


def test_polygon_equals_plain_ray_casting(spark):
    polygon, rng = [(10, 10), (90, 20), (70, 60), (95, 95), (40, 70), (5, 90)], random.Random(3)
    points = [(rng.randint(0, 100), rng.randint(0, 100)) for _ in range(400)]

    def inside(x, y):
        odd = False
        for i in range(len(polygon)):
            (xi, yi), (xj, yj) = polygon[i], polygon[i - 1]
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                odd = not odd
        return odd

    df = spark.createDataFrame(points, "x int, y int").select("x", "y", geo.inside_polygon(F.col("x"), F.col("y"), polygon).alias("i"))
    assert [r.i for r in df.collect()] == [inside(x, y) for x, y in points]


@pytest.mark.parametrize("initial", [0, 4])
def test_occupancy_is_clamped_over_buckets(spark, initial):
    rng = random.Random(5)
    rows = [(i, f"2024-01-{1 + i // 40:02d} 00:{i % 40:02d}:00", "Room", f"d{i % 3}", rng.choice(["ENTRY", "EXIT", "EXIT"])) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, t string, room string, door_id string, event string").withColumn("ts", F.col("t").cast("timestamp"))
    n, peak, want = initial, initial, {}
    for i, *_, event in rows:
        n = n + 1 if event == "ENTRY" else max(0, n - 1)
        peak = max(peak, n)
        want[i] = (n, peak)
    assert {r.event_id: (r.occupancy, r.peak) for r in occupancy.timeline(df, initial).collect()} == want
    summary = occupancy.session_summary(df, initial).first()
    assert (summary.final_occupancy, summary.peak_occupancy) == (n, peak)


def test_departure_needs_a_later_frame(spark):
    rows = [("c", 1, f, 0.0, 0.0, 1.0, 1.0) for f in (0, 1)] + [("c", 2, f, 0.0, 0.0, 1.0, 1.0) for f in (0, 1, 5)]
    found = presence.departures(spark.createDataFrame(rows, TRACK)).collect()
    assert [(r.track_id, r.last_tick, r.missing_tick) for r in found] == [(1, 2, 3)]


@pytest.mark.parametrize("stretch", [1, 3, 7, 100_000])
def test_ticks_count_frames_with_detections(spark, stretch):
    rows = [("a", t, f) for f in (0, 2, 3, 7, 8, 20, 21) for t in (1, 2)] + [("b", 1, f) for f in (5, 6, 50)]
    df = spark.createDataFrame(rows, "camera_name string, track_id long, frame_idx long")
    found = {(r.camera_name, r.frame_idx): r.tick for r in presence.with_nonempty_clock(df, stretch).collect()}
    assert [found["a", f] for f in (0, 2, 3, 7, 8, 20, 21)] == [1, 2, 3, 4, 5, 6, 7]
    assert [found["b", f] for f in (5, 6, 50)] == [1, 2, 3]


@pytest.mark.parametrize("stretch", [1, 4, 10_000])
def test_lows_are_carried_over_stretches(spark, stretch):
    losses = [5.0, 4.0, 4.0, 4.5, 3.0, 3.5, 2.0, 2.0, 9.0, 1.0]
    df = spark.createDataFrame(list(enumerate(losses)), "epoch long, loss double")
    found = {r.epoch: (r.is_best, r.best) for r in metrics.best_so_far(df, stretch=stretch).collect()}
    assert found == {i: (i == 0 or x < min(losses[:i]), min(losses[: i + 1])) for i, x in enumerate(losses)}


def test_iou_grid_finds_each_pair_once(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        x, y = rng.uniform(-100, 300), rng.uniform(-100, 300)
        rows.append((0, i, x, y, x + rng.uniform(5, 150), y + rng.uniform(5, 150)))
    df = spark.createDataFrame(rows, "k int, id int, x1 double, y1 double, x2 double, y2 double")
    found = sorted((r.a_id, r.b_id) for r in boxes.overlapping(df, df, ["k"]).where("a_id < b_id").collect())
    want = [(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and gallery._iou(a[2:], b[2:]) >= 0.2]
    assert found == sorted(want)


def test_blocked_search_equals_one_block(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    key = lambda d: sorted((r.query_id, r["rank"], r.gallery_id) for r in d.collect())
    assert key(similarity.top_k(df, df, 3, block=7)) == key(similarity.top_k(df, df, 3))


def test_cmc_map_by_hand_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 7), int(i % 3), [float(x) for x in rng.normal(size=6)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, pid long, cid long, embedding array<double>")
    got = metrics.cmc_map(df.where("id < 20"), df.where("id >= 20"), block=9).first()
    unit = np.array([r[3] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    aps, first = [], []
    for q in rows[:20]:
        ranked = sorted((g for g in rows[20:] if not (g[1] == q[1] and g[2] == q[2])), key=lambda g: (-round(float(unit[q[0]] @ unit[g[0]]), 9), g[0]))
        hits = [k for k, g in enumerate(ranked, 1) if g[1] == q[1]]
        aps.append(np.mean([(n + 1) / k for n, k in enumerate(hits)]) if hits else 0.0)
        first.append(hits[0] if hits else 999)
    assert got["map"] == pytest.approx(np.mean(aps), abs=1e-6)
    assert got.cmc_1 <= got.cmc_5 <= got.cmc_10
    assert got.cmc_5 == pytest.approx(np.mean([f <= 5 for f in first]))


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    r = df.select(
        vec.norm(F.col("a")).alias("n"), vec.cosine(F.col("a"), F.col("b")).alias("c"), vec.mean_of(F.array("a", "b")).alias("m"),
        vec.squared_distance(F.col("a"), F.col("b")).alias("d")
    ).first()
    assert (r.n, r.m, r.d) == (5.0, [3.5, 3.5], 2.0)
    assert r.c == pytest.approx(0.96)


def test_resolver_brings_a_person_back(spark):
    """The same look in a second camera joins the first identity; another look starts a new one."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(
        "s", cam, 1, start + f, (start + f) / 25, look, False, 0.0, 0.0, 50.0, 100.0
    ) for cam, start, look in (("c1", 0, a), ("c2", 40, a), ("c3", 80, b)) for f in range(20)]
    df = spark.createDataFrame(
        rows,
        "site_id string, camera_name string, track_id long, frame_idx long, t double, embedding array<double>, is_edge boolean, x1 double, y1 double, x2 double, y2 double"
    )
    # places differ, so only looks count
    df = df.withColumn(
        "x1", F.col("x1") + F.when(F.col("camera_name") == "c3", 500).otherwise(0)
    ).withColumn("x2", F.col("x2") + F.when(F.col("camera_name") == "c3", 500).otherwise(0))
    found = {(r.camera_name): r.g for r in gallery.resolve(df).groupBy("camera_name").agg(F.max("global_id").alias("g")).collect()}
    assert found == {"c1": 1, "c2": 1, "c3": 2}
    pending = gallery.resolve(df).where("camera_name = 'c1' and global_id is null").count()
    assert pending == 14


def test_chain_of_matches_has_one_identity(spark):
    rows = [(i, [float(np.cos(i * 0.3)), float(np.sin(i * 0.3))]) for i in range(9)]
    found = gallery.match_tracklets(spark.createDataFrame(rows, "id long, embedding array<double>"), 0.9)
    assert {r.global_id for r in found.collect()} == {0}


def test_reservoir_keeps_the_first_and_a_bounded_rest(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("pid"), "id")
    found = tracklets.reservoir(df, "id", "pid")
    assert {r.pid: r["count"] for r in found.groupBy("pid").count().collect()} == {0: 30, 1: 30}
    assert found.where("anchor and id >= 20").count() == 0


@pytest.mark.parametrize(("day", "night"), [(5, 17), (4, 0), (10, 10)])
def test_rotations_partition_the_night(spark, day, night):
    rows = [("d", f"day{i}", "day") for i in range(day)] + [("n", f"night{i}", "night") for i in range(night)]
    found = etl.rotations(spark.createDataFrame(rows, "dataset string, path string, kind string"))
    sizes = {r.rotation: r["count"] for r in found.where("rotation >= 0").groupBy("rotation").count().collect()}
    assert sum(sizes.values()) == night
    assert all(0 < n <= day for n in sizes.values())
    assert sorted(sizes) == list(range(-(-night // day)))
    report = etl.rotation_report(found).collect()
    assert len(report) == max(1, len(sizes))


def test_rotations_need_day_images(spark):
    with pytest.raises(ValueError, match="no day images"):
        etl.rotations(spark.createDataFrame([("n", "a", "night")], "dataset string, path string, kind string"))


def test_frame_copies_round_half_to_even(spark):
    df = spark.createDataFrame(
        [(i, t, "c") for i, t in enumerate([0.0, 0.1, 0.16, 10.16])], "event_id long, s double, camera_name string"
    ).withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    assert [r.copies for r in rates.frame_copies(df).orderBy("event_id").collect()] == [1, 2, 2, 125]


def test_annotation_readers(spark, tmp_path):
    """Small files in each format, with what it may leave out."""
    (tmp_path / "a.odgt").write_text('{"ID": "i1", "gtboxes": [{"tag": "person", "fbox": [5, 5, 5, 5], "vbox": [1, 2, 3, 4]}, {"tag": "mask", "fbox": [0, 0, 1, 1]}, {"tag": "person", "fbox": [5, 6, 7, 8]}]}\n\n')
    assert [(r.image_id, r.x, r.h) for r in annotations.read_ndjson(spark, str(tmp_path / "a.odgt")).collect()] == [("i1", 5, 5), ("i1", 5, 8)]
    assert [(r.x, r.h) for r in annotations.read_ndjson(spark, str(tmp_path / "a.odgt"), visible=True).collect()] == [(1, 4), (5, 8)]
    coco = {"images": [{"id": 1, "width": 10, "height": 20, "file_name": "x/p.png"}], "categories": [{"id": 8, "name": "car"}, {"id": 7, "name": "Person"}]}
    coco["annotations"] = [
        {"image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4]}, {"image_id": 1, "category_id": 8, "bbox": [1, 1, 1, 1]},
        {"image_id": 2, "category_id": 7, "bbox": [1, 1, 1, 1]}
    ]
    (tmp_path / "coco.json").write_text(json.dumps(coco))
    assert [(r.image_id, r.w, r.width) for r in annotations.read_coco(spark, str(tmp_path / "coco.json")).collect()] == [("p", 3.0, 10)]
    assert [(r.persons, r.images) for r in annotations.person_counts(spark, str(tmp_path / "coco.json")).collect()] == [(1, 1)]
    wide = tmp_path / "wide"
    wide.mkdir()
    (wide / "q.jpg.txt").write_text("\n3\n1 10 20 30 60\n\n2 0 0 1 1\n3 0 0 9\n1 0 0 9 9\n")
    (wide / "bad.txt").write_text("none\n1 1 1 2 2\n")
    assert [(r.image_id, r.x, r.h) for r in annotations.read_counted_text(spark, str(wide)).collect()] == [("q.jpg", 10.0, 40.0)]
    assert annotations.read_counted_text(spark, str(wide), riders=True, partial=True).count() == 2
    city = tmp_path / "city" / "aachen"
    city.mkdir(parents=True)
    box = {"bbleft": 1, "bbtop": 2, "bbwidth": 3, "bbheight": 4}
    (city / "m_gtBboxCityPersons.json").write_text(json.dumps({"annotation": {"list": [
        {"lbl": "Pedestrian", **box}, {"lbl": "tree", **box}, {"lbl": "people", **box}, {"lbl": "person", "occl": 1, **box}
    ]}}))
    found = annotations.read_city_json(spark, str(tmp_path / "city"))
    assert [(r.image_id, r.city, r.width, r.height) for r in found.collect()] == [("m_gtBboxCityPersons", "aachen", 2048, 1024)] * 2
    assert annotations.read_city_json(spark, str(tmp_path / "city"), skip_occluded=True).count() == 1
    assert found.select(labels.city_image_name(F.col("city"), F.col("image_id")).alias("n")).first().n == "aachen_m_leftImg8bit.png"
    (tmp_path / "e").mkdir()
    children = [
        {"identity": "Pedestrian", "pos": [1, 2, 11, 22]}, {"identity": "person", "pos": [1, 2, 3]},
        {"identity": "rider", "pos": [0, 0, 5, 5], "occluded": 0.4}, {"identity": "person", "occluded": 0.9, "pos": [0, 0, 7, 7]}
    ]
    (tmp_path / "e" / "z.json").write_text(json.dumps({"imagewidth": 100, "imageheight": 50, "children": children}))
    (tmp_path / "e" / "unknown.json").write_text(json.dumps({"children": children}))
    assert [(r.w, r.h) for r in annotations.read_corner_json(spark, str(tmp_path / "e")).collect()] == [(10.0, 20.0), (7.0, 7.0)]
    assert [r.w for r in annotations.read_corner_json(spark, str(tmp_path / "e"), riders=True, most_occluded=0.5).collect()] == [10.0, 5.0]


def test_height_as_the_label_tells_it(spark):
    """A box that is high enough before it is cut, and a little too low by six digits."""
    rows = [("a", 0, 0.0, -40.0, 30.0, 100.0, 100.0, 90.0), ("b", 0, 0.0, 0.0, 30.0, 20.0, 100.0, 30.0)]
    df = spark.createDataFrame(rows, "image_id string, order int, x double, y double, w double, h double, width double, height double")
    assert {r.image_id for r in etl.yolo_labels(df, 20.0).collect()} == {"a", "b"}
    assert {r.image_id for r in etl.yolo_labels(df, least_clipped_height=20.0).collect()} == {"a", "b"}
    assert {r.image_id for r in etl.yolo_labels(df, least_clipped_height=20.00002).collect()} == {"a"}


def test_results_of_runs(spark, tmp_path):
    for run, name, text in (
        ("r1", "results.json", '{"loss": 1.5}'), ("r1", "results.csv", "loss\n2\n"), ("r2", "results.json", "{"),
        ("r2", "results.csv", " epoch , loss \n1,3\n2, 4\n"), ("r3", "results.csv", "loss\n")
    ):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_text(text)
    found = {r.run: (r.source, r["values"]) for r in results.read_results(spark, str(tmp_path)).collect()}
    assert found == {"r1": ("json", {"loss": "1.5"}), "r2": ("csv", {"epoch": "2", "loss": "4"}), "r3": ("none", {})}


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"room_name": "R", "cameras": [{"name": "A", "source": "v\\\\a.mp4", "crossing_point": "top", "door_lines": [{"door_id": "1", "start": [1, 2], "end": [3, 4], "direction": "sideways"}], "room_region": {"polygon": [[1, 1], [5, 1], [5, 5]]}}]}')
    counter = config.read_counter(spark, str(tmp_path / "c.json"))
    line = config.door_lines(counter).first()
    assert (line.direction, line.crossing_point, line.band_width, line.ex) == ("both", "top", 25, 3)
    assert counter.first().source == "v/a.mp4"
    assert config.regions(counter).first().room == "R"
    (tmp_path / "k.json").write_text('[{"name": "a", "source": "RTSP://x"}, {"name": "b", "source": "0"}, {"name": "c", "source": "d.mp4"}]')
    assert [r.kind for r in config.read_cameras(spark, str(tmp_path / "k.json")).orderBy("name").collect()] == ["stream", "webcam", "file"]


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame(
        [("2024-01-01 10:00:00.123", "c", "d", "n", "ENTRY", 1, 2)],
        "timestamp string, camera_name string, door_id string, door_name string, event string, track_id long, occupancy_after long"
    )
    results.append_event_log(log, str(tmp_path / "log"))
    results.append_event_log(log, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    (tmp_path / "sweep.csv").write_text("Conf,IOU,Img_Size,Precision\n0.25,0.5,640,0.9\nbad,0.5,640,0.1\n")
    assert results.read_sweep(spark, str(tmp_path / "sweep.csv")).count() == 1


def test_normalized_boxes_and_lines(spark):
    df = spark.createDataFrame(
        [("i", 0, -10.0, 5.0, 30.0, 40.0, 100.0, 50.0)],
        "image_id string, order int, x double, y double, w double, h double, width double, height double"
    )
    r = etl.yolo_labels(df).first()
    assert (r.xc, r.yc, r.w, r.h) == (0.15, 0.5, 0.3, 0.8)
    assert etl.label_files(etl.yolo_labels(df)).first().text == "0 0.150000 0.500000 0.300000 0.800000"
    assert [x.n for x in spark.createDataFrame([("dataset_rot12",), ("other",)], "s string").select(labels.rotation_number(F.col("s")).alias("n")).collect()] == [12, 9999]


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    from trackloom.streaming import processors

    rows, line = walk(4), ("c", "d", 20, -300, 120, 500, 1, 15, "both", "foot")
    df, lines = spark.createDataFrame(rows, TRACK), spark.createDataFrame([line], LINE)
    for low in (0, 20, 40):  # a file and so a micro-batch for each third
        df.where((F.col("frame_idx") >= low) & (F.col("frame_idx") < low + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = processors.stream_crossings(
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in")), lines
    )
    processors.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted((r.track_id, r.frame_idx, r.event) for r in found.collect()) == simulate(rows, line)


def test_scratch_tables_go_when_nothing_reads_them(spark):
    from trackloom import session

    there = lambda t: os.path.isdir(t.trackloom_path.removeprefix("file://"))
    with session.scratch() as outer:
        with session.scratch() as kept:
            gone, stays = session.written(spark.range(3), "a"), session.written(spark.range(4), "b")
            kept.append(stays)
        assert not there(gone)
        assert there(stays)
        last = session.written(stays, "c")
        outer.append(last)
    assert not there(stays)
    assert last.count() == 4


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from trackloom import session

    nothing = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: nothing, master="spark://host:7077"), conf=nothing)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_no_camera_is_one_task(spark, sf_dir, monkeypatch):
    """Lines and regions are broadcast, so rows stay dealt by track, and many events make many tasks."""
    from trackloom.plans import catalog, fixtures

    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    n = -(-fixtures.table(spark, sf_dir, "events").count() // 100)
    for name in ("crossings_mode_both", "line_crossings_strict", "region_crossings", "filtered_tracks", "region_filtered_line_events"):
        plan = plan_of(catalog.queries()[name](spark, sf_dir)).split("== Physical Plan ==")[1]
        assert "SortMergeJoin" not in plan, name
        assert "hashpartitioning(user_id" in plan and f", {n}), REPARTITION_BY_NUM" in plan, name
