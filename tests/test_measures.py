"""Boxes of all sizes, and statistics and losses over vectors, against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import boxes, metrics, rates, similarity, tracklets

BOX = "frame int, id long, x1 double, y1 double, x2 double, y2 double"


def some_boxes(seed, n=500):
    rng, rows = random.Random(seed), []
    for i in range(n):
        if rows and rng.random() < 0.6:  # near another box
            _, _, x1, y1, x2, y2 = rng.choice(rows)
            w, h = (x2 - x1) * rng.uniform(0.5, 2), (y2 - y1) * rng.uniform(0.5, 2)
            x1, y1 = x1 + w * rng.uniform(-0.4, 0.4), y1 + h * rng.uniform(-0.4, 0.4)
        else:
            w, h, x1, y1 = 2 ** rng.uniform(0, 12), 2 ** rng.uniform(0, 12), rng.uniform(-500, 4000), rng.uniform(-500, 4000)
        w, h = min(4000.0, max(1.0, w)), min(4000.0, max(1.0, h))
        rows.append((i % 3, i, x1, y1, x1 + w, y1 + h))
    return [*rows, (0, n, 64.0, 64.0, 128.0, 128.0), (0, n + 1, 64.0, 64.0, 128.0, 128.0), (0, n + 2, 5.0, 5.0, 5.0, 9.0)]


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    shared = max(0.0, w) * max(0.0, h)
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    whole = area(a) + area(b) - shared
    return shared / whole if whole > 0 else 0.0


@pytest.mark.parametrize("least", [0.2, 0.55, 0.03])
def test_boxes_of_all_sizes_meet_once(spark, least):
    rows = some_boxes(int(100 * least))
    df = spark.createDataFrame(rows, BOX)
    found = sorted((r.a_id, r.b_id, r.iou) for r in boxes.overlapping(df, df, ["frame"], least, ordered=True).collect())
    want = sorted((a[1], b[1], iou(a, b)) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and iou(a, b) >= least)
    assert [x[:2] for x in found] == [x[:2] for x in want] and len(want) > 20
    assert np.allclose([x[2] for x in found], [x[2] for x in want], atol=1e-7)
    other = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    both = {(r.a_id, r.b_id) for r in boxes.overlapping(*other, ["frame"], least).collect()}
    assert both == {(a, b) if a % 2 == 0 else (b, a) for a, b, _ in want if (a + b) % 2}


def test_a_box_is_in_few_cells(spark):
    df = spark.createDataFrame(some_boxes(7), BOX)
    own = boxes.level(64)
    for levels, most in ((F.array(own), 4), (F.sequence(own, own + 3), 16)):
        assert boxes.listed(df, levels, 64).groupBy("id").count().agg(F.max("count")).first()[0] <= most
    with pytest.raises(ValueError):
        boxes.overlapping(df, df, ["frame"], 0.0)


def vectors_of(seed, labels):
    rng = np.random.default_rng(seed)
    return [(i, int(k), rng.normal(size=12).tolist()) for i, k in enumerate(labels)]


def test_separation_in_one_scan(spark, tmp_path):
    """Labels of one vector, of fewer than dimensions, and one with most of the rows."""
    labels = [0] * 400 + [1] * 5 + [2] + [3] * 40 + list(range(10, 60)) * 2
    rows = vectors_of(1, labels)
    df = spark.createDataFrame(rows, "id long, label long, embedding array<double>")
    df.repartition(7).write.parquet(str(tmp_path / "vectors"))
    found = metrics.similarity_separation(spark.read.parquet(str(tmp_path / "vectors")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Generate" not in plan
    x = np.array([r[2] for r in rows])
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    s, other = x @ x.T, ~np.eye(len(x), dtype=bool)
    same = np.equal.outer(np.array(labels), np.array(labels))
    r = found.first()
    want = (s[same & other].mean(), s[same & other].std(), s[~same].mean(), s[~same].std())
    assert np.allclose((r.same_mean, r.same_std, r.different_mean, r.different_std), want, atol=2e-6)
    assert abs(r.separation - (want[0] - want[2])) < 2e-6


@pytest.mark.parametrize("strict", [False, True])
def test_hardest_pairs_by_blocks(spark, monkeypatch, strict):
    rows = [(i % 3 if i < 60 else 7, *v) for i, v in enumerate(vectors_of(2, [i % 5 for i in range(200)]))] + [(9, 1000, 1, [1.0] * 12)]
    df = spark.createDataFrame(rows, "batch long, id long, label long, embedding array<double>")
    monkeypatch.setattr(similarity, "BLOCK", 32)
    found = {r.batch: (r.anchors, r.loss) for r in metrics.batch_hard_loss(df, strict=strict).collect()}
    want = {}
    for batch in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == batch]
        losses = []
        for a in own:
            d = {b[1]: np.sqrt(((np.array(a[3]) - np.array(b[3])) ** 2).sum() + 1e-8) for b in own}
            far = max((d[b[1]] for b in own if b[2] == a[2] and b[1] != a[1]), default=0.0)
            near = min((d[b[1]] for b in own if b[2] != a[2] or (not strict and b[1] == a[1])), default=np.inf)
            if far > 0 and near < 1e6:
                losses.append(max(0.0, far - near + 0.3))
        if losses:
            want[batch] = (len(losses), round(float(np.mean(losses)), 6))
    assert set(found) == set(want)
    assert all(found[b][0] == want[b][0] and abs(found[b][1] - want[b][1]) < 2e-6 for b in want)


@pytest.mark.parametrize("bucket", ["day", "hour", "minute"])
def test_rolling_rates_over_buckets(spark, bucket):
    """Buckets of one frame and of many; equal times have no rate."""
    rng = random.Random(8)
    rows = [(c, i, 1_700_000_000_000_000 + rng.randrange(5 * 86_400) * rng.choice([1, 1_000_000]) * (1 if i % 9 else 0)) for i, c in enumerate(rng.choices("ab", k=400))]
    df = spark.createDataFrame(rows, "camera_name string, event_id long, us long").select("camera_name", "event_id", F.timestamp_micros("us").alias("ts"))
    want = {}
    for camera in "ab":
        own, held = sorted((us, i) for c, i, us in rows if c == camera), []
        for k, (us, i) in enumerate(own):
            rate = 1e6 / (us - own[k - 1][0]) if k and us > own[k - 1][0] else None
            held.append(rate)
            known = [x for x in held[-7:] if x is not None]
            want[i] = (rate, sum(known) / len(known) if known else None)
    found = {r.event_id: (r.rate, r.rolling_rate) for r in rates.rolling_rate(df, 7, bucket=bucket).collect()}
    assert set(found) == set(want)
    for i, pair in want.items():
        for x, y in zip(found[i], pair, strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1.0, abs(y))), i


@pytest.mark.parametrize("together, held", [(1 << 16, 1 << 20), (50, 60)])
def test_reservoirs_are_merged_from_tasks(spark, monkeypatch, together, held):
    """The same rows however they are dealt to tasks, one identity with most of them; a task hands on forty of each at most."""
    monkeypatch.setitem(tracklets.kept_in_task.__globals__, "TOGETHER", together)
    monkeypatch.setitem(tracklets.kept_in_task.__globals__, "HELD", held)
    rows = [(i, 1 if i % 3 else i % 7 if i % 2 else None, f"x{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, pid long, x string")
    draw = lambda r: hashlib.md5(f"7:{r[0]}".encode() if r[1] is None else f"7:{r[1]}:{r[0]}".encode()).hexdigest()
    want = set()
    for pid in {r[1] for r in rows}:
        own = sorted(r for r in rows if r[1] == pid)
        want |= {(*r, True) for r in own[:10]} | {(*r, False) for r in sorted(own[10:], key=lambda r: (draw(r), r[0]))[:20]}
    for parts in (1, 5):
        found = tracklets.reservoir(df.repartition(parts), "id", "pid")
        assert {tuple(r) for r in found.collect()} == want
    drawn = df.withColumn("draw", F.md5(F.col("id").cast("string").cast("binary"))).coalesce(1)
    each = tracklets.kept_in_task(drawn, "pid", "id", 10, 20).groupBy("pid").count().agg(F.max("count")).first()[0]
    assert each <= 40 or held == 60


@pytest.mark.parametrize("entries, apart", [(1 << 24, 1), (60_000, 1), (9_000, 1 << 40)])
def test_average_precisions_in_groups_equal_full_rankings(spark, entries, apart):
    """Persons of all sizes, equal vectors and vectors of zeros, whose ties go by id; many small groups as well as one."""
    rng = np.random.default_rng(11)
    some = rng.normal(size=(260, 5)).round(1)
    x = np.concatenate([some, some[:60], np.zeros((20, 5))]).astype(np.float32)
    rows = [(i * apart, 0 if i % 3 else int(i % 50), int(i % 4), [float(v) for v in x[i]]) for i in rng.permutation(len(x)).tolist()]
    df = spark.createDataFrame(rows, "id long, pid long, cid long, embedding array<float>")
    unit = {r[0]: np.array(r[3], np.float32).astype(np.float64) / (np.linalg.norm(np.array(r[3], np.float32).astype(np.float64)) + 1e-8) for r in rows}
    isq = lambda r: (r[0] // apart) % 5 == 0
    want = {}
    for q in filter(isq, rows):
        ranked = sorted((-round(float(unit[q[0]] @ unit[g[0]]), 9), g[0], g[1]) for g in rows if not isq(g) and not (g[1] == q[1] and g[2] == q[2]))
        hits = [k for k, g in enumerate(ranked, 1) if g[2] == q[1]]
        want[q[0]] = (np.mean([(n + 1) / k for n, k in enumerate(hits)]), hits[0]) if hits else (None, None)
    queries, pictures = df.where(f"(id div {apart}) % 5 = 0"), df.where(f"(id div {apart}) % 5 <> 0")
    assert metrics.query_groups(queries, pictures, entries)[1] >= (1 if entries == 1 << 24 else 4)
    found = {r.query_id: (r.ap, r["first"]) for r in metrics.average_precisions(queries, pictures, 16, entries).collect()}
    assert set(found) == set(want)
    for q, (ap, first) in want.items():
        assert found[q][1] == first and (found[q][0] == pytest.approx(ap, abs=1e-12) if ap is not None else found[q][0] is None), q


def test_equal_boxes_meet_as_one(spark):
    """Copies of boxes are one row while boxes meet, and all pairs come out."""
    few = some_boxes(3, 30)
    rows = [(f, i + 100 * k, *box) for f, i, *box in few for k in range(9)]
    df = spark.createDataFrame(rows, BOX)
    assert boxes.classes(df, ["frame"]).count() == len({(r[0], *r[2:]) for r in few})
    found = sorted((r.a_id, r.b_id) for r in boxes.overlapping(df, df, ["frame"], ordered=True).collect())
    assert found == sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and iou(a, b) >= 0.2)
    unnamed = spark.createDataFrame([(0, None, 0.0, 0.0, 9.0, 9.0), (0, 1, 0.0, 0.0, 9.0, 9.0), (0, 2, 0.0, 0.0, 9.0, 9.0)], BOX)
    assert boxes.overlapping(unnamed, unnamed, ["frame"]).count() == 9
    assert [(r.a_id, r.b_id) for r in boxes.overlapping(unnamed, unnamed, ["frame"], ordered=True).collect()] == [(1, 2)]
