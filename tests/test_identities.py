"""Identities against a replay by plain loops, and the stream against the batch."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import gallery
from trackloom.streaming import processors

SEEN = "site_id string, camera_name string, track_id long, frame_idx long, t double, embedding array<double>, is_edge boolean, x1 double, y1 double, x2 double, y2 double"


def cosine(a, b):
    return float(a @ b / ((np.linalg.norm(a) + 1e-8) * (np.linalg.norm(b) + 1e-8)))


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h + 1e-8)


def replay(rows, at, stable, most):
    """Identity of each row of one site by the rules, without arrays: a list of persons and dictionaries by track."""
    people, known, pending, views, shown, out = [], {}, {}, {}, {}, {}

    def similarity(p, feature):
        own = p.stable if len(p.stable) >= 3 else p.features[-at.recent_features :]
        return max([0.0] + [cosine(x, feature) for x in [*own, *p.left]]) if own else 0.0

    def learn(p, feature, camera, now, is_stable):
        p.features = (p.features + [feature])[-at.features :]
        p.seen, p.n = now, p.n + 1
        p.cameras.add(camera)
        if is_stable:
            p.n_stable += 1
            if len(p.stable) < at.anchored + at.reservoir:
                p.stable.append(feature)
            elif p.n_stable > at.anchored:
                k = int(np.random.default_rng((p.id, p.n_stable)).integers(0, p.n_stable - at.anchored))
                if k < at.reservoir:
                    p.stable[at.anchored + k] = feature

    def needed(p, camera, now):
        """For a whole person that is looked for: a longer absence lowers it in a camera that knew them."""
        if now - p.seen > at.recent_s:
            return at.re_entry if camera in p.cameras and now - p.seen < at.re_entry_window_s else at.strict
        return min(at.strict, at.edge if p.n_stable < 5 else at.strict)

    def person_for(camera, track, feature, now, active, box):
        busy = {known[camera, t] for t in active if (camera, t) in known}
        best = None
        for p in people:
            s = similarity(p, feature)
            if p.id not in busy and s > 0 and s >= needed(p, camera, now) and (best is None or s > best[0]):
                best = (s, p)
        if best is None:
            for p in people:
                if p.id not in busy and p.box is not None and overlap(box, p.box) >= at.least_iou:
                    s = 0.4 * overlap(box, p.box) + 0.6 * similarity(p, feature)
                    if s > 0 and (best is None or s > best[0]):
                        best = (s, p)
        if best is None:
            if len(people) >= at.most_persons:
                gone = [p for p in people if now - p.seen > at.oldest_s][: len(people) // 4]
                people[:] = [p for p in people if p not in gone]
            numbers.append(len(numbers) + 1)
            p = SimpleNamespace(id=numbers[-1], seen=now, cameras={camera}, features=[feature], stable=[feature], left=[], box=box, n=1, n_stable=1)
            people.append(p)
        else:
            p = best[1]
            learn(p, feature, camera, now, True)
            p.box = box
        known[camera, track] = p.id
        return p

    numbers, frames = [], {}
    for r in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        frames.setdefault((r[3], r[1]), []).append(r)
    for (frame, camera), seen in frames.items():
        active, names = {r[2] for r in seen}, {}
        for _, _, track, _, now, feature, edge, *box in seen:
            feature, box, key = np.array(feature), np.trunc(box), (camera, track)
            if key in known:
                for p in people:
                    if p.id == known[key]:
                        if not edge:
                            learn(p, feature, camera, now, True)
                        p.box = box
                names[track] = known[key]
                continue
            own = pending.setdefault(key, [[], 0])
            if np.any(feature):
                own[0].append(feature)
                own[1] += not edge
            names[track] = None
            if own[1] >= stable or len(own[0]) >= most:
                mean = sum(own[0]) / len(own[0])
                p = person_for(camera, track, mean / (np.linalg.norm(mean) + 1e-8), now, active, box)
                for x in own[0][:: max(1, len(own[0]) // 10)]:
                    learn(p, x, camera, now, True)
                names[track] = p.id
                del pending[key]
        for _, _, track, _, _, feature, *_ in seen:
            if np.any(feature):
                views[camera, track] = (views.get((camera, track), []) + [np.array(feature)])[-5:]
        for track, (name, feature) in shown.get(camera, {}).items():
            if track not in active:
                left = views.pop((camera, track), None) or ([feature] if np.any(feature) else [])
                for p in people:
                    if name is not None and p.id == name and left:
                        p.left = left[-at.departures :]
        for key in [k for k in pending if k[0] == camera and k[1] not in active]:
            del pending[key]
        shown[camera] = {r[2]: (names[r[2]], np.array(r[5])) for r in seen}
        out |= {(camera, t, frame): n for t, n in names.items()}
    return out


def walkers(seed, sites=1, people=7, cameras=3, frames=120):
    """People who walk between cameras; each visit is a new track, and views are noisy, sometimes cut or without an embedding."""
    rng, draw, rows = random.Random(seed), np.random.default_rng(seed), []
    for site in range(sites):
        looks, track = draw.normal(size=(people, 16)), 0
        for person in range(people):
            frame = rng.randint(0, 10)
            while frame < frames:
                camera, stay, x = f"c{rng.randrange(cameras)}", rng.randint(4, 25), rng.randint(0, 300)
                track += 1
                for f in range(frame, min(frames, frame + stay)):
                    feature = looks[person] + draw.normal(size=16) * 0.45 if rng.random() > 0.08 else np.zeros(16)
                    left = x + 3.0 * (f - frame)
                    rows.append((f"s{site}", camera, track, f, f / 2.0, feature.tolist(), rng.random() < 0.2, left, 50.0, left + 60, 200.0))
                frame += stay + rng.randint(2, 30)
    return rows


LIMITS = gallery.Limits(
    strict=0.62, edge=0.5, re_entry=0.4, re_entry_window_s=20.0, recent_s=4.0, most_persons=6, oldest_s=15.0, features=12, recent_features=4,
    anchored=3, reservoir=4
)


def answers(found):
    return {(r.site_id, r.camera_name, r.track_id, r.frame_idx): r.global_id for r in found.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_identities_equal_the_replay(spark, seed):
    rows = walkers(seed)
    found = answers(gallery.resolve(spark.createDataFrame(rows, SEEN), LIMITS, 3, 8))
    want = replay(rows, LIMITS, 3, 8)
    assert found == {("s0", *k): v for k, v in want.items()}
    seen = {}
    for (_, camera, _, _), g in found.items():
        if g is not None:
            seen.setdefault(g, set()).add(camera)
    assert any(len(x) > 1 for x in seen.values())  # someone is known in more than one camera


def test_people_keep_their_identity(spark):
    """With clear views a person has one identity in all cameras and after coming back."""
    rows = [r for r in walkers(11, people=5)]
    looks = {}
    plain = [(*r[:5], [1.0 if k == r[2] % 5 else 0.01 for k in range(16)], False, *r[7:]) for r in rows]
    for r in answers(gallery.resolve(spark.createDataFrame(plain, SEEN), gallery.Limits(), 3, 8)).items():
        if r[1] is not None:
            looks.setdefault(r[0][2] % 5, set()).add(r[1])
    assert all(len(x) <= 2 for x in looks.values())  # two only where both are in view at once


def test_streamed_identities_go_on_after_a_stop(spark, tmp_path):
    """Several micro-batches, and a second run from where the first one stopped, give what the batch gives."""
    rows = spark.createDataFrame(walkers(4, sites=3), SEEN)
    make = lambda: processors.stream_identities(
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), LIMITS, 3, 8
    )
    for low, high, run in ((0, 30, False), (30, 60, True), (60, 90, False), (90, 200, True)):
        rows.where(f"frame_idx >= {low} and frame_idx < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if run:
            stream = make()
            processors.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    found = answers(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")))
    assert found == answers(gallery.resolve(rows, LIMITS, 3, 8))
    assert len(set(found.values())) > 5


def test_clearing_a_camera_forgets_its_tracks_only():
    g = gallery.Gallery(LIMITS)
    one = g.find_or_create(1, np.eye(16)[0], "a", 0.0, {1})
    assert g.find_or_create(1, np.eye(16)[1], "b", 0.0, {1}) != one
    g.clear_camera("a")
    assert list(g.known) == [("b", 1)]
    assert g.find_or_create(9, np.eye(16)[0], "a", 1.0, {9}) == one


def test_old_persons_make_room():
    g = gallery.Gallery(LIMITS)
    for k in range(6):
        g.find_or_create(k, np.eye(16)[k], "a", float(k), {k})
    g.find_or_create(6, np.eye(16)[6], "a", 100.0, {6})
    assert list(g.persons) == [2, 3, 4, 5, 6, 7]
    assert sorted(g.owner[g.owner > 0].tolist()) == [2, 3, 4, 5, 6, 7]
    assert (g.scores(np.eye(16)[0])[g.owner > 0] < 0.5).all()


def test_a_site_goes_on_from_what_is_kept(spark, sf_dir):
    """Kept after each part and taken up again, a site tells the same; what is kept holds no feature twice and no array that persons are compared by."""
    import pickle

    from trackloom.plans import catalog

    rows = gallery.observed(catalog._sites(spark, sf_dir)).toPandas().sort_values(gallery.ORDER)
    limits = gallery.Limits(strict=0.35, edge=0.30, re_entry=0.25, most_persons=3, oldest_s=0.5)  # so that persons leave
    whole = gallery.Site(limits, 3, 5)
    parted = gallery.Site(limits, 3, 5)
    for cut in np.array_split(np.sort(rows["frame_idx"].unique()), 7):
        part = rows[rows["frame_idx"].isin(cut)]
        assert parted.rows(part) == whole.rows(part)
        data = parted.kept()
        parted = gallery.Site.of_kept(data, limits, 3, 5)
        assert parted.kept() and len(pickle.loads(data)[0]) < sum(len(p.features) + len(p.stable) + len(p.departed) for p in parted.gallery.persons.values()) + len(rows)
    assert whole.gallery.next_id > 3 and {p.global_id for p in parted.gallery.persons.values()} == set(whole.gallery.persons)
    empty = gallery.Site.of_kept(gallery.Site(limits).kept(), limits)
    assert empty.gallery.next_id == 1 and not empty.pending


def test_streams_have_more_files_as_there_are_more_rows(spark, sf_dir, monkeypatch):
    from trackloom.plans import catalog

    rows = catalog._sites(spark, sf_dir).select("site_id", "frame_idx")
    assert catalog._arrived(rows, "frame_idx", "site_id")[1] == catalog.STEP_FILES
    monkeypatch.setattr(catalog, "FILE_ROWS", 10)
    assert catalog._arrived(rows, "frame_idx", "site_id")[1] == -(-rows.count() // 30)
