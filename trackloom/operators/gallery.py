"""Identities of tracks over cameras and time.

``match_tracklets`` decides for all tracklets at once. ``resolve`` follows the
order of events: each decision changes the gallery that the next one sees, so
it is a fold over a site's observations; sites are independent and run in
parallel.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, ship_package, written
from . import similarity


#: Parts that the rows of one identity are dealt to.
PARTS = 8


def match_tracklets(tracklets: DataFrame, threshold: float = 0.7, block: int = similarity.BLOCK) -> DataFrame:
    """id, matched_id, similarity and global_id for tracklets (id, embedding).

    A tracklet joins its most similar earlier one if that reaches the threshold,
    and so has that one's identity; otherwise it starts one. Every link leads to
    a lower id, so identities are found by doubling: log2 of the longest chain
    rounds of one equi-join each.
    """
    best = similarity.top_k(tracklets, tracklets, 1, threshold, earlier_only=True, block=block).select(
        F.col("query_id").alias("id"), F.col("gallery_id").alias("matched_id"), "similarity"
    )
    linked = tracklets.select("id").join(best, "id", "left").withColumn("root", F.coalesce("matched_id", "id"))
    linked = last = written(linked, "identity-links")
    while True:
        # an identity may have most of the rows: they are dealt to parts, each of which meets a copy of its row
        up = linked.select(F.col("id").alias("root"), F.col("root").alias("above"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        met = linked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(up, ["root", "part"])
        changed = (F.col("above") != F.col("root")).alias("changed")
        moved = written(met.select("id", "matched_id", "similarity", F.col("above").alias("next"), changed), "identity-links")
        dropped(last)
        last = moved
        linked = moved.select("id", "matched_id", "similarity", F.col("next").alias("root"))
        if moved.where("changed").isEmpty():
            return linked.withColumnRenamed("root", "global_id")


def statistics(assigned: DataFrame) -> DataFrame:
    """Persons, the next free id, distinct cameras, and persons seen by more than one, from rows of global_id and camera_name."""
    each = assigned.where("global_id is not null").groupBy("global_id").agg(F.count_distinct("camera_name").alias("cameras"))
    cameras = assigned.where("global_id is not null").agg(F.count_distinct("camera_name").alias("total_cameras"))
    return each.agg(
        F.count("*").alias("total_persons"), (F.coalesce(F.max("global_id"), F.lit(0)) + 1).alias("next_global_id"),
        F.count_if(F.expr("cameras > 1")).alias("cross_camera_persons")
    ).join(F.broadcast(cameras))


@dataclass
class Limits:
    """Thresholds and sizes of the gallery."""

    strict: float = 0.70
    edge: float = 0.62
    re_entry: float = 0.45
    re_entry_window_s: float = 120.0
    recent_s: float = 8.0
    least_iou: float = 0.20
    most_persons: int = 1000
    oldest_s: float = 3600.0
    features: int = 50
    recent_features: int = 15
    anchored: int = 10
    reservoir: int = 20
    departures: int = 5


@dataclass
class Person:
    global_id: int
    last_seen: float
    cameras: set = field(default_factory=set)
    features: list = field(default_factory=list)
    stable: list = field(default_factory=list)
    departed: list = field(default_factory=list)
    box: np.ndarray | None = None
    detections: int = 0
    stable_count: int = 0


class Gallery:
    """The gallery of one site. Time is event time, and draws depend on identity and count only, so a replay gives the same result.

    What persons are compared by is one array: a block of rows for each person,
    of unit length, with zeros where it has fewer. A query is one product with
    all blocks; blocks that changed are renewed before.
    """

    def __init__(self, limits: Limits | None = None):
        self.limits = limits or Limits()
        self.persons: dict[int, Person] = {}
        self.known: dict[tuple[str, int], int] = {}
        self.next_id = 1
        self.slots: dict[int, int] = {}
        self.free: list[int] = []
        self.changed: set[int] = set()
        self.pool = np.zeros((0, 0, 0))
        self.owner = np.zeros(0, np.int64)  # 0 where a block has none

    def _enter(self, person: Person) -> None:
        if not self.free:
            at = self.limits
            n, rows = len(self.owner), at.anchored + at.reservoir + at.departures
            more = max(16, n)
            grown = np.zeros((n + more, max(rows, at.recent_features + at.departures), len(person.features[0])))
            if n:
                grown[:n] = self.pool
            self.pool, self.owner = grown, np.concatenate((self.owner, np.zeros(more, np.int64)))
            self.free = list(range(n + more - 1, n - 1, -1))
        slot = self.free.pop()
        self.persons[person.global_id], self.slots[person.global_id] = person, slot
        self.owner[slot] = person.global_id
        self.changed.add(person.global_id)

    def _leave(self, global_id: int) -> None:
        slot = self.slots.pop(global_id)
        self.pool[slot], self.owner[slot] = 0, 0
        self.free.append(slot)
        self.changed.discard(global_id)
        del self.persons[global_id]

    def add(self, person: Person, feature: np.ndarray, camera: str, now: float, stable: bool) -> None:
        self.changed.add(person.global_id)
        person.features = [*person.features, feature][-self.limits.features :]
        person.last_seen = now
        person.cameras.add(camera)
        person.detections += 1
        if not stable:
            return
        person.stable_count += 1
        room = self.limits.anchored + self.limits.reservoir
        if len(person.stable) < room:
            person.stable.append(feature)
        elif person.stable_count > self.limits.anchored:
            slot = int(np.random.default_rng((person.global_id, person.stable_count)).integers(0, person.stable_count - self.limits.anchored))
            if slot < self.limits.reservoir:
                person.stable[self.limits.anchored + slot] = feature

    def _compared(self, person: Person) -> list:
        own = person.stable if len(person.stable) >= 3 else person.features[-self.limits.recent_features :]
        return [*own, *person.departed] if own else []

    def scores(self, feature: np.ndarray) -> np.ndarray:
        """The best cosine of each block with ``feature``, 0 at least."""
        for i in self.changed:
            slot, rows = self.slots[i], self._compared(self.persons[i])
            self.pool[slot] = 0
            if rows:
                stack = np.stack(rows)
                self.pool[slot, : len(rows)] = stack / (np.linalg.norm(stack, axis=1, keepdims=True) + 1e-8)
        self.changed.clear()
        if not len(self.owner):
            return np.zeros(0)
        return np.maximum(0.0, (self.pool @ (feature / (np.linalg.norm(feature) + 1e-8))).max(1))

    def threshold(self, person: Person, camera: str, now: float, edge: bool) -> float:
        at, age = self.limits, now - person.last_seen
        if age > at.recent_s:
            return at.re_entry if camera in person.cameras and age < at.re_entry_window_s else at.strict
        return min(at.edge if edge else at.strict, at.edge if person.stable_count < 5 else at.strict)

    def _match(self, feature: np.ndarray, camera: str, now: float, active: set, edge: bool, box: np.ndarray | None) -> int | None:
        """The most similar person that may be meant, else the one whose last box fits; of equal ones the first."""
        taken = {self.known[(camera, t)] for t in active if (camera, t) in self.known}
        scores = self.scores(feature)
        able = (self.owner > 0) & ~np.isin(self.owner, list(taken))
        likely = np.flatnonzero(able & (scores > 0))
        for slot in likely[np.lexsort((self.owner[likely], -scores[likely]))].tolist():
            if scores[slot] >= self.threshold(self.persons[int(self.owner[slot])], camera, now, edge):
                return int(self.owner[slot])
        if box is None:
            return None
        near = []
        for slot in np.flatnonzero(able).tolist():
            person = self.persons[int(self.owner[slot])]
            if person.box is not None and (o := _iou(box, person.box)) >= self.limits.least_iou:
                near.append((0.4 * o + 0.6 * float(scores[slot]), -person.global_id))
        return -max(near)[1] if near and max(near)[0] > 0 else None

    def find_or_create(
        self, local: int, feature: np.ndarray, camera: str, now: float, active: set, update: bool = True, edge: bool = False,
        box: np.ndarray | None = None
    ) -> int:
        key = (camera, local)
        if (found := self.known.get(key)) is None:
            found = self._match(feature, camera, now, active, edge, box)
            if found is None:
                self._make_room(now)
                found, self.next_id = self.next_id, self.next_id + 1
                self._enter(Person(found, now, {camera}, [feature], [] if edge else [feature], [], box, 1, 0 if edge else 1))
                self.known[key] = found
                return found
            self.known[key] = found
        if (person := self.persons.get(found)) is not None:
            if update:
                self.add(person, feature, camera, now, not edge)
            if box is not None:
                person.box = box
        return found

    def _make_room(self, now: float) -> None:
        if len(self.persons) >= self.limits.most_persons:
            old = [i for i, p in self.persons.items() if now - p.last_seen > self.limits.oldest_s]
            for i in old[: len(self.persons) // 4]:
                self._leave(i)

    def record_departure(self, global_id: int, views: list) -> None:
        if (person := self.persons.get(global_id)) is not None:
            person.departed = list(views)[-self.limits.departures :]
            self.changed.add(global_id)

    def clear_camera(self, camera: str) -> None:
        self.known = {k: v for k, v in self.known.items() if k[0] != camera}


def _iou(a: np.ndarray, b: np.ndarray) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return float(w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h + 1e-8))


class Site:
    """Frames of one site in order: pending tracks, identities and departures."""

    def __init__(self, limits: Limits | None = None, stable: int = 15, most: int = 45):
        self.gallery, self.stable, self.most = Gallery(limits), stable, most
        self.pending: dict[tuple[str, int], dict] = {}
        self.buffer: dict[tuple[str, int], list] = {}
        self.before: dict[str, dict[int, tuple]] = {}

    def kept(self) -> bytes:
        """All that the next frames depend on, as plain values and one array of the features; a feature that several lists hold is there once."""
        features, places = [], {}

        def place(x: np.ndarray) -> int:
            if (i := places.get(id(x))) is None:
                i = places[id(x)] = len(features)
                features.append(x)
            return i

        at = lambda xs: [place(x) for x in xs]
        g = self.gallery
        persons = [(
            p.global_id, p.last_seen, p.cameras, at(p.features), at(p.stable), at(p.departed), None if p.box is None else p.box.tolist(),
            p.detections, p.stable_count
        ) for p in g.persons.values()]
        pending = {k: (at(v["features"]), v["stable"]) for k, v in self.pending.items()}
        buffer = {k: at(v) for k, v in self.buffer.items()}
        before = {c: {t: (found, place(x)) for t, (found, x) in own.items()} for c, own in self.before.items()}
        even = len({x.shape for x in features}) == 1
        return pickle.dumps((np.stack(features) if even else features, persons, g.known, g.next_id, g.slots, g.free, g.pool.shape, pending, buffer, before))

    @classmethod
    def of_kept(cls, data: bytes, limits: Limits | None = None, stable: int = 15, most: int = 45) -> Site:
        """The site that :meth:`kept` told of. What persons are compared by is worked out anew from their features."""
        features, persons, known, next_id, slots, free, shape, pending, buffer, before = pickle.loads(data)
        features = list(features)
        of = lambda places: [features[i] for i in places]
        site = cls(limits, stable, most)
        g = site.gallery
        g.known, g.next_id, g.slots, g.free = known, next_id, slots, free
        g.pool, g.owner = np.zeros(shape), np.zeros(shape[0], np.int64)
        for i, seen, cameras, own, steady, departed, box, detections, count in persons:
            g.persons[i] = Person(i, seen, cameras, of(own), of(steady), of(departed), None if box is None else np.array(box), detections, count)
            g.owner[slots[i]] = i
        g.changed = set(g.persons)
        site.pending = {k: {"features": of(v), "stable": n} for k, (v, n) in pending.items()}
        site.buffer = {k: of(v) for k, v in buffer.items()}
        site.before = {c: {t: (found, features[x]) for t, (found, x) in own.items()} for c, own in before.items()}
        return site

    def frame(self, camera: str, now: float, rows: list[tuple[int, np.ndarray, np.ndarray, bool]]) -> list[int | None]:
        """Identities of a frame's (local id, feature, box, edge); none while a track is pending."""
        active, out = {r[0] for r in rows}, []
        for local, feature, box, edge in rows:
            key = (camera, local)
            if key in self.gallery.known:
                out.append(self.gallery.find_or_create(local, feature, camera, now, active, not edge, edge, box))
                continue
            own = self.pending.setdefault(key, {"features": [], "stable": 0})
            if feature.any():
                own["features"].append(feature)
                own["stable"] += not edge
            if own["stable"] < self.stable and len(own["features"]) < self.most:
                out.append(None)
                continue
            mean = np.mean(own["features"], axis=0)
            found = self.gallery.find_or_create(local, mean / (np.linalg.norm(mean) + 1e-8), camera, now, active, box=box)
            if (person := self.gallery.persons.get(found)) is not None:
                for view in own["features"][:: max(1, len(own["features"]) // 10)]:
                    self.gallery.add(person, view, camera, now, True)
            del self.pending[key]
            out.append(found)
        for local, feature, _, _ in rows:
            if feature.any():
                self.buffer[(camera, local)] = [*self.buffer.get((camera, local), []), feature][-5:]
        for local, (found, feature) in self.before.get(camera, {}).items():
            if local not in active:
                views = self.buffer.pop((camera, local), None) or ([feature] if feature.any() else [])
                if found is not None and views:
                    self.gallery.record_departure(found, views)
        self.pending = {k: v for k, v in self.pending.items() if k[0] != camera or k[1] in active}
        self.before[camera] = {r[0]: (g, r[1]) for r, g in zip(rows, out, strict=True)}
        return out


    def rows(self, data: pd.DataFrame, open_frame: list | None = None) -> list[tuple]:
        """camera, track, frame and identity of rows in order, a frame at a time; the last frame is held in ``open_frame`` if that is given."""
        out, frame = [], list(open_frame or [])
        for r in data.itertuples(index=False):
            if frame and (r.camera_name != frame[0].camera_name or r.frame_idx != frame[0].frame_idx):
                out += self._told(frame)
                frame = []
            frame.append(r)
        if open_frame is None:
            return out + (self._told(frame) if frame else [])
        open_frame[:] = frame
        return out

    def _told(self, frame: list) -> list[tuple]:
        rows = [(int(r.track_id), np.asarray(r.embedding, np.float64), np.trunc(np.array([r.x1, r.y1, r.x2, r.y2])), bool(r.is_edge)) for r in frame]
        found = self.frame(frame[0].camera_name, float(frame[0].t), rows)
        return [(r.camera_name, int(r.track_id), int(r.frame_idx), g) for r, g in zip(frame, found, strict=True)]


RESOLVED = "site_id string, camera_name string, track_id long, frame_idx long, global_id long"
ORDER = ["frame_idx", "camera_name", "track_id"]


def as_resolved(site: str, rows: list[tuple]) -> pd.DataFrame:
    camera, track, frame, found = zip(*rows) if rows else ((), (), (), ())
    return pd.DataFrame({"site_id": site, "camera_name": camera, "track_id": track, "frame_idx": frame, "global_id": pd.array(found, "Int64")})


def observed(observations: DataFrame) -> DataFrame:
    """The columns that a site needs, as it needs them."""
    return observations.select(
        "site_id", "camera_name", F.col("track_id").cast("long"), F.col("frame_idx").cast("long"), F.col("t").cast("double"),
        F.col("embedding").cast("array<double>"), "is_edge", "x1", "y1", "x2", "y2",
    )


def resolve(observations: DataFrame, limits: Limits | None = None, stable: int = 15, most: int = 45) -> DataFrame:
    """global_id of every observation (site_id, camera_name, track_id, frame_idx, t seconds, embedding, is_edge, x1..y2); null while pending.

    A site's frames come to its task in order and in batches, so a task holds
    the site's gallery, which is bounded, and one frame.
    """
    ship_package(observations.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, own, frame = None, None, []
        for batch in batches:
            for name, part in batch.groupby("site_id", sort=False):
                if name != site:
                    if frame:
                        yield as_resolved(site, own._told(frame))
                    site, own, frame = name, Site(limits, stable, most), []
                yield as_resolved(site, own.rows(part, frame))
        if frame:
            yield as_resolved(site, own._told(frame))

    ordered = observed(observations).repartition("site_id").sortWithinPartitions("site_id", *ORDER)
    return ordered.mapInPandas(run, RESOLVED)
