"""Retrieval metrics, similarity statistics and metric-learning losses."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.labels import stepped_rate
from ..session import ship_package, written
from . import similarity

#: Entries, a query and a picture of its person each, that a group of queries has about; a query counts as ``OWN`` of them besides.
ENTRIES, OWN = 1 << 24, 4096
#: Parts of the entries of a group that one person's share is a multiple of.
UNITS = 8
#: Bits of a key that are for the place of an id.
ID_BITS = 31

_PACKED = pa.schema([("ids", pa.binary()), ("pids", pa.binary()), ("cids", pa.binary()), ("vectors", pa.binary()), ("n", pa.int32())])
_PACKED_DDL = "ids binary, pids binary, cids binary, vectors binary, n int"
_SCORED = pa.schema([("query_id", pa.int64()), ("ap", pa.float64()), ("first", pa.int64())])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of id, pid, cid and embedding as blocks of bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, similarity.BLOCK):
            part = batch.slice(i, similarity.BLOCK)
            n = part.num_rows
            names = [part.column(k).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for k in range(3)]
            vectors = np.asarray(part.column(3).flatten(), np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*names, vectors)] + [pa.array([n], pa.int32())], schema=_PACKED)


def query_groups(queries: DataFrame, gallery: DataFrame, entries: int = ENTRIES) -> tuple[DataFrame, int]:
    """``queries`` with their ``group``, and how many groups there are: each has about ``entries`` pairs of a query and a picture of its person.

    Persons with an eighth of that or more are dealt to units, of which neighbours
    share a group, so a group has few persons whose pictures it needs. Other
    persons are in one group each.
    """
    sizes = queries.groupBy("pid").agg(F.count("*").alias("nq")).join(gallery.groupBy("pid").agg(F.count("*").alias("ng")), "pid", "left")
    sizes = written(sizes.select("pid", (F.col("nq") * (F.coalesce("ng", F.lit(0)) + OWN)).alias("entries")), "person-sizes")
    total = sizes.agg(F.sum("entries")).first()[0] or 0
    count = max(-(-total // entries), min(-(-total // OWN // 256), 2 * queries.sparkSession.sparkContext.defaultParallelism), 1)
    unit = max(1, -(-total // count // UNITS))
    large = sizes.where(F.col("entries") >= unit).withColumn("units", F.ceil(F.col("entries") / unit).cast("long"))
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a few persons for each group
    large = large.select("pid", "units", F.coalesce(F.sum("units").over(ahead), F.lit(0)).alias("ahead"), F.sum("units").over(Window.partitionBy()).alias("all"))
    unit_group = F.floor((F.col("ahead") + F.pmod(F.xxhash64("id"), F.col("units"))) * count / F.col("all"))
    own = F.when(F.col("units").isNull(), F.pmod(F.xxhash64("pid"), F.lit(count))).otherwise(unit_group)
    dealt = queries.join(F.broadcast(large), "pid", "left").withColumn("group", F.least(own, F.lit(count - 1)).cast("int"))
    return dealt.drop("units", "ahead", "all"), count


class _Ranks:
    """The queries of a group. First come the queries, then their persons' pictures, then all blocks of the gallery.

    Only the ranks of a query's relevant pictures are kept, as sorted keys of
    rounded similarity and id, and how many others lie between two of them.
    """

    def __init__(self, least_id: int, spread: int):
        self.least_id, self.spread = least_id, spread
        self.queries, self.pictures = [], []
        self.ready = False

    def keys(self, s: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers, or pairs where ids are too far apart, in order of rank: the more similar first, then the lower id."""
        near = -np.rint(s * 10.0**similarity.DIGITS).astype(np.int64)
        if self.spread < 1 << ID_BITS:
            return (near << ID_BITS) + (ids - self.least_id)
        out = np.empty(np.broadcast(near, ids).shape, [("s", "i8"), ("id", "i8")])
        out["s"], out["id"] = near, ids
        return out

    def add(self, kind: int, block: tuple) -> None:
        (self.queries if kind == 0 else self.pictures).append(block)

    def settle(self) -> None:
        """The queries by person, and the keys of each one's relevant pictures."""
        self.ids, self.pids, self.cids, self.data = (np.concatenate(x) for x in zip(*self.queries))
        order = np.argsort(self.pids, kind="stable")
        self.ids, self.pids, self.cids, self.data = self.ids[order], self.pids[order], self.cids[order], self.data[order]
        edges = np.flatnonzero(np.diff(self.pids)) + 1
        self.persons = list(zip([0, *edges.tolist()], [*edges.tolist(), len(self.pids)]))
        found: list[list] = [[] for _ in self.ids]
        for g_ids, g_pids, g_cids, g_data in self.pictures:
            for a, b in self.persons:
                own = np.flatnonzero(g_pids == self.pids[a])
                for i in range(a, b, step := max(1, similarity.TOGETHER // max(1, len(own)))):
                    if not len(own):
                        break
                    s = self.data[i : min(b, i + step)] @ g_data[own].T
                    for k in range(len(s)):
                        kept = g_cids[own] != self.cids[i + k]
                        found[i + k].append(self.keys(s[k, kept], g_ids[own[kept]]))
        self.found = [np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in found]
        self.between = [np.zeros(len(x) + 1, np.int32) for x in self.found]
        self.pictures, self.ready = [], True

    def count(self, block: tuple) -> None:
        """Pictures of other persons go between the relevant ones."""
        g_ids, g_pids, _, g_data = block
        for a, b in self.persons:
            others = g_pids != self.pids[a]
            if not others.any():
                continue
            data, ids = (g_data, g_ids) if others.all() else (g_data[others], g_ids[others])
            for i in range(a, b, step := max(1, similarity.TOGETHER // len(ids))):
                keys = np.sort(self.keys(self.data[i : min(b, i + step)] @ data.T, ids[None, :]), axis=1)
                for k in range(len(keys)):
                    if len(self.found[i + k]):
                        np.add.at(self.between[i + k], np.searchsorted(self.found[i + k], keys[k]), 1)

    def told(self) -> Iterator[pa.RecordBatch]:
        if not self.queries:
            return
        if not self.ready:
            self.settle()
        ap, first = [], []
        for keys, between in zip(self.found, self.between):
            n = np.arange(1, len(keys) + 1)
            rank = n + np.cumsum(between[:-1], dtype=np.int64)
            ap.append(float((n / rank).mean()) if len(n) else None)
            first.append(int(rank[0]) if len(n) else None)
        yield pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(ap, pa.float64()), pa.array(first, pa.int64())], schema=_SCORED)


def average_precisions(queries: DataFrame, gallery: DataFrame, block: int = similarity.BLOCK, entries: int = ENTRIES) -> DataFrame:
    """query_id, ap (average precision) and first (the best rank) over the gallery's pictures of the query's person (other cameras); both null if there are none.

    ``queries`` and ``gallery`` have id, pid, cid and embedding. No pair of
    vectors is ever a row. Queries are in groups of a bounded number of relevant
    pictures, for each of which a task keeps a key and a count; the gallery goes
    past each group in blocks. So a task's memory is that of its group. What is
    shuffled is a copy of the gallery for each group: as many groups as there are
    tasks at a time are one round, so no more copies than that are on disk.
    """
    ship_package(queries.sparkSession)
    dealt, count = query_groups(queries, gallery, entries)
    together = queries.sparkSession.sparkContext.defaultParallelism
    ends = gallery.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    least_id, spread = (int(ends["a"]), int(ends["b"]) - int(ends["a"])) if ends["a"] is not None else (0, 0)
    columns = [*[F.col(c).cast("long").alias(c) for c in ("id", "pid", "cid")], F.col("embedding").cast("array<float>").alias("embedding")]
    blocks = written(gallery.select(*columns).repartition(max(1, -(-gallery.count() // max(1, block))), "id").mapInArrow(_packed, _PACKED_DDL), "packed-gallery")
    single = lambda df, kind: df.select(F.col("group"), F.lit(kind).alias("kind"), *[F.array(c).alias(f"{c}s") for c in ("id", "pid", "cid")], "embedding")
    none = lambda kind: F.lit(None).cast(kind)
    dealt = written(dealt.select("group", *columns), "query-groups")

    def rows_of(first: int, last: int) -> DataFrame:
        """What the groups from ``first`` to ``last`` get: their queries, their persons' pictures, the gallery."""
        asked = dealt.where(F.col("group").between(first, last))
        persons = F.broadcast(asked.select("group", "pid").distinct())
        own = single(asked, 0).unionByName(single(gallery.select(*columns).join(persons, "pid"), 1))
        own = own.select("group", "kind", F.element_at("ids", 1).alias("id"), F.element_at("pids", 1).alias("pid"), F.element_at("cids", 1).alias("cid"), "embedding")
        own = own.select("*", none("binary").alias("ids"), none("binary").alias("pids"), none("binary").alias("cids"), none("binary").alias("vectors"))
        past = blocks.select(
            F.explode(F.sequence(F.lit(first), F.lit(last))).alias("group"), F.lit(2).alias("kind"), none("long").alias("id"), none("long").alias("pid"),
            none("long").alias("cid"), none("array<float>").alias("embedding"), "ids", "pids", "cids", "vectors"
        )
        return own.unionByName(past).repartitionById(last - first + 1, F.col("group") - first).sortWithinPartitions("group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ranks = None, _Ranks(least_id, spread)
        for batch in batches:
            names, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            i = 0
            while i < len(names):
                if names[i] != group:
                    yield from ranks.told()
                    group, ranks = names[i], _Ranks(least_id, spread)
                j = i + 1
                if kinds[i] < 2:
                    while j < len(names) and names[j] == group and kinds[j] == kinds[i]:
                        j += 1
                    part = batch.slice(i, j - i)
                    values = [part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)]
                    ranks.add(int(kinds[i]), (*values, _unit(np.asarray(part.column(5).flatten(), np.float64).reshape(j - i, -1))))
                elif ranks.queries:
                    if not ranks.ready:
                        ranks.settle()
                    ids, pids, cids = (np.frombuffer(batch.column(k)[i].as_py(), np.int64) for k in (6, 7, 8))
                    if len(ids):
                        ranks.count((ids, pids, cids, _unit(np.frombuffer(batch.column(9)[i].as_py(), np.float32).reshape(len(ids), -1))))
                i = j
        yield from ranks.told()

    found = [
        rows_of(i, min(i + together, count) - 1).mapInArrow(run, "query_id long, ap double, first long") for i in range(0, count, together)
    ]
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, [written(x, "average-precisions") for x in found])


def _unit(data: np.ndarray) -> np.ndarray:
    data = data.astype(np.float64)
    return data / (np.linalg.norm(data, axis=1, keepdims=True) + 1e-8)


def cmc_map(queries: DataFrame, gallery: DataFrame, ranks: tuple[int, ...] = (1, 5, 10), block: int = similarity.BLOCK) -> DataFrame:
    """One row: mAP and the cumulative match characteristic at ``ranks``.

    A query whose whole gallery is left out doesn't count for mAP but does for
    the match characteristic; one without relevant pictures has precision 0.
    """
    each = average_precisions(queries, gallery, block)
    sizes = gallery.groupBy("pid", "cid").agg(F.count("*").alias("left_out"))
    total = gallery.agg(F.count("*").alias("total"))
    kept = queries.join(sizes, ["pid", "cid"], "left").join(F.broadcast(total)).select(
        F.col("id").alias("query_id"), (F.col("total") > F.coalesce("left_out", F.lit(0))).alias("has_gallery")
    )
    scored = kept.join(each, "query_id", "left")
    hits = [F.round(F.count_if(F.col("first") <= k) / F.count("*"), 6).alias(f"cmc_{k}") for k in ranks]
    return scored.agg(F.round(F.sum(F.when(F.col("has_gallery"), F.coalesce("ap", F.lit(0.0)))) / F.count_if("has_gallery"), 6).alias("map"), *hits)


class _Sums:
    """What is to be known of a set of unit vectors. The second-moment matrix is made once there are as many vectors as dimensions; fewer stay as they are."""

    def __init__(self, n: int = 0, own: float = 0.0, own2: float = 0.0, total=None, moment=None, raw=None):
        self.n, self.own, self.own2, self.total = n, own, own2, None if total is None else np.array(total)
        d = 0 if total is None else len(self.total)
        self.moment = None if moment is None else np.array(moment).reshape(d, d)
        self.raw = [] if not raw else [np.array(raw).reshape(-1, d)]

    def add(self, u: np.ndarray) -> None:
        own = (u * u).sum(1)
        self.merge(_Sums(len(u), own.sum(), (own * own).sum(), u.sum(0)), [u])

    def merge(self, other: _Sums, raw: list | None = None) -> None:
        self.n, self.own, self.own2 = self.n + other.n, self.own + other.own, self.own2 + other.own2
        self.total = other.total if self.total is None else self.total + other.total
        if other.moment is not None:
            self.moment = other.moment if self.moment is None else self.moment + other.moment
        self.raw += other.raw if raw is None else raw
        if sum(map(len, self.raw)) >= len(self.total):
            u = np.concatenate(self.raw)
            self.moment = u.T @ u if self.moment is None else self.moment + u.T @ u
            self.raw = []

    def row(self, label: int | None) -> dict:
        return {
            "label": label, "n": self.n, "own": float(self.own), "own2": float(self.own2), "total": self.total.tolist(),
            "moment": None if self.moment is None else self.moment.ravel().tolist(), "raw": np.concatenate(self.raw).ravel().tolist() if self.raw else None
        }

    def squares(self) -> tuple[float, float]:
        """The squared length of the vectors' sum, and the sum of the squared cosines of all pairs."""
        if self.moment is None:
            u = np.concatenate(self.raw)
            second = u @ u.T
        else:
            second = self.moment if not self.raw else self.moment + sum(u.T @ u for u in self.raw)
        return float(self.total @ self.total), float((second * second).sum())


_SUMS = pa.schema([
    ("label", pa.int64()), ("n", pa.int64()), ("own", pa.float64()), ("own2", pa.float64()), ("total", pa.list_(pa.float64())),
    ("moment", pa.list_(pa.float64())), ("raw", pa.list_(pa.float64()))
])
_SUMS_DDL = "label long, n long, own double, own2 double, total array<double>, moment array<double>, raw array<double>"
#: Labels whose sums a task holds, and parts that one label's sums are dealt to before they meet.
HELD, PARTS = 1000, 16


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by label, and of all under a null label, of what a task reads."""
    held: dict[int | None, _Sums] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(label), -1)
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
        held.setdefault(None, _Sums()).add(x)
        order = np.argsort(label, kind="stable")
        edges = np.flatnonzero(np.diff(label[order])) + 1
        for own in np.split(order, edges):
            held.setdefault(int(label[own[0]]), _Sums()).add(x[own])
        if len(held) > HELD:
            yield pa.RecordBatch.from_pylist([s.row(k) for k, s in held.items()], _SUMS)
            held.clear()
    if held:
        yield pa.RecordBatch.from_pylist([s.row(k) for k, s in held.items()], _SUMS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums in order of label to one row for each."""
    label, sums = None, None
    for batch in batches:
        for r in batch.select(_SUMS.names).to_pylist():
            name = r.pop("label")
            if sums is None or name != label:
                if sums is not None:
                    yield pa.RecordBatch.from_pylist([sums.row(label)], _SUMS)
                label, sums = name, _Sums()
            sums.merge(_Sums(**r))
    if sums is not None:
        yield pa.RecordBatch.from_pylist([sums.row(label)], _SUMS)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("label", pa.int64()), *[(x, pa.int64() if x == "n" else pa.float64()) for x in ("n", "own", "own2", "s1", "s2")]])
    for batch in _merged(batches):
        r = batch.to_pylist()[0]
        label = r.pop("label")
        sums = _Sums(**r)
        s1, s2 = sums.squares()
        yield pa.RecordBatch.from_pylist([{"label": label, "n": sums.n, "own": sums.own, "own2": sums.own2, "s1": s1, "s2": s2}], schema)


def label_sums(vectors: DataFrame) -> DataFrame:
    """For each label, and for all vectors under a null label: n, and the sums that all pairs' cosines follow from. One scan.

    A task adds up what it reads; a label's partial sums meet in parts first, so
    no task gets those of a frequent label, or of all, at once.
    """
    ship_package(vectors.sparkSession)
    parts = vectors.select(F.col("label").cast("long"), F.col("embedding").cast("array<double>")).where("label is not null").mapInArrow(_summed, _SUMS_DDL)
    parts = parts.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    parts = parts.repartition("label", "part").sortWithinPartitions("part", "label").mapInArrow(_merged, _SUMS_DDL)
    return parts.repartition("label").sortWithinPartitions("label").mapInArrow(_told, "label long, n long, own double, own2 double, s1 double, s2 double")


def similarity_separation(vectors: DataFrame) -> DataFrame:
    """Mean and population deviation of the cosine over all pairs of one label and of different ones, and the means' distance.

    All pairs, yet none is made: over a set of unit vectors the cosines sum to
    the squared length of the vectors' sum, and their squares to the squared
    entries of the second-moment matrix, or of the products of all pairs where
    there are fewer vectors than dimensions. Rows without a label are left out.
    """
    sums = label_sums(vectors)
    labelled, every = F.col("label").isNotNull(), F.col("label").isNull()
    of = lambda value, which: F.sum(F.when(which, value))
    one = sums.agg(
        of(F.col("n") * (F.col("n") - 1), labelled).alias("pairs"), of(F.col("s1") - F.col("own"), labelled).alias("sum"),
        of(F.col("s2") - F.col("own2"), labelled).alias("squares"), *[of(F.col(x), every).alias(x) for x in ("n", "own", "own2", "s1", "s2")]
    )
    n, different = F.col("n"), F.col("n") * (F.col("n") - 1) - F.col("pairs")
    dsum, dsquares = F.col("s1") - F.col("own") - F.col("sum"), F.col("s2") - F.col("own2") - F.col("squares")
    spread = lambda s, q, m: F.sqrt(F.greatest(F.lit(0.0), q / m - (s / m) * (s / m)))
    out = one.select(
        (F.col("sum") / F.col("pairs")).alias("same_mean"), spread(F.col("sum"), F.col("squares"), F.col("pairs")).alias("same_std"),
        (dsum / different).alias("different_mean"), spread(dsum, dsquares, different).alias("different_std")
    )
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns], F.round(F.col("same_mean") - F.col("different_mean"), 6).alias("separation"))


def triplet_loss(triplets: DataFrame, margin: float = 0.3) -> DataFrame:
    """Mean loss over rows of anchor, positive and negative vectors."""
    loss = F.greatest(F.lit(0.0), vec.squared_distance(F.col("anchor"), F.col("positive")) - vec.squared_distance(F.col("anchor"), F.col("negative")) + margin)
    return triplets.agg(F.count("*").alias("triplets"), F.round(F.avg(loss), 6).alias("loss"))


def batch_hard_loss(vectors: DataFrame, margin: float = 0.3, strict: bool = False) -> DataFrame:
    """For each batch (batch, id, label, embedding) its valid anchors and mean loss against the hardest pair.

    Unless ``strict``, a vector counts among its own negatives, as its distance
    to itself is not masked there.
    """
    ship_package(vectors.sparkSession)
    schema = pa.schema([("batch", pa.int64()), ("far", pa.float64()), ("near", pa.float64())])

    def hardest(key: tuple, rows: pa.Table) -> pa.Table:
        """The farthest of one label and the nearest of another, for each vector of a batch; some rows of the distances at a time."""
        ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
        x = np.asarray(rows.column("embedding").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        own = (x * x).sum(1)
        far, near = np.zeros(len(ids)), np.full(len(ids), np.inf)
        for i in range(0, len(ids), similarity.BLOCK):
            some = slice(i, i + similarity.BLOCK)
            d = np.sqrt(np.maximum(0.0, own[some, None] - 2 * (x[some] @ x.T) + own) + 1e-8)
            itself, same = ids[some, None] == ids, labels[some, None] == labels
            far[some] = np.where(same & ~itself, d, 0.0).max(1)
            near[some] = np.where(~same if strict else ~same | itself, d, np.inf).min(1)
        return pa.table([np.full(len(ids), key[0].as_py()), far, near], schema=schema)

    rows = vectors.select(F.col("batch").cast("long"), F.col("id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    hard = rows.groupBy("batch").applyInArrow(hardest, "batch long, far double, near double")
    valid = hard.where((F.col("far") > 0) & (F.col("near") < 1e6))
    return valid.groupBy("batch").agg(F.count("*").alias("anchors"), F.round(
        F.avg(F.greatest(F.lit(0.0), F.col("far") - F.col("near") + margin)), 6
    ).alias("loss"))


def combined_loss(triplet: DataFrame, logits: DataFrame | None = None, triplet_weight: float = 1.0, entropy_weight: float = 1.0) -> DataFrame:
    """Weighted triplet loss (column loss), plus the mean cross entropy of ``logits`` (logits array, label) if given."""
    if logits is None:
        return triplet.select((F.col("loss") * triplet_weight).alias("loss"))
    top = F.array_max("logits")
    entropy = F.log(F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top - F.element_at("logits", F.col("label").cast("int") + 1)
    return triplet.join(F.broadcast(logits.agg(F.avg(entropy).alias("entropy")))).select((F.col("loss") * triplet_weight + F.col("entropy") * entropy_weight).alias("loss"))


def best_so_far(history: DataFrame, rate: float = 3e-4, step: int = 10, stretch: int = 10_000) -> DataFrame:
    """Adds to epoch and loss: whether the loss is a new low, the low so far, and the stepped learning rate.

    Lows are taken within stretches of epochs and carried over a table of the
    stretches, so a long history isn't one window.
    """
    df = history.withColumn("part", F.floor(F.col("epoch") / stretch))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lows = df.groupBy("part").agg(F.min("loss").alias("low")).select("part", F.min("low").over(before).alias("carried"))
    own = Window.partitionBy("part").orderBy("epoch")
    df = df.join(lows, "part").withColumns({
        "earlier": F.least("carried", F.min("loss").over(own.rowsBetween(Window.unboundedPreceding, -1))),
        "best": F.least("carried", F.min("loss").over(own.rowsBetween(Window.unboundedPreceding, 0))),
    })
    is_best = F.col("earlier").isNull() | (F.col("loss") < F.col("earlier"))
    return df.select(*history.columns, is_best.alias("is_best"), "best", stepped_rate(rate, F.col("epoch"), step).alias("lr"))
