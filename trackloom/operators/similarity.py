"""Similarity of vectors in blocks.

A pair of blocks is a row, and numpy multiplies it as matrices, so no row is
ever made for a pair of vectors that doesn't count. Blocks are of bounded size;
the smaller side's blocks are copied to each block of the other by an equi-join
on the block's number, not by a cross join of vectors.

:func:`top_k` multiplies only blocks that can hold one of a query's best. Vectors
lie in cells: the nearest of some pivots, and a ring of angles around it. By the
triangle inequality of angles, a query at angle t from a pivot is no nearer to
the cell's vectors than t is to the ring. A query first meets a block of its own
cell, whose k-th best is a bound for all others; then only cells that can reach
the bound are multiplied, with only those queries. The bounds are exact, so the
results are those of all pairs, whatever the pivots.

Vectors without structure are in reach of everything, so all pairs of cells
meet. What is handed on then is a copy of the queries for each cell. Cells are
therefore made of neighbouring rings until they are about a block, and blocks
grow with the vectors up to ``LARGEST``: a query has some ``MOST_CELLS`` copies,
or one for each ``LARGEST`` vectors where there are more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch, ship_package, written

#: Vectors in a block, about.
BLOCK = 2048
#: Pairs of blocks up to which all are multiplied.
FEW_PAIRS = 4
#: Pivots at most; they and the cells around them are broadcast. Each is picked from so many vectors.
MOST_PIVOTS, PICKED_FROM = 1024, 4
#: Rings of angles around a pivot, and ranges of ids where only lower ids count.
RINGS, SLABS = 16, 8
#: Cells that the vectors are in, about, as long as a block has no more than so many vectors; more if a copy of each vector for each cell is no more than so many copies.
MOST_CELLS, LARGEST, FEW_COPIES = 64, 8192, 1 << 19
#: Products that are held at once.
TOGETHER = 1 << 21
#: Shorter vectors lose length where they are brought to unit length, so no bound holds for them.
SHORT, SLACK = 1e-5, 1e-6
#: Digits by which similarities are ranked; closer ones tie, and the lower id is first.
DIGITS = 9


def blocks(vectors: DataFrame, number: str, count: int, columns: list[str]) -> DataFrame:
    """``vectors`` (id, embedding and other columns) as ``count`` rows: number and ``rows``, an array of structs."""
    picked = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias(number)
    return vectors.select(picked, F.struct(
        "id", F.col("embedding").cast("array<float>").alias("embedding"), *columns
    ).alias("row")).groupBy(number).agg(F.collect_list("row").alias("rows"))


def block_pairs(queries: DataFrame, gallery: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """A row for each block of queries and block of the gallery: q, g, queries, gallery."""
    nq, ng = (max(1, -(-df.count() // block)) for df in (queries, gallery))
    left = blocks(queries, "q", nq, columns).withColumnRenamed("rows", "queries")
    left = left.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(ng - 1))))
    right = blocks(gallery, "g", ng, columns).withColumnRenamed("rows", "gallery")
    return left.join(right, "g")


def _matrix(rows: pa.StructScalar | pa.ListScalar) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Unit vectors and the other columns of a block."""
    values = rows.values
    flat = values.field("embedding")
    n = len(values)
    data = np.asarray(flat.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    data = data / (np.linalg.norm(data, axis=1, keepdims=True) + 1e-8)
    names = [values.type.field(i).name for i in range(values.type.num_fields)]
    return data, {k: values.field(k).to_numpy(zero_copy_only=False) for k in names if k != "embedding"}


def over_blocks(pairs: DataFrame, compare: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """``compare(cosines, query columns, gallery columns)`` for each pair of blocks, some queries at a time; it returns columns of ``schema``."""
    ship_package(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                (a, q), (b, g) = _matrix(left), _matrix(right)
                step = max(1, TOGETHER // max(1, len(b)))
                for i in range(0, len(a), step):
                    out = compare(a[i : i + step] @ b.T, {k: x[i : i + step] for k, x in q.items()}, g)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    return pairs.select("queries", "gallery").mapInArrow(run, schema)


FOUND = pa.schema([("query_id", pa.int64()), ("gallery_id", pa.int64()), ("similarity", pa.float64())])
_FOUND_DDL = "query_id long, gallery_id long, similarity double"
_PLACED = pa.schema([("id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("cell", pa.int64()), ("angle", pa.float64())])
_PLACED_DDL = "id long, embedding array<float>, cell long, angle double"
_ROWS = pa.list_(pa.struct([("id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("bound", pa.float64())]))
_WANTED_DDL = "queries array<struct<id:long,embedding:array<float>,bound:double>>, cell long, first int"


def _unit(flat: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.asarray(flat, np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    length = np.linalg.norm(data, axis=1)
    return data / (length[:, None] + 1e-8), length


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def pick_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """``count`` unit vectors far from each other, out of a sample of bounded size: any choice gives right results."""
    sample = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding")).orderBy(F.xxhash64("id"), "id").limit(PICKED_FROM * count)
    found = sample.toArrow().column("embedding").combine_chunks()
    data, length = _unit(found.flatten(), len(found))
    data = data[length > SHORT]
    if not len(data):
        return np.zeros((0, data.shape[1]))
    picked, far = [0], 1 - data @ data[0]
    while len(picked) < min(count, len(data)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, 1 - data @ data[picked[-1]])
    return data[picked]


def _placed(vectors: DataFrame, pivots, cuts: list[int]) -> DataFrame:
    """``vectors`` with their cell (nearest pivot, ring and range of ids) and their angle to the pivot. Short vectors are in the cells of pivot -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                data, length = _unit(part.column(1).flatten(), part.num_rows)
                near, angle = np.full(len(ids), -1), np.zeros(len(ids))
                if len(pivots.value):
                    angles = _angles(data, pivots.value)
                    long = length > SHORT
                    near[long] = angles.argmin(1)[long]
                    angle[long] = angles.min(1)[long]
                ring = np.minimum((angle * (2 * RINGS / np.pi)).astype(np.int64), RINGS - 1)
                cell = (near * RINGS + ring) * SLABS + np.searchsorted(cuts, ids, "left")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.list_(pa.float32())), pa.array(cell), pa.array(angle)], schema=_PLACED)

    return vectors.select(F.col("id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(run, _PLACED_DDL)


def _cell_blocks(placed: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``placed`` by cell and part of it, as arrays of structs; ``cells`` has the number of parts of each cell, which is a table of bounded size."""
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    rows = placed.join(F.broadcast(cells.select("cell", "parts")), "cell").select("cell", part, F.struct("id", "embedding", *columns).alias("row"))
    return rows.groupBy("cell", "part").agg(F.collect_list("row").alias("rows"))


def _rings(placed: DataFrame) -> DataFrame:
    """How many vectors each pivot's ring has in each range of ids, and between which angles."""
    return placed.groupBy(F.col("cell").alias("ring")).agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))


def _joined_rings(rings: dict[str, np.ndarray], least: int) -> np.ndarray:
    """The cell of each ring: rings of neighbouring numbers are one until they have ``least`` vectors in all ranges of ids. Short vectors stay apart."""
    around = rings["ring"] // SLABS
    order = np.argsort(around, kind="stable")
    group, number, n, last = np.zeros(len(around), np.int64), 0, 0, None
    for i in order.tolist():
        new = around[i] != last
        if last is not None and new and (n >= least or last < 0 <= around[i]):
            number, n = number + 1, 0
        group[i], last, n = number, around[i], n + rings["n"][i]
    return group * SLABS + rings["ring"] % SLABS


def _cells(placed: DataFrame, block: int) -> DataFrame:
    return placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))


def _wanted(asked: DataFrame, pivots, cells, earlier_only: bool) -> DataFrame:
    """Of blocks of queries (cell, rows of id, embedding and bound) those rows, with each cell of the gallery, that a ring of the cell can better."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cells.value
        pivot, order = known["ring"] // SLABS // RINGS, np.argsort(known["cell"], kind="stable")
        rings_of = np.split(order, np.flatnonzero(np.diff(known["cell"][order])) + 1) if len(order) else []
        for batch in batches:
            for own, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = rows.values
                data, length = _unit(values.field("embedding").flatten(), len(values))
                bound = values.field("bound").to_numpy(zero_copy_only=False)
                to_pivot = _angles(data, pivots.value) if len(pivots.value) else np.zeros((len(values), 1))
                bare = pa.StructArray.from_arrays([values.field(f.name) for f in _ROWS.value_type], fields=list(_ROWS.value_type))
                for rings in rings_of:
                    cell = int(known["cell"][rings[0]])
                    if earlier_only and cell % SLABS > own % SLABS:
                        continue
                    needs = length <= SHORT
                    for c in rings.tolist():
                        if pivot[c] < 0:
                            needs = np.ones(len(values), bool)
                        if needs.all():
                            break
                        t = to_pivot[:, pivot[c]]
                        best = np.cos(np.maximum(0.0, np.maximum(t - known["high"][c], known["low"][c] - t)))
                        # lengths after division are a little below one, which lifts negative similarities
                        needs = needs | (np.where(best > 0, best, best * 0.998) + SLACK >= bound)
                    if needs.any():
                        picked = bare.filter(pa.array(needs))
                        row = pa.ListArray.from_arrays(pa.array([0, len(picked)], pa.int32()), picked)
                        seen = cell == own or (earlier_only and own % SLABS > 0 and cell == own - 1)  # their first part
                        yield pa.RecordBatch.from_arrays([row, pa.array([cell]), pa.array([int(seen)], pa.int32())], names=["queries", "cell", "first"])

    return asked.select("cell", "rows").mapInArrow(run, _WANTED_DDL)


class Search:
    """The steps of a search by bounds, each of which can be looked at."""

    def __init__(self, queries: DataFrame, gallery: DataFrame, k: int, least: float, earlier_only: bool, block: int, size: int):
        sc = gallery.sparkSession.sparkContext
        ship_package(gallery.sparkSession)
        self.k, self.least, self.earlier_only = k, least, earlier_only
        most = max(MOST_CELLS, FEW_COPIES // max(1, size), -(-size // LARGEST))
        block = max(block, -(-size // most))
        cuts = []
        if earlier_only:
            cuts = sorted(set(gallery.agg(F.percentile_approx("id", [x / SLABS for x in range(1, SLABS)])).first()[0] or []))
        self.pivots = sc.broadcast(pick_pivots(gallery, min(MOST_PIVOTS, 2 * -(-size // block))))
        placed = written(_placed(gallery, self.pivots, cuts), "placed-vectors")
        rings, none = _rings(placed), F.lit(None).cast("double")
        if queries is not gallery:  # rings that only queries are in are in reach of nothing
            asked = written(_placed(queries, self.pivots, cuts), "placed-vectors")
            rings = rings.unionByName(_rings(asked).select("ring", F.lit(0).alias("n"), none.alias("low"), none.alias("high")))
        found = rings.groupBy("ring").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("ring").toArrow()
        known = {c: found.column(c).to_numpy() for c in found.column_names}
        known["cell"] = _joined_rings(known, max(block, size * (len(cuts) + 1) // most))
        names = gallery.sparkSession.createDataFrame(list(zip(known["ring"].tolist(), known["cell"].tolist())), "ring long, joined long")
        named = lambda df: df.withColumnRenamed("cell", "ring").join(F.broadcast(names), "ring").select("id", "embedding", F.col("joined").alias("cell"), "angle")
        self.gallery = named(placed)
        self.queries = self.gallery if queries is gallery else named(asked)
        self.cells = written(_cells(self.gallery, block), "cells")
        self.block = block
        self.blocks = _cell_blocks(self.gallery, self.cells, [])
        self.known = sc.broadcast(known)
        self.own_cells = _cells(self.queries, block)

    def best(self, pairs: DataFrame) -> DataFrame:
        return over_blocks(pairs, _best_of(self.k, self.least, self.earlier_only), _FOUND_DDL, FOUND)

    def seeds(self) -> DataFrame:
        """The best of one block of each query's own cell and, where lower ids count, of the same ring's in the range of ids before."""
        own = _cell_blocks(self.queries, self.own_cells, []).select("cell", F.col("rows").alias("queries"))
        if self.earlier_only:
            both = F.when(F.pmod("cell", F.lit(SLABS)) > 0, F.array("cell", F.col("cell") - 1)).otherwise(F.array("cell"))
            own = own.select(F.explode(both).alias("cell"), "queries")
        first = self.blocks.where("part = 0").select("cell", F.col("rows").alias("gallery"))
        return self.best(own.join(first, "cell"))

    def pairs(self, seeds: DataFrame) -> DataFrame:
        """queries, cell and part for each block of the gallery that queries still have to meet."""
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "gallery_id")
        bound = seeds.withColumn("n", F.row_number().over(w)).where(F.col("n") == self.k).select(F.col("query_id").alias("id"), F.col("similarity").alias("s"))
        asked = self.queries.join(bound, "id", "left").withColumn("bound", F.greatest(F.lit(float(self.least)), F.coalesce("s", F.lit(-2.0))))
        asked = _cell_blocks(asked, self.own_cells, ["bound"])
        wanted = _wanted(asked, self.pivots, self.known, self.earlier_only).join(F.broadcast(self.cells.select("cell", "parts")), "cell")
        wanted = wanted.where("first < parts")
        return wanted.select("queries", "cell", F.explode(F.sequence("first", F.col("parts") - 1)).alias("part"))

    def found(self) -> DataFrame:
        seeds = written(self.seeds(), "seeds")
        gallery = self.blocks.withColumnRenamed("rows", "gallery")
        return seeds.unionByName(self.best(self.pairs(seeds).join(gallery, ["cell", "part"])))


def _best_of(k: int, least: float, earlier_only: bool) -> Callable:
    def compare(s: np.ndarray, q: dict, g: dict) -> list:
        if not s.size:
            return [[], [], []]
        if not earlier_only:
            s[q["id"][:, None] == g["id"][None, :]] = -np.inf
        elif g["id"].max() >= q["id"].min():
            s[q["id"][:, None] <= g["id"][None, :]] = -np.inf
        # what can be one of the best once it is rounded; no more is ordered
        low = np.maximum(least, q["bound"]) if "bound" in q else np.full(len(s), float(least))
        if k < s.shape[1]:
            low = np.maximum(low, s.max(1) if k == 1 else np.partition(s, -k, axis=1)[:, -k])
        i, j = np.nonzero((s >= (low - 2 * 10.0**-DIGITS)[:, None]) & (s > -np.inf))
        found, ids = np.round(s[i, j], DIGITS), g["id"][j]
        order = np.lexsort((ids, -found, i))
        order = order[found[order] >= least]
        i, found, ids = i[order], found[order], ids[order]
        first = np.searchsorted(i, i, "left")
        kept = np.arange(len(i)) - first < k
        return [q["id"][i[kept]], ids[kept], found[kept]]

    return compare


def _is_zero(column: str) -> Column:
    return F.forall(column, lambda x: x == 0)


def top_k(queries: DataFrame, gallery: DataFrame, k: int = 5, least: float = -2.0, earlier_only: bool = False, block: int = BLOCK) -> DataFrame:
    """The ``k`` most similar of ``gallery`` (id, embedding) for each of ``queries``, itself excluded: query_id, rank, gallery_id, similarity.

    Each pair of blocks hands on ``k`` for each query at most. With
    ``earlier_only``, only lower ids count. A query of zeros is as similar to
    all, so its best are the lowest ids, of which no more than k + 1 are looked at.
    """
    nq, ng = queries.count(), gallery.count()
    if -(-nq // block) * -(-ng // block) <= FEW_PAIRS:
        near = over_blocks(block_pairs(queries, gallery, [], block), _best_of(k, least, earlier_only), _FOUND_DDL, FOUND)
    else:
        lowest = [r[0] for r in gallery.select(F.col("id").cast("long")).orderBy("id").limit(k + 1).collect()] if least <= 0 else []
        same = queries is gallery
        zero = queries.where(_is_zero("embedding")).select(F.col("id").cast("long").alias("query_id"), F.explode(F.array(*map(F.lit, lowest)).cast("array<long>")).alias("gallery_id"))
        zero = zero.where(F.col("gallery_id") < F.col("query_id") if earlier_only else F.col("gallery_id") != F.col("query_id"))
        asked = queries.where(~_is_zero("embedding"))
        with scratch() as kept:
            search = Search(gallery if same else asked, gallery, k, least, earlier_only, block, ng)
            if same:
                search.queries = search.queries.where(~_is_zero("embedding"))
                search.own_cells = _cells(search.queries, search.block)
            near = written(search.found().unionByName(zero.withColumn("similarity", F.lit(0.0))), "nearest")
            kept.append(near)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "gallery_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
