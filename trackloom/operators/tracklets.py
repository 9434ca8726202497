"""Tracklets: what is gathered about a track before and after it has an identity.

Input rows are observations: camera_name, track_id, frame_idx, embedding
(array, all zero where there was no usable crop) and ``is_edge``. A column
``usable``, where there is one, stands for the test of the embedding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..session import ship_package
from . import presence

STABLE_FRAMES, ANY_FRAMES = 15, 45
ANCHORED, RESERVOIR = 10, 20


def with_maturity(observations: DataFrame, stable: int = STABLE_FRAMES, most: int = ANY_FRAMES) -> DataFrame:
    """Adds running counts over the stretch of presence and ``mature``: enough usable whole-body views, or enough views at all."""
    df = observations if "seg" in observations.columns else presence.with_segments(observations)
    w = presence.in_segment().rowsBetween(Window.unboundedPreceding, 0)
    df = df if "usable" in df.columns else df.withColumn("usable", vec.is_nonzero(F.col("embedding")))
    df = df.withColumns({"n_usable": F.count_if("usable").over(w), "n_stable": F.count_if(F.col("usable") & ~F.col("is_edge")).over(w)})
    return df.withColumn("mature", (F.col("n_stable") >= stable) | (F.col("n_usable") >= most))


def maturity(observations: DataFrame, stable: int = STABLE_FRAMES, most: int = ANY_FRAMES) -> DataFrame:
    """The first mature frame of each track of a camera, with the counts there. A track keeps its identity when it comes back, so once is enough."""
    found = with_maturity(observations, stable, most).where("mature")
    first = F.struct("frame_idx", "n_stable", "n_usable", "seg")
    return found.groupBy(*presence.TRACK).agg(F.min(first).alias("m")).select(
        *presence.TRACK, F.col("m.frame_idx").alias("mature_frame"), F.col("m.n_stable").alias("n_stable"), F.col("m.n_usable").alias("n_usable"),
        F.col("m.seg").alias("seg")
    )


def queries(observations: DataFrame, stable: int = STABLE_FRAMES, most: int = ANY_FRAMES) -> DataFrame:
    """Each mature track's query vector: the mean of its usable embeddings up to maturity, at unit length, and every so many-th of them as ``views``.

    A track has ``most`` embeddings there at most, so they are gathered as an array.
    """
    df = presence.with_segments(observations.withColumn("usable", vec.is_nonzero(F.col("embedding"))))
    ready = maturity(df.drop("embedding"), stable, most).drop("n_stable", "n_usable")
    rows = df.join(ready, [*presence.TRACK, "seg"]).where((F.col("frame_idx") <= F.col("mature_frame")) & F.col("usable"))
    gathered = rows.groupBy(*presence.TRACK, "mature_frame").agg(F.array_sort(F.collect_list(F.struct("frame_idx", vec.doubles("embedding").alias("v")))).alias("rows"))
    vectors = F.transform("rows", lambda r: r["v"])
    return gathered.select(
        *presence.TRACK, "mature_frame", F.size("rows").alias("n_views"), vec.normalize(vec.mean_of(vectors)).alias("embedding"),
        vec.strided(vectors).alias("views")
    )


#: Parts of an identity that a reservoir is drawn from first.
PARTS = 16


def departure_views(observations: DataFrame, keep: int = 5) -> DataFrame:
    """The last usable embeddings of each track that left, newest last; a later departure replaces an earlier one's."""
    df = presence.with_segments(presence.with_nonempty_clock(observations), "tick")
    w = Window.partitionBy(*presence.TRACK, "seg").orderBy(F.desc("tick"))
    ended = df.groupBy(*presence.TRACK, "seg").agg(F.max("tick").alias("last_tick"))
    final = df.groupBy("camera_name").agg(F.max("tick").alias("final"))
    left = ended.join(final, "camera_name").where("last_tick < final").drop("final")
    usable = df.where(vec.is_nonzero(F.col("embedding"))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    rows = usable.join(left, [*presence.TRACK, "seg"]).groupBy(*presence.TRACK, "seg", "last_tick").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "vec_id"))).alias("rows"))
    newest = rows.groupBy(*presence.TRACK).agg(F.max_by(F.struct("last_tick", "rows"), "last_tick").alias("r"))
    return newest.select(*presence.TRACK, F.col("r.last_tick").alias("last_tick"), F.transform("r.rows", lambda x: x["vec_id"]).alias("views"))


#: Rows that a task looks at together, and that it holds at most before it hands them on.
TOGETHER, HELD = 1 << 16, 1 << 20


def _first_of_each(table: pa.Table, code: np.ndarray, keys: list[str], most: int) -> np.ndarray:
    """Row numbers of the ``most`` least rows, by ``keys``, of each code."""
    columns = {"code": pa.array(code), **{k: table.column(k) for k in keys}}
    order = pc.sort_indices(pa.table(columns), [(k, "ascending") for k in columns], null_placement="at_start").to_numpy()
    ranked = code[order]
    begins = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < most]


def kept_in_task(rows: DataFrame, identity: str, order: str, anchored: int, size: int) -> DataFrame:
    """Of what a task reads, the rows of each identity that can be anchors or drawn: ``anchored`` by order, and that and ``size`` more by draw."""
    ship_package(rows.sparkSession)

    def pruned(table: pa.Table) -> pa.Table:
        code = table.column(identity).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        few = np.union1d(_first_of_each(table, code, [order], anchored), _first_of_each(table, code, ["draw", order], anchored + size))
        return table.take(pa.array(few))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        fresh = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            fresh += batch.num_rows
            if fresh >= TOGETHER:
                held, fresh = [pruned(pa.concat_tables(held))], 0
                if held[0].num_rows > HELD:  # very many identities: what is known of them goes on
                    yield from held.pop().to_batches()
        if held:
            yield from pruned(pa.concat_tables(held)).to_batches()

    return rows.mapInArrow(run, rows.schema)


def reservoir(observations: DataFrame, order: str, identity: str, anchored: int = ANCHORED, size: int = RESERVOIR, seed: int = 7) -> DataFrame:
    """The first ``anchored`` rows of each identity and a uniform sample of the rest.

    Instead of a random replacement, which depends on the order of arrival, the
    sample is the ``size`` rows of least hash, so it is the same on every run.
    Samples of least hashes merge: each task keeps the few rows of an identity
    that can be chosen, and only those are shuffled and ranked.
    """
    # an identity may have most of the rows: its parts first keep the few that can be chosen
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(identity).cast("string"), F.col(order).cast("string")).cast("binary"))
    df = kept_in_task(observations.withColumn("draw", draw), identity, order, anchored, size).withColumn("part", F.pmod(F.xxhash64(order), F.lit(PARTS)))
    part, whole = Window.partitionBy(identity, "part"), Window.partitionBy(identity)
    df = df.withColumns({"n": F.row_number().over(part.orderBy(order)), "k": F.row_number().over(part.orderBy("draw", order))})
    few = df.where((F.col("n") <= anchored) | (F.col("k") <= anchored + size))
    few = few.withColumn("anchor", F.row_number().over(whole.orderBy(order)) <= anchored)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy(identity, "anchor").orderBy("draw", order)))
    return few.where(F.col("anchor") | (F.col("k") <= size)).select(*observations.columns, "anchor")
