"""Connected components of a link table, by alternating large and small stars.

Each round is two group-bys with map-side combination and two joins. A node with
very many links is neither gathered into one list nor into one task: its links
are dealt to ``SALTS`` parts, each of which meets a copy of the node's least
neighbour, and where a part is still large Spark's skew join cuts it further.
The links of a round are written to the shared folder, which ends the lineage;
they are deleted when the next ones are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written

#: Rounds after which the input is taken to be broken; each at least halves long paths.
MOST_ROUNDS = 60
#: Parts that a node's links are dealt to.
SALTS = 8
#: Keys that may be sent to all tasks: those with a share of 1 / FREQUENT or more of the rows, of which there are no more than FREQUENT.
FREQUENT = 2048


def with_frequent(rows: DataFrame, named: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``named`` (one row for each ``key``) without a task that gets all rows of one key.

    ``named`` says in ``count`` how many of the ``total`` rows have its key. Keys
    that hold 1 / FREQUENT of the rows or more are FREQUENT at most, whatever
    the data, and are broadcast; of any other key few rows are shuffled.
    """
    is_often = F.col(count) * FREQUENT >= F.lit(total)
    often = named.where(is_often).drop(count).withColumn("_often", F.lit(True))
    marked = rows.join(F.broadcast(often), key, "left")  # one broadcast for both parts
    met = marked.where("_often").drop("_often")
    rest = marked.where("_often is null").select(*rows.columns)
    return met.unionByName(rest.join(named.where(~is_often).drop(count), key))


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` (a, b) with m, the least of node a."""
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(copies, ["a", "salt"])


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    near = _both(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(near.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """node and root (the least node reachable) for each node of ``links`` (a, b: long).

    Links of a node to itself are dropped; nodes without other links are not
    returned. Null ends are dropped. Without links the result is empty.
    """
    size = (F.count("*"), F.bit_xor(F.xxhash64("a", "b")))
    current = written(links.where("a <> b").select("a", "b").distinct(), "links")
    before = tuple(current.agg(*size).first())
    for _ in range(rounds):
        after = written(_small_star(_large_star(current)).distinct(), "links")
        now = tuple(after.agg(*size).first())
        dropped(current)
        current = after
        if now == before:
            ends = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return ends.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def component_ids(rooted: DataFrame) -> DataFrame:
    """``rooted`` (root, least, ...) with component_id, the least ``least`` of each root; a root may have most of the rows."""
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    return with_frequent(rooted, least, "root", "_n", rooted.count()).drop("root", "least")
