"""SimHash near-duplicates, with pigeonring filtering of the candidates.

A fingerprint's 64 bits form a ring of three segments. If two fingerprints
differ in at most two bits there is a segment from which every chain of l
consecutive segments differs in at most l * 2 / 3 bits: none in the first, one
in the first two, two in all three. Fingerprints are grouped by each of their
segments (the chain of one), pairs that fail the chain of two are dropped, and
only the rest gets the full Hamming check. Pairs are compared as arrays within
a group; a group hands on at most one link less than it has members.

A group of over ``GROUP`` members is cut by the same rule: its members are equal
in some bits, so their differences lie in the others, which form a ring of
three segments again. That goes on until groups are small: at the fifth level a
group's members differ in ten bits or fewer, so there are 1024 of them at most.
Every link comes from a chain of one and passes the chain of two.

Equal fingerprints are one node from the start.

Fingerprints tell texts apart that differ in a few shingles: two texts that share
0.8 of their shingles differ in some ten bits. :func:`first_of_each`, which the
pipeline calls, therefore lays rings over the sets themselves, with an exact check.

Defined cases: null and empty texts, and texts of blanks, have fingerprint
zero, which links like any other; texts of one or two words have one shingle of
all their words; a null doc_id never names a component unless all ids in it are
null; repeated rows are repeated; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, ship_package, written
from . import shingles
from .arrow_text import ascii_lower, record_batch, slices, texts
from .components import component_ids, connected_components, with_frequent

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Members of a group that are compared with each other.
GROUP = 1024
#: Pairs that are compared as one array.
TOGETHER = 1 << 20
#: Most tasks that a large group's members are spread over while it is cut.
SALTS = 32
_ALL = (1 << 64) - 1

PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = ascii_lower(text).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)], "<u8")
    if n <= 1 << 16:
        count = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        count = sum(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for part in np.array_split(hashes, -(-n // (1 << 16))))
    return int(np.packbits(2 * count > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp for each row of ``docs``."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield record_batch(PRINTS, [part.column(0), [fingerprint(x) for x in texts(part, "text")]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def ring(mask: int) -> list[tuple[int, int]]:
    """Of fingerprints equal in the bits of ``mask``, the segments of the others: each with what is equal then, and the segment behind it."""
    rest = [1 << k for k in range(64) if not mask >> k & 1]
    cuts = [len(rest) * i // 3 for i in range(4)]
    segments = [sum(rest[i:j]) for i, j in zip(cuts, cuts[1:])]
    return [(mask | segments[i], segments[(i + 1) % 3]) for i in range(3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _listed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """Each row of ``nodes`` (fp, mask) under the three segments of its ring: fp, mask, after and the part of fp that its group shares."""
    rings = F.create_map(*[
        x for m in masks for x in (F.lit(_signed(m)), F.array(*[
            F.struct(F.lit(_signed(a)).alias("mask"), F.lit(_signed(b)).alias("after")) for a, b in ring(m)
        ]))
    ])
    rows = nodes.select("fp", F.explode(rings[F.col("mask")]).alias("r")).select("fp", "r.*")
    return rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))


def chain_links(members: np.ndarray, after: int, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links that join those members of a group whose chains of two, the second one being the bits of ``after``, keep within budget."""
    members = np.sort(members)
    whole = members.view(np.uint64)
    second = whole & np.uint64(after & _ALL)
    budget = 2 * most // 3
    n, root, out = len(members), list(range(len(members))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, TOGETHER // max(n, 1))
    for i in range(0, n, step):
        near = np.bitwise_count(second[i : i + step, None] ^ second[None, :]) <= budget
        a, b = np.nonzero(near)
        a, b = a[b > a + i] + i, b[b > a + i]
        close = np.bitwise_count(whole[a] ^ whole[b]) <= most
        for x, y in zip(a[close].tolist(), b[close].tolist()):
            p, q = top(x), top(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(members[x]), int(members[y])))
    return out


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``nodes`` (fp, distinct) at most two bits apart."""
    ship_package(nodes.sparkSession)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for after, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                found += chain_links(np.asarray(members.values, np.int64), after)
            yield record_batch(LINKS, [[x for x, _ in found], [x for _, x in found]])

    masks, rows, out = [0], nodes.select("fp", F.lit(0).cast("long").alias("mask")), None
    while True:
        listed = _listed(rows, masks)
        masks = sorted({m for mask in masks for m, _ in ring(mask)})
        # a ring of so few bits can't have more members than there are values of them
        last = 1 << (64 - min(m.bit_count() for m in masks)) <= max(group, 1 << 9)
        small = listed
        if not last:
            large = written(listed.groupBy("mask", "after", "part").agg(F.count("*").alias("n")).where(F.col("n") > group).drop("n"), "large-groups")
            salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            marked = listed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
            marked = marked.join(salted.withColumn("is_large", F.lit(True)), ["mask", "after", "part", "salt"], "left")
            small = marked.where("is_large is null")
        groups = small.groupBy("mask", "after", "part").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
        found = groups.select("after", "members").mapInArrow(pair, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if last or large.isEmpty():
            return out
        rows = written(marked.where("is_large").select("fp", "mask").distinct(), "large-group-members")


def near_duplicates(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links, its own included) for each row of ``docs``."""
    with scratch() as kept:
        prints = written(fingerprints(docs), "fingerprints")
        nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-nodes")
        roots = connected_components(links(nodes.select("fp"), group)).withColumnRenamed("node", "fp")
        rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        named = written(component_ids(rooted), "components")
        kept += [prints, named]
    return with_frequent(prints, named, "fp", "n", prints.count()).select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, shingle: int = shingles.SHINGLE, likeness: float = shingles.LIKENESS) -> DataFrame:
    """One row of ``docs`` for each group of texts that share ``likeness`` of their shingles, with all its columns."""
    return shingles.first_of_each(docs, shingle, likeness)
