"""Document fingerprints by locally consistent parsing.

Level by level a text's symbols become phrases, and phrases the next level's
symbols. Runs of one symbol are joined first. Deterministic coin tossing then
relabels each symbol by the lowest bit in which it differs from the one before
and that bit's value, again and again, until six labels are left; phrases start
where a label exceeds both its neighbours. A label depends on a few symbols to
its left and right only, so equal substrings are cut alike except near their
ends, wherever they stand. A phrase's name is a hash of its symbols.

A fingerprint is a MinHash of the names: 64 slots, two hexadecimal digits each.
Names of the first level, of the second, and of all higher ones have slots of
their own, so that the many short phrases don't outweigh the long ones, and a
text's length has no say in what is compared. The likeness of two is the share
of equal slots, less those equal by chance, on the levels that both have.

Defined cases: null counts as the empty text, whose fingerprint has ``ff`` in
every slot; likeness of two empty texts is 1; rows are ordered by doc_id, those
with the same one by a hash of their text, null doc_ids last; a table of one
row has itself as its next; extra columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, written
from .arrow_text import mix64, record_batch, slices, texts

SLOTS = 64
#: First and last slot, and lowest and highest level, of each group; the last one has all levels up to a text's only symbol.
GROUPS = ((0, 6, 1, 1), (6, 20, 2, 2), (20, 64, 3, None))
#: Bytes of text parsed as one array.
TOGETHER = 1 << 20
#: Ranges of ids for each partition of the shuffle.
RANGES = 4
#: Text for each partition of the shuffle, at most about.
PARTITION_BYTES = 256 << 20
LAST = (1 << 63) - 1

_K = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = (np.random.default_rng(7).integers(0, 1 << 63, (2, SLOTS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _toss(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Coin tossing: twice the lowest bit's place in which x and before differ, plus x's bit there."""
    low = (x ^ before) & (~(x ^ before) + x.dtype.type(1))
    place = np.bitwise_count(low - x.dtype.type(1))
    return (place << np.uint8(1)) | ((x & low) != 0)


def _phrases(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's symbols and their texts."""
    # runs
    new = np.concatenate(([True], (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])))
    start = np.flatnonzero(new)
    run = np.diff(np.append(start, len(symbols))).astype(np.uint64)
    x, text = mix64(symbols[start] + run * _K), owner[start]
    first = np.concatenate(([True], text[1:] != text[:-1]))
    # labels; a text's first symbol has a fixed one before it
    label, zero = x, x.dtype.type(0)
    for _ in range(5):
        before = np.concatenate(([zero], label[:-1]))
        before[first] = ~label[first]  # differs in bit 0
        label = _toss(label, before)
        zero = label.dtype.type(0)
    higher = np.zeros(len(x), bool)
    higher[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    # a phrase of one symbol at a text's start joins the next
    cut = np.flatnonzero(higher | first)
    length = np.diff(np.append(cut, len(x)))
    place = np.arange(len(x)) - np.repeat(cut, length)
    power = np.cumprod(np.full(int(place.max()) + 1, _K))
    return mix64(np.add.reduceat(x * power[place], cut)), text[cut]


def sketch(rows: list[bytes]) -> np.ndarray:
    """The slots of each text, [texts, SLOTS] bytes; 255 in all slots of a group of levels that the text hasn't got."""
    out = np.full((len(rows), SLOTS), 255, np.uint8)
    symbols = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in rows])
    levels = []
    while len(symbols):  # each level is shorter, until one symbol is left
        symbols, owner = _phrases(symbols, owner)
        levels.append((symbols + np.uint64(len(levels) + 1), owner))
        more = (np.bincount(owner, minlength=len(rows)) > 1)[owner]
        symbols, owner = symbols[more], owner[more]
    for first, behind, lowest, highest in GROUPS:
        if not (own := levels[lowest - 1 : highest]):
            continue
        name, text = (np.concatenate(x) for x in zip(*own))
        order = np.argsort(text, kind="stable")
        name, text = mix64(name[order]), text[order]
        edge = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        for k in range(first, behind):
            least = np.minimum.reduceat((name * _FACTORS[0, k] + _FACTORS[1, k]) >> np.uint64(20), edge)
            out[text[edge], k] = (mix64(least) >> np.uint64(56)).astype(np.uint8)
    return out


def _sketches(rows: list[str]) -> np.ndarray:
    data = [x.encode() for x in rows]
    parts, start, held = [], 0, 0
    for i, x in enumerate([*data, None]):
        if x is None or (held and held + len(x) > TOGETHER):
            parts.append(sketch(data[start:i]))
            start, held = i, 0
        held += len(x or b"")
    return np.concatenate(parts)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of slots, from 0 to 1."""
    same, counted, of_either = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a), bool)
    for first, behind, _, _ in GROUPS:
        x, y = a[:, first:behind], b[:, first:behind]
        has_x, has_y = (x != 255).any(1), (y != 255).any(1)
        same += (has_x & has_y) * (x == y).sum(1)
        counted += (has_x & has_y) * (behind - first)
        of_either |= has_x | has_y
    share = np.divide(same, counted, out=np.where(of_either, 0.0, 1.0), where=counted > 0)
    return np.clip((share - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``after``."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


PRINTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each row of ``docs``, without a shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                rows = [x or "" for x in part.column(1).to_pylist()]
                yield record_batch(PRINTS, [part.column(0), [len(x) for x in rows], [x.tobytes().hex() for x in _sketches(rows)]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


PACKED = pa.schema([("range", pa.int32()), ("key", pa.int64()), ("tie", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary()), ("size", pa.int64())])
COMPARED = pa.schema([
    ("part", pa.string()), ("range", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("packed", pa.binary()), ("size", pa.int64()),
])
_COMPARED_DDL = "part string, range int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, packed binary, size long"


def _pairs(rows: list[tuple[int, int | None, str, str]]) -> pa.RecordBatch:
    """Rows of COMPARED for (range, doc_id, text, next text)."""
    own, changed = [r[2] for r in rows], [edited(r[2], r[3]) for r in rows]
    a, b, c = _sketches(own), _sketches(changed), _sketches([r[3] for r in rows[-1:]])
    follow = [rows[i + 1][2] is rows[i][3] for i in range(len(rows) - 1)]
    after = np.concatenate((a[1:], c))
    for i, same in enumerate(follow):
        if not same:
            after[i] = _sketches([rows[i][3]])[0]
    return record_batch(COMPARED, [
        ["row"] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [len(x) for x in own],
        [hashlib.sha256(x.encode()).hexdigest() for x in changed],
        [x.tobytes().hex() for x in a], [x.tobytes().hex() for x in b], likeness(a, b), likeness(a, after), [None] * len(rows), [None] * len(rows),
    ])


def _end(part: str, number: int, doc_id: int | None, text: str) -> list:
    data = text.encode()
    return [part, number, doc_id, None, None, None, None, None, None, pa.compress(data, codec="zstd", asbytes=True), len(data)]


def _text(packed: bytes, size: int) -> str:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True).decode() if size else ""


def compare_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows that follow each other within a range of ids; each range's first and last row for what spans two."""
    last: tuple[int, int | None, str] | None = None
    ends: list[list] = []
    for batch in batches:
        pairs, held = [], 0
        for number, doc_id, packed, size in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
            text = _text(packed, size)
            if last is not None and last[0] == number:
                pairs.append((number, last[1], last[2], text))
                held += size
            else:
                if last is not None:
                    ends.append(_end("last", *last))
                ends.append(_end("first", number, doc_id, text))
            last = (number, doc_id, text)
            if held > TOGETHER:
                yield _pairs(pairs)
                pairs, held = [], 0
        if pairs:
            yield _pairs(pairs)
        if ends:
            yield record_batch(COMPARED, list(zip(*ends)))
            ends = []
    if last is not None:
        yield record_batch(COMPARED, list(zip(_end("last", *last))))


def compare_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that span two ranges: range, doc_id, packed, size, and packed and size of the next."""
    for batch in batches:
        for number, doc_id, packed, size, after, after_size in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            yield _pairs([(number, doc_id, _text(packed, size), _text(after, after_size))])


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document in ascending doc_id.

    Ids are cut into ranges at their quantiles, and texts, compressed, are
    shuffled once by range. What spans two ranges is one row for each range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(partitions, -(-size // PARTITION_BYTES))
    n = RANGES * partitions
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    bounds = np.unique(np.array(found, np.int64))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, ids = texts(part, "text"), part.column(0).to_pylist()
                key = np.array([LAST if i is None else i for i in ids], np.int64)
                tie = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True) for x in data]
                yield record_batch(PACKED, [
                    np.searchsorted(bounds, key, "left").astype(np.int32), key, tie, ids, [pa.compress(x, codec="zstd", asbytes=True) for x in data],
                    [len(x) for x in data]
                ])

    packed = rows.mapInArrow(pack, "range int, key long, tie long, doc_id long, packed binary, size long")
    ordered = packed.repartition(partitions, "range").sortWithinPartitions("range", "key", "tie")
    compared = written(ordered.mapInArrow(compare_in_order, _COMPARED_DDL), "compared")
    firsts = compared.where("part = 'first'").select(F.col("range").alias("next"), F.col("packed").alias("after"), F.col("size").alias("after_size"))
    ranges = firsts.select(F.col("next").alias("range"))  # one row for each range
    following = ranges.select("range", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy())).alias("next"))
    lasts = compared.where("part = 'last'").select("range", "doc_id", "packed", "size")
    spanning = lasts.join(following, "range").join(firsts, "next").select("range", "doc_id", "packed", "size", "after", "after_size")
    done = compared.where("part = 'row'").unionByName(spanning.mapInArrow(compare_ends, _COMPARED_DDL))
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
