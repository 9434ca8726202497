"""Substring deduplication over words, by fixed-block anchors.

1. Index: the blocks of ten words that start at every tenth word of a document
   do not overlap, and any repeat of twenty words holds a whole block of its
   first occurrence. Probe: every rolling window of ten words is looked up in
   that index. Blocks are rolling windows too, so one entry serves both, and
   entries meet in buckets by a hash of their words.
2. Extend: a hit grows over every window of twenty words that holds it. Equal
   windows meet by a name, the earliest stays, and the other ones, where they
   overlap or touch, make up the maximal repeats, which are removed.

Names. Words of up to sixteen bytes have 128-bit names of their own, longer ones
their BLAKE2b digest; a run's name is the mixed names of its words. Step 1 keeps
32 bits of it, as a false hit only costs a look at its windows in step 2; there
all 128 bits decide. Among 10**13 windows two different ones share a name with
a probability below 10**-12.

Homes. Texts are shuffled once, compressed, to homes of about ``BUCKET_BYTES``,
in the order of a name of each row. A place is a home and the number of a word
in it, so entries are a name and a small difference each, and what is found
goes back as differences too. A home first keeps one entry for all its equal
windows: a passage that very many documents share gives an entry a home instead
of one a document. There are as many homes and buckets as the size of the texts
asks for, and each is about a partition, so no task grows with the input.

Defined cases: a null text has no words and keeps the empty text; a document of
fewer than twenty words is kept whole; windows of rows with the same doc_id
are in order of their places, then of a hash of the row; rows repeated whole
count as one and don't remove each other, but are spread over homes; a null
doc_id sorts behind all others, and rows without one are told apart by their
words; any 64-bit ids are fine; extra columns are ignored; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .arrow_text import mix64, record_batch, run_names, slices, texts, word_names

#: Words of a window whose repeats are removed, and of an anchor block: 2 * BLOCK - 1 may not exceed WINDOW.
WINDOW, BLOCK = 20, 10
#: Bytes of text for each home and bucket, about.
BUCKET_BYTES = 8 << 20
#: Rows of one task that are repeated whole and stay together; more of them are spread over homes.
TOGETHER = 64
LAST = (1 << 63) - 1

PACKED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("packed", pa.binary()), ("size", pa.int64()), ("words", pa.int64()), ("home", pa.int32())])
_PACKED_DDL = "doc_id long, row long, packed binary, size long, words long, home int"
#: Step 1: names and places of a home's entries in a bucket. With ``known`` the places are hits or repeats already.
ANCHORS = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("known", pa.bool_()), ("names", pa.binary()), ("at", pa.binary()), ("anchor", pa.binary())])
_ANCHORS_DDL = "bucket int, home int, known boolean, names binary, at binary, anchor binary"
#: Step 2: the same for windows, with what gives the rows' order.
WINDOWS = pa.schema([
    ("bucket", pa.int32()), ("home", pa.int32()), ("known", pa.bool_()), ("names", pa.binary()), ("at", pa.binary()),
    ("counts", pa.binary()), ("begins", pa.binary()), ("ids", pa.binary()), ("rows", pa.binary()),
])
_WINDOWS_DDL = "bucket int, home int, known boolean, names binary, at binary, counts binary, begins binary, ids binary, rows binary"
PLACES = pa.schema([("home", pa.int32()), ("at", pa.binary())])
_PLACES_DDL = "home int, at binary"
KEPT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string()),
])
_KEPT_DDL = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"


# arrays as bytes


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned whole numbers in as few bytes each as hold the largest, which come first."""
    most = int(x.max()) if len(x) else 0
    size = next(n for n in (1, 2, 4, 8) if most < 1 << (8 * n))
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _pack_places(at: np.ndarray) -> bytes:
    """Ascending numbers of zero or more as differences of a byte each; those of 255 or more stand behind, in full."""
    step = np.diff(at, prepend=0)
    small = np.minimum(step, 255).astype(np.uint8)
    return len(at).to_bytes(8, "little") + small.tobytes() + _narrow(step[small == 255])


def _places(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    step = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    step[step == 255] = _wide(data[8 + n :])
    return np.cumsum(step)


def _pack_ids(ids: np.ndarray) -> bytes:
    """Any 64-bit numbers, as what they exceed the least by; the sum wraps round, so no two are too far apart."""
    least = ids.min()
    return least.tobytes() + _narrow(ids.view(np.uint64) - least.view(np.uint64))


def _ids(data: bytes) -> np.ndarray:
    return (_wide(data[8:]).astype(np.uint64) + np.frombuffer(data[:8], np.uint64)).view(np.int64)


def _share(names: np.ndarray, n: int) -> np.ndarray:
    """A number below ``n`` from the high half of each name."""
    return (((names >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


# homes


class Home:
    """The rows of a home in the order of their names, and where each one's words begin."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by("row")
        self.row = self.table.column("row").to_numpy()
        self.ids = pc.fill_null(self.table.column("doc_id"), LAST).to_numpy()
        self.length = self.table.column("words").to_numpy()
        self.begin = np.cumsum(self.length) - self.length
        self.total = int(self.length.sum())

    def lines(self, k: np.ndarray | None = None) -> list[bytes]:
        """The words of all rows, or of the rows ``k``, joined by single spaces."""
        part = self.table.select(["packed", "size"])
        part = part if k is None else part.take(pa.array(k))
        rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
        return [pa.decompress(x, decompressed_size=n, codec="zstd", asbytes=True) if n else b"" for x, n in rows]

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of every run of ``n`` words."""
        many = np.maximum(self.length - n + 1, 0)
        row = np.repeat(np.arange(len(many)), many)
        return row, self.begin[row] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)

    def row_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin + self.length, place, "right")


def _found(table: pa.Table) -> np.ndarray:
    """The places that were sent to a home."""
    parts = [_places(x) for x in table.column("at").to_pylist()]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _table(schema: pa.Schema, rows: list[list]) -> pa.Table:
    return pa.Table.from_batches([record_batch(schema, list(zip(*rows)))] if rows else [], schema)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the places of its entries, which stay in order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
        yield int(bucket[order[i]]), order[i:j]


def _equal_runs(order: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Where a new name begins in ``order``, which sorts ``names``."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in names:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


# steps


def anchor_entries(table: pa.Table, buckets: int) -> pa.Table:
    """Step 1, where the texts are: an entry for each distinct rolling window of ten words of a home."""
    home, number = Home(table), table.column("home")[0].as_py()
    row, at = home.runs(BLOCK)
    if not len(at):
        return ANCHORS.empty_table()
    names = run_names(word_names(home.lines())[:, 0], BLOCK)[at]
    anchor = (at - home.begin[row]) % BLOCK == 0
    order = np.argsort(names)
    edges = _equal_runs(order, names)
    many = np.diff(edges, append=len(order))
    anchored, pick = np.logical_or.reduceat(anchor[order], edges), np.minimum.reduceat(order, edges)
    first = np.argsort(pick)  # in order of their places
    pick, anchored = pick[first], anchored[first]
    again = np.sort(order[np.repeat(many > 1, many)])
    names, place = names[pick], at[pick]
    low = (names & np.uint64(0xFFFFFFFF)).astype("<u4")
    rows = [[b, number, False, low[k].tobytes(), _pack_places(place[k]), np.packbits(anchored[k]).tobytes()] for b, k in _by_bucket(_share(names, buckets))]
    if len(again):  # equal windows of one home are hits already
        rows.append([number % buckets, number, True, b"", _pack_places(at[again]), b""])
    return _table(ANCHORS, rows)


def anchor_hits(table: pa.Table) -> pa.Table:
    """Step 1, in a bucket: the windows whose words an anchor block and another place share."""
    rows = table.to_pylist()
    out, rows = [[r["home"], r["at"]] for r in rows if r["known"]], [r for r in rows if not r["known"]]
    if rows:
        names = np.concatenate([np.frombuffer(r["names"], "<u4") for r in rows])
        sizes = [len(r["names"]) // 4 for r in rows]
        anchor = np.concatenate([np.unpackbits(np.frombuffer(r["anchor"], np.uint8), count=n) for r, n in zip(rows, sizes)]).astype(bool)
        order = np.argsort(names)
        edges = _equal_runs(order, names)
        many = np.diff(edges, append=len(order))
        hit = np.zeros(len(names), bool)
        hit[order] = np.repeat((many > 1) & np.logical_or.reduceat(anchor[order], edges), many)
        for r, own in zip(rows, np.split(hit, np.cumsum(sizes)[:-1])):
            if own.any():
                out.append([r["home"], _pack_places(_places(r["at"])[own])])
    return _table(PLACES, out)


def _later(names: np.ndarray, ids: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal names [n, 2] the earliest place, and all that are later than the earliest one."""
    order = np.argsort(names[:, 0])
    edges = _equal_runs(order, names[:, 0])
    many = np.diff(edges, append=len(order))
    alone = order[edges[many == 1]]
    order = order[np.repeat(many > 1, many)]  # only these need a closer look
    order = order[np.lexsort((row[order], at[order], ids[order], names[order, 1], names[order, 0]))]
    edges = _equal_runs(order, names[:, 0], names[:, 1])
    lead = np.repeat(order[edges], np.diff(edges, append=len(order)))
    return np.concatenate((alone, order[edges])), order[(row[order] != row[lead]) | (at[order] != at[lead])]


def window_entries(table: pa.Table, hits: pa.Table, buckets: int) -> pa.Table:
    """Step 2, where the texts are: hits extended to the windows of twenty words that hold them."""
    hit = _found(hits)
    if not len(hit):
        return WINDOWS.empty_table()
    home, number = Home(table), table.column("home")[0].as_py()
    row = home.row_of(hit)
    low, high = np.maximum(hit - (WINDOW - BLOCK), home.begin[row]), np.minimum(hit, home.begin[row] + home.length[row] - WINDOW) + 1
    ok = low < high
    near = np.bincount(low[ok], minlength=home.total + 1) - np.bincount(high[ok], minlength=home.total + 1)
    place = np.flatnonzero(np.cumsum(near) > 0)
    if not len(place):
        return WINDOWS.empty_table()
    row = home.row_of(place)
    used, own = np.unique(row, return_inverse=True)
    words = word_names(home.lines(used))
    begin = np.cumsum(home.length[used]) - home.length[used]
    at = place - home.begin[row]  # within the row
    names = np.stack([run_names(words[:, k], WINDOW)[begin[own] + at] for k in (0, 1)], 1)
    pick, later = _later(names, home.ids[row], at, home.row[row])
    pick = np.sort(pick)
    rows = []
    for b, k in _by_bucket(_share(names[pick, 0], buckets)):
        k = pick[k]
        turns = np.flatnonzero(np.diff(row[k], prepend=-1))
        r = row[k][turns]
        rows.append([
            b, number, False, names[k].tobytes(), _pack_places(place[k]), _narrow(np.diff(turns, append=len(k))), _narrow(home.begin[r]),
            _pack_ids(home.ids[r]), home.row[r].tobytes()
        ])
    if len(later):  # later than an equal window of the same home
        rows.append([number % buckets, number, True, b"", _pack_places(np.sort(place[later])), b"", b"", b"", b""])
    return _table(WINDOWS, rows)


def repeated_windows(table: pa.Table) -> pa.Table:
    """Step 2, in a bucket: the windows whose words also start at an earlier place."""
    rows = table.to_pylist()
    out, rows = [[r["home"], r["at"]] for r in rows if r["known"]], [r for r in rows if not r["known"]]
    if rows:
        places, counts = [_places(r["at"]) for r in rows], [_wide(r["counts"]) for r in rows]
        begin, ids, row = (
            np.concatenate([np.repeat(of(r[name]), n) for r, n in zip(rows, counts)])
            for name, of in (("begins", _wide), ("ids", _ids), ("rows", lambda x: np.frombuffer(x, np.int64)))
        )
        names = np.concatenate([np.frombuffer(r["names"], "<u8") for r in rows]).reshape(-1, 2)
        _, later = _later(names, ids, np.concatenate(places) - begin.astype(np.int64), row)
        repeat = np.zeros(len(names), bool)
        repeat[later] = True
        for r, at, own in zip(rows, places, np.split(repeat, np.cumsum([len(x) for x in places])[:-1])):
            if own.any():
                out.append([r["home"], _pack_places(at[own])])
    return _table(PLACES, out)


def remove_repeats(table: pa.Table, repeats: pa.Table) -> pa.Table:
    """Step 3: the texts without the words of the windows that were sent."""
    home, start = Home(table), _found(repeats)
    cover = np.bincount(start, minlength=home.total + WINDOW + 1) - np.bincount(start + WINDOW, minlength=home.total + WINDOW + 1)
    gone = np.cumsum(cover)[: home.total] > 0
    out, rows, held = [], [], 0
    lines = zip(home.table.column("doc_id").to_pylist(), home.begin.tolist(), home.length.tolist(), home.lines(), strict=True)
    for doc_id, i, n, text in lines:
        own, spans = gone[i : i + n], []
        if own.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
            spans = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
            text = b" ".join([w for w, g in zip(text.split(b" "), own.tolist()) if not g])
        rows.append([doc_id, n, int(own.sum()), spans, text.decode()])
        held += len(text)
        if held > BUCKET_BYTES:
            out.append(record_batch(KEPT, list(zip(*rows))))
            rows, held = [], 0
    if rows:
        out.append(record_batch(KEPT, list(zip(*rows))))
    return pa.Table.from_batches(out, KEPT)


def deduplicate(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, the removed word spans and the kept text for each row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                split = [x.split() for x in texts(part, "text")]
                lines, ids = [b" ".join(x) for x in split], part.column(0).to_pylist()
                # one name for rows that are equal, another one for any other row, though it has the same id or none
                names = [xxhash.xxh64_intdigest(
                    b"" if i is None else i.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(x)
                ) >> 1 for i, x in zip(ids, lines)]
                copy = []  # the how manieth of its name in this task: the same numbers whatever the order of rows
                for name in names:
                    copy.append(seen[name] // TOGETHER)
                    seen[name] += 1
                row = np.array(names, np.int64)
                home = _share(mix64(row.astype(np.uint64) + mix64(np.array(copy, np.uint64) + np.uint64(task << 32))), buckets)
                packed = [pa.compress(x, codec="zstd", asbytes=True) for x in lines]
                yield record_batch(PACKED, [ids, row, packed, [len(x) for x in lines], [len(x) for x in split], home.astype(np.int32)])

    packed = rows.mapInArrow(pack, _PACKED_DDL).repartition(buckets, "home")
    texts_at_home = packed.groupBy("home")

    entries = texts_at_home.applyInArrow(lambda table: anchor_entries(table, buckets), _ANCHORS_DDL)
    hits = entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(anchor_hits, _PLACES_DDL)
    windows = texts_at_home.cogroup(hits.groupBy("home")).applyInArrow(lambda table, found: window_entries(table, found, buckets), _WINDOWS_DDL)
    repeats = windows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(repeated_windows, _PLACES_DDL)
    return texts_at_home.cogroup(repeats.groupBy("home")).applyInArrow(remove_repeats, _KEPT_DDL)
