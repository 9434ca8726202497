"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and test items become lower-cased words joined by single spaces. Every
run of ten words of an item is a pattern (an item of fewer words is one). The
search reads a block of bytes at the window's end, skips ahead by the block's
entry in the shift table, and where that is zero goes to the bucket of that
block's hash. Of the bucket's patterns, which are in order of what they begin
with, those that begin as the text does are compared byte by byte. Many stretches of the text are searched in step, as numpy arrays of
positions, and positions are looked at a bounded number at a time. Patterns are
searched for in groups of like length, so that a short one doesn't shorten
everyone's shifts.

Items are sent to the executors in blocks whose size is checked after the cut;
a larger set of items is searched block by block, in one narrow chain without a
shuffle. A worker builds the tables of a block once.

Defined cases: a null text has no words; an item without words is ignored; an
item_id that occurs more than once counts once; an item without item_id hits
words but is not counted or listed; without items no document is contaminated;
repeated documents give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .arrow_text import mix64, record_batch, slices, texts

WINDOW = 10
#: Bytes of item text in a block that is broadcast.
BLOCK_BYTES = 4 << 20
#: Length of a stretch that is searched in step with others.
STRETCH = 2048
#: Positions, and pairs of a position and a pattern, that are looked at together.
TOGETHER = 1 << 19
#: Least bytes of the patterns of each group.
LENGTHS = (1, 16, 32, 64)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_C = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def joined(words: list[bytes]) -> bytes:
    """Words with one space before, between and after them; nothing if there are none."""
    return b" " + b" ".join(words) + b" " if words else b""


class WuManber:
    """Searches for byte patterns, all of them at once."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        entries = len(patterns) * (self.m - self.block + 1)
        self.drop = np.uint64(64 - min(22, max(12, (8 * entries).bit_length())))
        self.most = self.m - self.block + 1
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        padded = np.zeros((len(patterns), self.m + 8), np.uint8)
        padded[:, : self.m] = heads
        self.shift = np.full(1 << (64 - int(self.drop)), min(self.most, 255), np.uint8)
        for at in range(self.most):
            h = self._hash(np.ascontiguousarray(padded[:, at : at + 8]).view("<u8")[:, 0])
            np.minimum.at(self.shift, h, min(self.most - 1 - at, 255))
        # buckets by the hash of the last block that every pattern has; in a bucket patterns are in order of all those bytes' name
        begins = self._begins(np.ascontiguousarray(padded), np.arange(len(patterns)) * (self.m + 8))
        last = self._hash(np.ascontiguousarray(padded[:, self.m - self.block : self.m - self.block + 8]).view("<u8")[:, 0])
        # a bucket for each few patterns: the table is no larger than they are
        bits = 64 - int(self.drop)
        self.coarse = max(0, bits - (2 * len(patterns)).bit_length())
        last >>= self.coarse
        self.order = np.lexsort((begins, last))
        self.begins = begins[self.order]
        self.bucket = np.zeros((1 << (bits - self.coarse)) + 1, np.int32)
        np.cumsum(np.bincount(last, minlength=len(self.bucket) - 1), out=self.bucket[1:])

    def _hash(self, block: np.ndarray) -> np.ndarray:
        return (((block & self.mask) * _C) >> self.drop).astype(np.int64)

    def _begins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A name of the ``m`` bytes at each place of ``data``."""
        eight = np.ndarray((data.size - 7,), "<u8", data, strides=(1,))
        out = np.zeros(len(at), np.uint64)
        for k in [*range(0, self.m - self.block, 8), self.m - self.block]:
            out = mix64(out * _C + (eight[at + k] & self.mask))
        return out

    def _in_bucket(self, names: np.ndarray, low: np.ndarray, high: np.ndarray, behind: bool) -> np.ndarray:
        """For each name the first place of its bucket, low to high, that isn't before it, or that is ``behind`` it."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            found = self.begins[np.minimum(middle, len(self.begins) - 1)]
            right = open_ & ((found <= names) if behind else (found < names))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pattern numbers of all occurrences."""
        n, m = len(data), self.m
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        padded = np.frombuffer(data + bytes(8), np.uint8)
        words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
        at = np.arange(m - self.block, n - self.block + 1, STRETCH)
        end = np.minimum(at + STRETCH, n - self.block + 1)
        found = []
        while len(at):
            h = self._hash(words[at])
            step = self.shift[h]
            zero = step == 0
            if zero.any():
                found.append(at[zero] - (m - self.block))
            at = at + np.maximum(step, 1)
            keep = at < end
            if not keep.all():
                at, end = at[keep], end[keep]
        starts, numbers = [none], [none]
        places = np.concatenate([none, *found])
        for i in range(0, len(places), TOGETHER):
            for start, which in self._compared(data, padded, places[i : i + TOGETHER]):
                starts.append(start)
                numbers.append(which)
        return np.concatenate(starts), np.concatenate(numbers)

    def _compared(self, data: bytes, padded: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Occurrences at ``places``, a bounded number of pairs at a time."""
        names = self._begins(padded, places)
        last = self._hash(np.ndarray((padded.size - 7,), "<u8", padded, strides=(1,))[places + self.m - self.block]) >> self.coarse
        low, high = self.bucket[last].astype(np.int64), self.bucket[last + 1].astype(np.int64)
        low, high = self._in_bucket(names, low, high, False), self._in_bucket(names, low, high, True)
        held = np.flatnonzero(high > low)
        low, many, places = low[held], (high - low)[held], places[held]
        behind = np.cumsum(many)
        begin = 0
        while begin < len(places):
            end = max(begin + 1, int(np.searchsorted(behind, (behind[begin - 1] if begin else 0) + TOGETHER, "right")))
            n = many[begin:end]
            start = np.repeat(places[begin:end], n)
            which = np.repeat(low[begin:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            number = self.order[which]
            same = np.fromiter((data.startswith(self.patterns[k], s) for s, k in zip(start.tolist(), number.tolist())), bool, len(start))
            yield start[same], number[same]
            begin = end


class Items:
    """A block of test items: their patterns, and which items have each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        owners: dict[bytes, set[str]] = {}
        lengths: dict[bytes, int] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                run = words[i : i + window]
                lengths[key := joined(run)] = len(run)
                owners.setdefault(key, set()).update(() if item is None else (item,))
        self.owners = [owners[k] for k in owners]
        self.lengths = [lengths[k] for k in owners]
        keys = list(owners)
        self.searches = []
        for low, high in zip(LENGTHS, (*LENGTHS[1:], 1 << 62)):
            if numbers := [i for i, k in enumerate(keys) if low <= len(k) < high]:
                self.searches.append((WuManber([keys[i] for i in numbers]), np.array(numbers)))
        self.lengths = np.array(self.lengths, np.int64)

    def hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pattern numbers of all occurrences in ``data``."""
        parts = [(start, numbers[k]) for search, numbers in self.searches for start, k in [search.find(data)]]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(s for s, _ in parts)]), np.concatenate([none, *(k for _, k in parts)])


_BUILT: dict[str, Items] = {}


def _built(name: str, rows: list[tuple[str | None, bytes]], window: int) -> Items:
    """The tables of a block, made once by each worker, which holds those of one block at a time."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(rows, window)
    return _BUILT[name]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
STATE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", SPANS)])
_STATE_DDL = "doc_id long, text string, n_words long, items array<string>, spans array<struct<start:int,end:int>>"


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _search(part: pa.RecordBatch, items: Items, keep_text: bool) -> pa.RecordBatch:
    rows = [words_of(x) for x in texts(part, "text")]
    docs, n = [joined(x) for x in rows], np.array([len(x) for x in rows])
    found: list[set[str]] = [set(x or ()) for x in part.column(3).to_pylist()]
    spans: list[list[tuple[int, int]]] = [[(s["start"], s["end"]) for s in x or ()] for x in part.column(4).to_pylist()]
    data = b"\0".join(docs)
    at, number = items.hits(data)
    if len(at):
        begins = np.cumsum([0] + [len(x) + 1 for x in docs])
        blanks = np.cumsum(np.frombuffer(data, np.uint8) == 32)
        doc = np.searchsorted(begins, at, "right") - 1
        before = np.cumsum(n) - n  # words of the documents before
        first = before[doc] + blanks[at] - blanks[begins[doc]]
        total = int(n.sum())
        cover = np.bincount(first, minlength=total + 1) - np.bincount(first + items.lengths[number], minlength=total + 1)
        hit = np.concatenate(([False], np.cumsum(cover)[:total] > 0, [False]))
        for d in np.unique(doc).tolist():
            own = np.concatenate(([False], hit[1 + before[d] : 1 + before[d] + n[d]], [False]))
            edges = np.flatnonzero(np.diff(own.astype(np.int8)))
            spans[d] += [(i, j) for i, j in edges.reshape(-1, 2).tolist()]
        pairs = np.unique(doc * len(items.owners) + number)
        for d, k in zip((pairs // len(items.owners)).tolist(), (pairs % len(items.owners)).tolist()):
            found[d] |= items.owners[k]
    text = part.column(1) if keep_text else pa.nulls(part.num_rows, pa.string())
    return record_batch(STATE, [part.column(0), text, n, [sorted(x) for x in found], [_merge(x) for x in spans]])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[str, list[tuple[str | None, bytes]]]]:
    """A name and the different items of each block; only an item that is larger by itself makes a block of over ``block_bytes``."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null").distinct()
    share = F.xxhash64("item_id", "text")
    n = 1
    while True:
        sizes = rows.groupBy(F.pmod(share, F.lit(n)).alias("k")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("items")).collect()
        most = max((x.bytes for x in sizes if x.items > 1), default=0)
        if most <= block_bytes:
            break
        n = max(2 * n, -(-sum(x.bytes for x in sizes) * 5 // (4 * block_bytes)))
    for k in sorted(x.k for x in sizes) or [0]:
        part = rows if n == 1 else rows.where(F.pmod(share, F.lit(n)) == k)
        yield uuid.uuid4().hex, [(x.item_id, x.text.encode()) for x in part.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted) and spans (word ranges hit, merged) for each row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    none = {"n_words": F.lit(0).cast("long"), "items": F.lit(None).cast("array<string>"), "spans": F.lit(None).cast("array<struct<start:int,end:int>>")}
    state = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[c.alias(name) for name, c in none.items()])

    def searcher(shared, last: bool):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _built(*shared.value, window)
            for batch in batches:
                for part in slices(batch, "text"):
                    yield _search(part, items, keep_text=not last)

        return search

    blocks = list(map(spark.sparkContext.broadcast, _blocks(benchmark, block_bytes)))
    for i, shared in enumerate(blocks):
        state = state.mapInArrow(searcher(shared, i == len(blocks) - 1), _STATE_DDL)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return state.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns and without a shuffle."""
    spark, schema = docs.sparkSession, docs.schema
    ship_package(spark)

    def cleaner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _built(*shared.value, window)
            for batch in batches:
                for part in slices(batch, "text"):
                    data = [joined(words_of(x)) for x in texts(part, "text")]
                    hit = np.zeros(len(data), bool)
                    begins = np.cumsum([0] + [len(x) + 1 for x in data])
                    at, _ = items.hits(b"\0".join(data))
                    hit[np.searchsorted(begins, at, "right") - 1] = True
                    yield part.filter(pa.array(~hit))

        return run

    for shared in map(spark.sparkContext.broadcast, _blocks(benchmark, block_bytes)):
        docs = docs.mapInArrow(cleaner(shared), schema)
    return docs
