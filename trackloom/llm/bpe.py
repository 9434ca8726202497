"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: hash and displace, one
slot for each token and no empty ones, so a whole pre-token that is a token is
found by one probe and one comparison. Tier two, for pre-tokens that are not
tokens, merges over a doubly linked list of byte pieces, with a heap that holds
the mergeable pairs by rank and then by place.

Defined cases: a null text counts as an empty one; an empty text has no tokens;
texts are encoded whole, whatever their length; repeated rows give repeated
rows; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .arrow_text import record_batch, slices

#: A vocabulary file of more bytes is refused: its tables are broadcast.
VOCABULARY_BYTES = 64 << 20
#: Bytes, about, of encoded pre-tokens that a Python worker remembers, and what an entry and one of its ids take.
REMEMBERED_BYTES, ENTRY_BYTES, ID_BYTES = 288 << 20, 200, 36
#: Pre-tokens of more characters are not remembered.
SHORT = 64

_MASK = (1 << 64) - 1


class MinimalHash:
    """Token bytes to slots 0..n-1 without empty slots; ``find`` gives the token's rank or -1."""

    def __init__(self, tokens: list[bytes], ranks: list[int], seed: int = 0):
        self.seed, self.n = seed, len(tokens)
        self.buckets = self.n // 4 + 1
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, token in enumerate(tokens):
            h = xxhash.xxh3_64_intdigest(token, seed)
            groups[h % self.buckets].append((h, i))
        self.move = np.zeros(self.buckets, np.int64)
        taken = np.zeros(self.n, bool)
        place = [0] * self.n
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if len(group) < 2:
                break
            names, low = np.array([h for h, _ in group], np.uint64)[:, None], 0
            while True:  # 256 displacements at a time
                slots = self._slots(names, np.arange(low, low + 256, dtype=np.uint64))
                fits = ~taken[slots].any(0) & (np.diff(np.sort(slots, axis=0), axis=0) != 0).all(0)
                if fits.any():
                    d = low + int(fits.argmax())
                    slots = slots[:, d - low].tolist()
                    break
                low += 256
                if low > 5_000_000:
                    raise ValueError("two tokens have one hash; give another seed")
            self.move[b] = d
            for s, (_, i) in zip(slots, group, strict=True):
                taken[s], place[i] = True, s
        free = iter([s for s in range(self.n) if not taken[s]])
        for b in range(self.buckets):  # a bucket of one names its slot itself
            if len(groups[b]) == 1:
                s = next(free)
                self.move[b], place[groups[b][0][1]] = -1 - s, s
        self.tokens: list[bytes] = [b""] * self.n
        self.ranks = np.zeros(self.n, np.int64)
        for i, s in enumerate(place):
            self.tokens[s], self.ranks[s] = tokens[i], ranks[i]
        self.moves, self.rank_list = self.move.tolist(), self.ranks.tolist()

    def _slots(self, names: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """As :meth:`_slot`, for many names and displacements."""
        x = names ^ (moves * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
        return (x ^ (x >> 29)) % self.n

    def find(self, token: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(token, self.seed)
        d = self.moves[h % self.buckets]
        s = -1 - d if d < 0 else self._slot(h, d)
        return self.rank_list[s] if self.tokens[s] == token else -1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token, space, rank, one to a line."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {VOCABULARY_BYTES} bytes; its tables would not be broadcast")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


#: The pattern over texts whose characters are all below U+0250, with its classes of letters, numbers and white space spelt out.
_SIMPLE_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_SIMPLE_NUMBERS = "0-9²³¹¼-¾"
_SIMPLE_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_SIMPLE = f" ?[{_SIMPLE_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_SIMPLE_NUMBERS}]+| ?[^{_SIMPLE_SPACE}{_SIMPLE_LETTERS}{_SIMPLE_NUMBERS}]+|[{_SIMPLE_SPACE}]+(?![^{_SIMPLE_SPACE}])|[{_SIMPLE_SPACE}]+"


class Codec:
    """Encodes and decodes texts. Its tables are as large as the vocabulary, whose size is checked, and are broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, simple: bool):
        self.ranks = ranks
        self.table = MinimalHash(list(ranks), list(ranks.values()))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.simple = re.compile(_SIMPLE) if simple else None
        self.other = re.compile("[^\x00-ɏ]")
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        if self.simple is not None and not self.other.search(text):
            return self.simple.findall(text)
        return [m.group() for m in self.pattern.finditer(text)]

    def merge(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left.

        Pieces are named by their first byte's place and linked both ways. The
        heap holds rank and place as one number; ``pair`` has the rank of each
        piece with the next, which tells whether an entry still counts.
        """
        get, n = self.ranks.get, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(data[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        heap = [r * n + i for i, r in enumerate(pair) if r is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            if pair[i] != r:
                continue  # an end of this pair has been merged since
            j = after[i]
            k = after[i] = after[j]
            pair[i] = pair[j] = None
            if k < n:
                before[k] = i
                if (r := get(data[i : after[k]])) is not None:
                    pair[i] = r
                    heappush(heap, r * n + i)
            if (h := before[i]) >= 0:
                pair[h] = r = get(data[h:k])
                if r is not None:
                    heappush(heap, r * n + h)
        out, i = [], 0
        while i < n:
            out.append(get(data[i : after[i]]))
            i = after[i]
        return out

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        rank = self.table.find(data)
        return (rank,) if rank >= 0 else tuple(self.merge(data))

    def encode(self, text: str) -> list[int]:
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        pieces, known, long = self.pieces(text), self.known, {}
        for piece in set(pieces).difference(known):
            ids = self.encode_piece(piece)
            if len(piece) > SHORT:
                long[piece] = ids
            else:
                known[piece] = ids
                self.held += ENTRY_BYTES + len(piece) + ID_BYTES * len(ids)
        find = (lambda piece: known.get(piece) or long[piece]) if long else known.__getitem__
        return list(chain.from_iterable(map(find, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_ENCODED_DDL = "doc_id long, n_tokens long, ids array<int>, decoded binary"
_DIGESTS_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _run(docs: DataFrame, path: str, pattern: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Codec(read_ranks(path), pattern, simple=pattern == public_tokenizers.PATTERN))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        name: dict[int, str] = {rank: str(rank) for rank in codec.bytes_of} if digests else {}
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [codec.encode(text or "") for text in part.column(1).to_pylist()]
                decoded = map(codec.decode, ids)
                n = [len(x) for x in ids]
                if digests:
                    own = [hashlib.sha256(",".join(map(name.__getitem__, x)).encode()).hexdigest() for x in ids]
                    yield record_batch(DIGESTS, [part.column(0), n, own, [hashlib.sha256(x).hexdigest() for x in decoded]])
                else:
                    yield record_batch(ENCODED, [part.column(0), n, ids, list(decoded)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, _DIGESTS_DDL if digests else _ENCODED_DDL)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and the bytes that the ids decode to, for each row of ``docs``."""
    return _run(docs, path, pattern, digests=False)


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As :func:`encode_texts`, with SHA-256 digests in the place of ids and bytes, taken where the ids are made."""
    return _run(docs, path, pattern, digests=True)
