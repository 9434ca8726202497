"""SentencePiece BPE encoding and decoding by exact backtracking.

An encoding is what merging the best pair, leftmost first, until none is left
would give. Merging has one outcome that can be told from neighbours alone: a
row of pieces is that outcome if and only if each two adjacent pieces, merged
again from their characters, come out as the same two. So the encoder takes the
longest piece at each place, found by an Aho-Corasick automaton over reversed
pieces, shortens it while the pair with the piece before is not of that kind,
and steps back where no piece is left; a bitfield of places that were given up
keeps the work linear.

No piece holds a space mark behind another character, nor a character that is no
piece itself; this is checked when the model is read. So runs between such
places are encoded on their own, and a worker remembers the short ones.

Defined cases: a null text counts as an empty one, which has no ids; texts are
encoded whole, in stretches of bounded size; repeated rows give repeated rows;
an empty table gives an empty table; extra columns are ignored. Models that are
not BPE, change characters before encoding, have no byte pieces or pieces of the
user are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .arrow_text import record_batch, slices
from .token_counts import cut, read_model

#: Characters that are matched at once, of a text and of a run in it.
STRETCH = 1 << 20
WINDOW = 1 << 16
#: Bytes, about, of encoded runs that a Python worker remembers, and what an entry takes besides its characters.
REMEMBERED_BYTES = 320 << 20
ENTRY_BYTES = 200
#: Runs of more characters are not remembered.
SHORT = 64
#: Pairs of pieces whose merging a worker remembers.
PAIRS = 1 << 20

_MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NEVER = float("-inf")
_UNKNOWN_TEXT = " ⁇ "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        found = shift = 0
        while True:
            byte = data[at]
            at += 1
            found |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return found

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("trackloom_one_byte", _one_byte)


class PieceCodec:
    """Encodes and decodes with a SentencePiece BPE model, whose size is checked when it is read."""

    def __init__(self, model: bytes):
        self.text_of: list[str] = []
        self.kind: list[int] = []
        self.score: dict[str, float] = {}
        bpe = normal = False
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode(), piece.get(3, _NORMAL)
                if kind == _NORMAL:
                    self.score[text] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.text_of.append(text)
                self.kind.append(kind)
            elif field == 2:
                bpe = dict(_fields(value)).get(3) == 2
            elif field == 3:
                spec = dict(_fields(value))
                normal = not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1
        if not bpe or not normal or set(self.kind) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only BPE models that leave characters as they are and mark spaces can be used")
        self.byte_id = {int(self.text_of[i][1:-1], 16): i for i, kind in enumerate(self.kind) if kind == _BYTE}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        single = {x for x in self.score if len(x) == 1}
        if len(self.byte_id) != 256 or _MARK not in single:
            raise ValueError("the model has no byte pieces or no space mark")
        for text in self.score:
            if not single.issuperset(text) or re.search(f"[^{_MARK}]{_MARK}", text):
                raise ValueError(f"runs cannot be told apart: piece {text!r}")
        self.longest_piece = max(map(len, self.score))
        self.other = re.compile("[^%s]" % re.escape("".join(sorted(single))))
        self.breaks = "\n" not in single
        #: Only pieces that merging their own characters gives; others never are in an encoding.
        self.id_of = {x: i for i, x in enumerate(self.text_of) if self.kind[i] == _NORMAL and self.merges_to(x, len(x))}
        self.size = [len(x) for x in self.text_of]
        self.shorter = [-1] * len(self.text_of)
        for text, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.id_of), -1)
        shown = [_UNKNOWN_TEXT if kind == _UNKNOWN else "" if kind == _CONTROL else text.replace(_MARK, " ") for text, kind in zip(self.text_of, self.kind, strict=True)]
        #: The bytes that an id stands for, by the id and by its digits.
        self.bytes_of = [self.byte_of.get(i) or x.encode() for i, x in enumerate(shown)]
        self.bytes_by_digits = {str(i): x for i, x in enumerate(self.bytes_of)}
        self.pairs: dict[int, bool] = {}
        self.automaton = None
        self.recent: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.held = 0

    def merges_to(self, text: str, boundary: int) -> bool:
        """Whether merging ``text`` from its characters ends with a cut at ``boundary`` and nowhere else."""
        get, parts = self.score.get, list(text)
        scores = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == _NEVER:
                break
            i = scores.index(best)
            if i == boundary - 1:
                return False
            boundary -= i < boundary
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], _NEVER)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], _NEVER)
        return len(parts) == (2 if boundary < len(parts) else 1)

    def fits(self, left: int, right: int) -> bool:
        """Whether two adjacent pieces stay what they are when they are merged again."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.text_of[left], self.text_of[right]
            found = self.pairs[key] = self.merges_to(a + b, len(a))
        return found

    def longest(self, run: str, start: int) -> list[int]:
        """The longest piece at each place of ``run`` from ``start``, for WINDOW places at most."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for text, i in self.id_of.items():
                self.automaton.add_word(text[::-1], i)
            self.automaton.make_automaton()
        stop = min(len(run), start + WINDOW)
        seen = run[start : stop + self.longest_piece - 1]
        found, last, end = [0] * len(seen), len(seen) - 1, -1
        for at, piece in self.automaton.iter(seen[::-1]):
            if at != end:  # of the pieces that end here the longest comes first
                found[last - at], end = piece, at
        return found[: stop - start]

    def encode_run(self, run: str) -> array:
        """Ids of a run of characters that are all pieces."""
        ids, failed, n, pos, base = array("i"), bytearray(len(run) // 8 + 1), len(run), 0, 0
        shorter, sizes, known = self.shorter, self.size, self.pairs.get
        found = self.longest(run, 0)
        piece, last = found[0], -1
        while True:
            while piece >= 0:
                end = pos + sizes[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fit = known(last << 32 | piece)
                    if fit or fit is None and self.fits(last, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                ids.append(piece)
                if end == n:
                    return ids
                pos, last = end, piece
                if not base <= pos < base + WINDOW:
                    base = pos
                    found = self.longest(run, base)
                piece = found[pos - base]
            else:
                if not ids:
                    raise RuntimeError(f"no encoding of {run[:40]!r}")
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = ids.pop()
                pos -= sizes[piece]
                last = ids[-1] if ids else -1

    def encode_segment(self, segment: str) -> array:
        """Ids of a part of a text with its spaces as marks."""
        ids, at = array("i"), 0
        for m in self.other.finditer(segment):
            if m.start() > at:
                ids.extend(self.encode_run(segment[at : m.start()]))
            ids.extend(self.byte_id[b] for b in m.group().encode())
            at = m.end()
        if at < len(segment):
            ids.extend(self.encode_run(segment[at:]))
        return ids

    def segments(self, text: str) -> list[str]:
        """``text`` cut before its spaces and line breaks; a part without a break at its front has lost one space there."""
        if not self.breaks:
            return re.findall(" ( *[^ ]*)", " " + text)
        if "  " in text or " \n" in text or text[:1] in (" ", "\n"):
            return [x[1:] if x[0] == " " else x for x in re.findall(" +[^ \n]*|\n[^ \n]*", " " + text)]
        return text.replace("\n", " \n").split(" ")

    def _marked(self, key: str) -> str:
        key = key.replace(" ", _MARK)
        return key if self.breaks and key[:1] == "\n" else _MARK + key

    def _stretches(self, text: str) -> Iterator[list[str]]:
        if text:
            for part in cut(text.replace(_MARK, " "), STRETCH):
                yield self.segments(part)

    def encode(self, text: str) -> array:
        ids = array("i")
        for keys in self._stretches(text):
            for key in keys:
                ids.extend(self.encode_segment(self._marked(key)))
        return ids

    def decode(self, ids) -> str:
        """The text of ``ids``, without the space that stands before every text; ids that stand for no text may go before it."""
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "trackloom_one_byte")
        first = next((self.text_of[i] for i in ids if self.kind[i] != _CONTROL), "")
        return text[1:] if first[:1] == _MARK else text

    def _learn(self, key: str) -> str:
        """The digits of a segment's ids; short segments are remembered in two generations, the older of which is forgotten."""
        found = self.older.get(key)
        if found is None:
            found = ",".join(map(str, self.encode_segment(self._marked(key))))
        if len(key) <= SHORT:
            if self.held > REMEMBERED_BYTES // 2:
                self.older, self.recent, self.held = self.recent, {}, 0
            self.recent[key] = found
            self.held += ENTRY_BYTES + len(key) + len(found)
        return found

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids and digest of the text decoded from them, one stretch at a time."""
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for keys in self._stretches(text):
            known = self.recent.get
            found = {key: known(key) or self._learn(key) for key in set(keys)}
            told = ",".join([found[key] for key in keys])
            ids = told.split(",")
            decoded = b"".join([self.bytes_by_digits[i] for i in ids]).decode("utf-8", "trackloom_one_byte").encode()
            of_ids.update(("," + told if n else told).encode())
            of_text.update(decoded if n else decoded[1:])
            n += len(ids)
        return n, of_ids.hexdigest(), of_text.hexdigest()


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_ENCODED_DDL = "doc_id long, n_tokens long, ids array<int>, decoded string"
_DIGESTS_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _run(docs: DataFrame, path: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(PieceCodec(read_model(path)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).to_pylist()
                if digests:
                    found = [codec.digests(x or "") for x in texts]
                    yield record_batch(DIGESTS, [part.column(0), *map(list, zip(*found, strict=True))])
                else:
                    ids = [codec.encode(x or "") for x in texts]
                    yield record_batch(ENCODED, [part.column(0), [len(x) for x in ids], ids, [codec.decode(x) for x in ids]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, _DIGESTS_DDL if digests else _ENCODED_DDL)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to, for each row of ``docs``."""
    return _run(docs, path, digests=False)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As :func:`encode_texts`, with SHA-256 digests in the place of ids and texts, taken where the ids are made."""
    return _run(docs, path, digests=True)
