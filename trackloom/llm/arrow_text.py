"""Arrow helpers shared by the text operators: byte-bounded batches and UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Python works on slices of at most about so many bytes of text at once.
SLICE_BYTES = 4 << 20

#: Bytes that separate words: \x20 and \x09-\x0D. ``bytes.split()`` uses the same set.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ascii_lower(data: bytes) -> bytes:
    return data.translate(_LOWER)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of ``column``; a longer row is a run of its own."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's values as UTF-8; null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a public-domain finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_names(lines: list[bytes]) -> np.ndarray:
    """A 128-bit name for every word of ``lines``, end to end: [words, 2] 64-bit numbers. Lines are words with one space between them.

    A word of sixteen bytes or fewer is two numbers that are mixed so that
    either can be told from the name again: no two of them share one. A longer
    word's name is its BLAKE2b digest.
    """
    text = b" ".join(lines) + b" "
    data = np.frombuffer(text + bytes(16), np.uint8)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    real = ends > starts  # an empty line leaves two spaces side by side
    starts, size = starts[real], (ends - starts)[real]
    low = eight[starts] & _BELOW[np.minimum(size, 8)]
    high = eight[starts + np.minimum(size, 8)] & _BELOW[np.clip(size - 8, 0, 8)]
    low = mix64(low + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    high = mix64(high + low * np.uint64(0xD6E8FEB86659FD93))
    names = np.stack([mix64(low ^ (high << np.uint64(32)) ^ (high >> np.uint64(32))), high], 1)
    for i in np.flatnonzero(size > 16).tolist():
        names[i] = np.frombuffer(blake2b(text[starts[i] : starts[i] + size[i]], digest_size=16).digest(), "<u8")
    return names


def run_names(words: np.ndarray, n: int) -> np.ndarray:
    """A name for the run of ``n`` words at every place, made by joining runs of powers of two.

    Runs that cross a text's end have a name too, which is not to be used.
    """
    done, size, part, width = None, 0, words, 1
    while True:
        if n & width:
            done, size = (part, width) if done is None else (_joined(done, part, size), size + width)
        if size == n:
            return done[: max(0, len(words) - n + 1)]
        part, width = _joined(part, part, width), 2 * width


def _joined(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Names of the runs made of one of ``left``, of ``size`` words, and the one of ``right`` behind it."""
    n = max(0, min(len(left), len(right) - size))
    after = right[size : size + n]
    return mix64(left[:n] * np.uint64(0x9E3779B97F4A7C15) + ((after << np.uint64(29)) | (after >> np.uint64(35))))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each byte span [start, end) of ``data``, the same wherever the bytes stand.

    Prefix sums of a polynomial modulo 2**64; two bytes at a time are not
    needed because the sums are numpy passes over the whole buffer.
    """
    n = len(data)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), np.uint64)
    power = np.empty(n, np.uint64)
    power[0] = 1
    power[1:] = _BASE
    np.cumprod(power, out=power)
    table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[data] * power, out=sums[1:])
    # back to offset 0: divide by BASE ** start
    inverse = np.empty(n, np.uint64)
    inverse[0] = 1
    inverse[1:] = _INVERSE
    np.cumprod(inverse, out=inverse)
    return mix64((sums[ends] - sums[starts]) * inverse[np.minimum(starts, n - 1)] + (ends - starts).astype(np.uint64))
