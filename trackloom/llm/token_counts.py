"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries into pieces of a bounded size, and pieces are
gathered into encoder calls of about equal bytes. A single space between two
other characters is a safe boundary when no vocabulary piece holds a space mark
behind another character: no merge can then cross it, and the encoder's own
leading space mark stands for the space that is cut out. The vocabulary is
checked for this; with one that is not safe, texts are encoded uncut.

Defined cases: null counts as the empty text, which has no tokens; extra
columns are ignored; repeated rows give repeated rows; an empty table gives one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .arrow_text import record_batch, slices

#: Bytes of text in a piece, and of pieces in a call of the encoder, about.
PIECE_CHARS = 4096
CALL_BYTES = 256 << 10
MODEL_BYTES = 64 << 20

_SPACES = (" ", "▁")
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} has over {MODEL_BYTES} bytes; it would not be broadcast")
    return data


def cut_is_safe(model: sentencepiece.SentencePieceProcessor) -> bool:
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    marked = [len(model.encode(x)) for x in ("a", " a", "a  a", "a a")]
    keeps_spaces = marked[1] >= marked[0] and model.encode("a a") == model.encode("a") * 2
    return keeps_spaces and not any(re.search("[^▁]▁", x) for x in pieces)


def cut(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Pieces of ``text`` of ``size`` characters or a little over, cut at lone spaces, which are left out."""
    out, start, n = [], 0, len(text)
    while n - start > size:
        at = text.find(" ", start + size)
        while at > 0 and (at + 1 >= n or text[at - 1] in _SPACES or text[at + 1] in _SPACES):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[start:at])
        start = at + 1
    out.append(text[start:])
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens are over ``limit``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_model(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        safe = cut_is_safe(model)
        for batch in batches:
            for part in slices(batch, "text", 4 * CALL_BYTES):
                values = [x or "" for x in part.column(1).to_pylist()]
                pieces = [cut(x) if safe else [x] for x in values]
                totals = np.zeros(len(values), np.int64)
                owner = np.repeat(np.arange(len(values)), [len(x) for x in pieces])
                flat = [y for x in pieces for y in x]
                for i, j in _calls(flat):
                    np.add.at(totals, owner[i:j], [len(x) for x in model.encode(flat[i:j], num_threads=1)])
                yield record_batch(COUNTS, [part.column(0), [len(x.encode()) for x in values], totals])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def _calls(pieces: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of pieces of about CALL_BYTES of UTF-8."""
    start, held = 0, 0
    for i, size in enumerate(len(x.encode()) for x in pieces):
        if held and held + size > CALL_BYTES:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(pieces):
        yield start, len(pieces)
