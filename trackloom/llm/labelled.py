"""Bounded samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column | str) -> Column:
    """Whether a document is kept from training: CRC-32 of its number as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


#: Passages, evenly spread, that stand for a text that is too long to be taken whole.
PASSAGES = 16


def excerpt(text: str, most_chars: int) -> Column:
    """``text``, or of a longer one passages from its beginning to its end, ``most_chars`` characters in all at most."""
    size = max(1, most_chars // PASSAGES - 1)
    start = lambda i: 1 + F.floor(i * (F.length(text) - size) / (PASSAGES - 1)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda i: F.substring(F.col(text), start(i), F.lit(size)))
    return F.when(F.length(text) <= most_chars, F.col(text)).otherwise(F.array_join(spread, " "))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int | None = None) -> DataFrame:
    """doc_id, text and y of at most ``per_class`` rows of ``docs`` of each class; of texts of over ``most_chars`` characters an :func:`excerpt`.

    Ids are chosen by a hash among those that have a text, so the sample is the
    same on every run; rows with a null id or label are never chosen. An id with
    both labels is no evidence and is left out. Of rows that share an id the
    one with the least hash of its text is taken, so rows are bounded as ids
    are. The ids, ``2 * per_class`` at most, are what is broadcast to the scan
    of the texts.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where("y = _most").drop("_most")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = texts.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    first = F.min_by("text", F.xxhash64("text"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    if most_chars is not None:
        rows = rows.withColumn("text", excerpt("text", most_chars))
    return rows.groupBy("doc_id", "y").agg(first.alias("text")).select("doc_id", "text", "y")
