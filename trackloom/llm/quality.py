"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are indicators of hashed n-grams: byte trigrams, words and pairs of
words, and pairs and triples of word shapes (first and last byte's class,
length, whether the word before is the same). Each is scaled by its log-count
ratio between the classes, rows are brought to unit length, and a linear
model with squared hinge loss is fitted by dual coordinate descent. Margins
that three folds give for rows left out set the sigmoid that turns a margin
into a score.

The sample for fitting is bounded by ``per_class``; its rows come to the driver
as all their feature numbers or, where that is shorter, as a set of ``BUCKETS``
bits, 32 KB. Scoring covers every whole text.

Defined cases: a null or empty text has no features and gets the score of the
intercept; with labels of one class only, every score is 0.999 or 0.001 as that
class says, with none 0.5; repeated rows get equal scores; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .arrow_text import mix64, record_batch, slices, span_hashes, texts
from .labelled import held_out, labelled_sample

BITS = 18
BUCKETS = 1 << BITS
#: Rows of each class that the model is fitted on, at most.
PER_CLASS = 2000
#: Contract of the query: a document whose score reaches this is kept.
KEEP = 0.3

_DROP = np.uint64(64 - BITS)
# fixed value: byte classes of the shapes; lower and upper case letters, digits and bytes of other letters fall together, each other byte stands for itself
_CLASS = np.array([97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(text: bytes) -> np.ndarray:
    """Sorted numbers of the n-grams that ``text`` holds."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    found = [(mix64(numbers) >> _DROP).astype(np.int64) for numbers in _ngrams(data)]
    if sum(map(len, found)) < BUCKETS // 8:  # sorting a short text's is cheaper than looking at all buckets
        return np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    marked = np.zeros(BUCKETS, bool)
    for numbers in found:
        marked[numbers] = True
    return np.flatnonzero(marked)


def pack_features(found: np.ndarray) -> bytes:
    """All of a text's features: four bytes each, or a bit for every bucket where that is shorter."""
    if len(found) * 4 < BUCKETS // 8:
        return found.astype("<i4").tobytes()
    marked = np.zeros(BUCKETS, bool)
    marked[found] = True
    return np.packbits(marked).tobytes()


def unpack_features(data: bytes) -> np.ndarray:
    if len(data) == BUCKETS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype(np.int32)
    return np.frombuffer(data, np.int32)


def _ngrams(data: np.ndarray) -> Iterator[np.ndarray]:
    wide = data.astype(np.uint64)
    if len(data) >= 3:
        yield (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:] | np.uint64(1 << 32)
    blank = _SPACE[data]
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return
    names = span_hashes(data, starts, ends)
    yield names
    yield names[:-1] * np.uint64(0x9E3779B97F4A7C15) + names[1:] + np.uint64(7)
    same = np.zeros(len(names), np.uint64)
    same[1:] = names[1:] == names[:-1]
    shape = (_CLASS[data[starts]] << np.uint64(16)) | (_CLASS[data[ends - 1]] << np.uint64(8)) | (np.minimum(ends - starts, 15).astype(np.uint64) >> np.uint64(1) << np.uint64(1)) | same
    yield shape | np.uint64(1 << 40)
    yield (shape[:-1] << np.uint64(24)) | shape[1:] | np.uint64(1 << 50)


@dataclass
class Model:
    """Fixed in size: two weights for each bucket."""

    weight: np.ndarray  # of the scaled indicator: log-count ratio times the linear model's weight
    square: np.ndarray  # of the log-count ratio
    intercept: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(self.square[found].sum(dtype=np.float64))) or 1.0
        return float(self.weight[found].sum(dtype=np.float64)) / length + self.intercept

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, BUCKETS))
    for found, label in zip(rows, y, strict=True):
        counts[int(label), found] += 1
    seen = counts.sum(0) > 3  # an n-gram of one row tells nothing of the class
    shares = counts / counts.sum(1, keepdims=True)
    return np.where(seen, np.log(shares[1] / shares[0]), 0.0)


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, sweeps: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Squared hinge loss, both classes weighted alike, by dual coordinate descent."""
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, (y == 1).mean(), (y == 0).mean())
    diagonal = 1.0 / (2.0 * cost * 0.5 / share)
    weight, intercept, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    ends = np.cumsum([len(found) for found in rows])
    flat = np.empty(ends[-1] if len(ends) else 0)  # one array, given back as a whole
    values = np.split(flat, ends[:-1])
    for found, x in zip(rows, values, strict=True):
        x[:] = ratio[found]
        x /= np.sqrt((x * x).sum()) or 1.0
    norms = np.array([(x * x).sum() + 1.0 for x in values]) + diagonal
    order = np.random.default_rng(seed)
    for _ in range(sweeps):
        largest = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (weight[rows[i]] @ values[i] + intercept) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / norms[i], 0.0)
            if (step := (new - alpha[i]) * sign[i]) != 0.0:
                weight[rows[i]] += step * values[i]
                intercept += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return weight, intercept


def fit_sigmoid(margins: np.ndarray, y: np.ndarray, sweeps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton steps with smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(sweeps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        b = b + np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    if len(set(y.tolist())) < 2:
        level = 0.0 if not len(y) else 6.9 if y[0] == 1 else -6.9
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, level)
    margins, fold = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        if len(set(y[inside].tolist())) < 2:
            continue
        own = _linear([rows[i] for i in inside], y[inside])
        for i in np.flatnonzero(fold == k):
            margins[i] = own.margin(rows[i])
    model = _linear(rows, y)
    model.slope, model.offset = fit_sigmoid(margins, y)
    return model


def _linear(rows: list[np.ndarray], y: np.ndarray) -> Model:
    ratio = log_count_ratio(rows, y)
    weight, intercept = fit_hinge(rows, y, ratio)
    return Model((weight * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), intercept, 1.0, 0.0)


FEATURES = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("found", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class."""
    ship_package(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [features(x) for x in texts(part, "text")]
                yield record_batch(FEATURES, [part.column(0), part.column(2), [pack_features(x) for x in found]])

    sample = labelled_sample(docs, labels, label, per_class).select("doc_id", "text", "y")
    rows = sorted((r.doc_id, r.y, bytes(r.found)) for r in sample.mapInArrow(extract, "doc_id long, y int, found binary").collect())
    order = np.random.default_rng(0).permutation(len(rows))
    return fit([unpack_features(rows[i][2]) for i in order], np.array([rows[i][1] for i in order], np.int64))


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield record_batch(SCORES, [part.column(0), [own.score(features(x)) for x in texts(part, "text")]])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``, with all their columns and without a shuffle."""
    ship_package(docs.sparkSession)
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array([own.score(features(x)) >= least for x in texts(part, "text")], pa.bool_()))

    return docs.mapInArrow(run, schema)
