"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input joins an embedding of the hashed word with the scaled sum of its
hashed character n-grams' embeddings, so that inflected forms of a word it has seen
are near each other. A gated recurrent layer reads each window of words in
both directions, attention pools its states, and a logistic unit scores the
window. Every text is scored whole, over overlapping windows that cover all its
words; the document's score is its highest window's.

Labels belong to documents, so fitting alternates between finding each
document's most telling windows and training on them (Adam, gradients by hand
in numpy). The sample for fitting is ``per_class`` documents of each class. Every
sixth of them is kept back: the bias is then set so that, among those, the share
found of class 1 less one and a half times the share wrongly found of class 0 is
largest.

Defined cases: a null or empty text is one empty window; words beyond the last
full window make a shorter one; with labels of one class only every score is
0.999 or 0.001, with none 0.0; equal texts get equal scores; extra columns are
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
from .arrow_text import ascii_lower, mix64, record_batch, slices, span_hashes, texts
from .labelled import held_out, labelled_sample

#: Words in a window, and from one window's start to the next one's.
WINDOW, STRIDE = 32, 16
#: Documents of each class that the network is fitted on, and characters of one of them: longer ones are read in passages from end to end.
PER_CLASS, FIT_CHARS = 1200, 65536
#: Of the sampled documents one in so many is kept back for the bias, if there are enough of each class; what a wrong find costs against a missed one.
KEPT_BACK, LEAST_KEPT, FALSE_COSTS = 6, 20, 1.5
WORD_BITS, CHAR_BITS, EMBEDDED, HIDDEN, ATTENTION = 16, 17, 8, 8, 8
#: Bytes of the character n-grams, which reach one blank beyond a word's ends.
GRAMS = (3, 5, 7)
#: Words and n-grams of fewer sampled documents stay at zero: they would only name single documents.
LEAST_SEEN = 4
EPOCHS = 8
#: Windows that go through the network together.
TOGETHER = 2048

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_EDGE = np.uint8(32)


def _bucket(names: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(names) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Words:
    """The distinct words of some texts, and the texts as numbers of them."""

    number: np.ndarray  # of each word in order
    length: np.ndarray  # words of each text
    word: np.ndarray  # bucket of each distinct word
    gram: np.ndarray  # buckets of the distinct words' character n-grams, end to end
    grams: np.ndarray  # how many each distinct word has


def read_words(rows: list[bytes]) -> Words:
    data = np.frombuffer(b" " + b" ".join(map(ascii_lower, rows)) + b" ", np.uint8)
    begins = np.cumsum([1] + [len(x) + 1 for x in rows])
    edges = np.diff(_SPACE[data].astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
    length = np.diff(np.searchsorted(starts, begins))
    names, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    grams, gram = np.zeros(len(names), np.int64), []
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", wide, strides=(1,))
    owner = []
    for n in GRAMS:  # with the blank on either side
        many = np.maximum(ends - starts + 2 - n + 1, 0)
        at = np.repeat(starts - 1, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        gram.append(_bucket((eight[at] & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n << 56), CHAR_BITS))
        owner.append(np.repeat(np.arange(len(names)), many))
        grams += many
    owner, gram = np.concatenate(owner), np.concatenate(gram)
    return Words(number.reshape(-1), length, _bucket(names, WORD_BITS), gram[np.argsort(owner, kind="stable")], grams)


def window_starts(length: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first word (over all texts) and words of each window; one empty window for an empty text."""
    many = np.maximum(1, -(-(length - window) // stride) + 1)
    owner = np.repeat(np.arange(len(length)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = np.cumsum(length) - length
    return owner, begin[owner] + k * stride, np.minimum(window, length[owner] - k * stride)


def window_words(words: Words, first: np.ndarray, n: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """[window, windows] numbers of words; the number behind the last stands for no word."""
    at = first[None, :] + np.arange(window)[:, None]
    number = np.append(words.number, len(words.word))
    return number[np.where(np.arange(window)[:, None] < n[None, :], np.minimum(at, len(words.number)), len(words.number))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """Parameters by name; ``forward`` keeps what ``backward`` needs."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        e, h, a = 2 * EMBEDDED, HIDDEN, ATTENTION
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"word": np.zeros((1 << WORD_BITS, EMBEDDED), np.float32), "char": (rng.normal(size=(1 << CHAR_BITS, EMBEDDED)) * 0.1).astype(np.float32)}
        for side in ("f", "b"):
            self.p |= {"W" + side: draw(e, 3 * h), "U" + side: draw(h, 3 * h), "c" + side: np.zeros(3 * h, np.float32)}
        self.p |= {"Wa": draw(2 * h, a), "ba": np.zeros(a, np.float32), "va": draw(a), "wo": draw(2 * h), "bo": np.full(1, -1, np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        """A row for each distinct word, and a row of zeros for no word."""
        out = np.zeros((len(words.word) + 1, 2 * EMBEDDED), np.float32)
        out[:-1, :EMBEDDED] = self.p["word"][words.word]
        if len(words.gram):
            at, has = np.cumsum(words.grams) - words.grams, words.grams > 0
            out[:-1][has, EMBEDDED:] = np.add.reduceat(self.p["char"][words.gram], at[has]) / np.sqrt(words.grams[has, None]).astype(np.float32)
        return out

    def _read(self, side: str, rows: np.ndarray, number: np.ndarray, keep: list | None) -> np.ndarray:
        steps, n = number.shape
        h = HIDDEN
        states = np.zeros((steps, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        recurrent = self.p["U" + side]
        none = len(rows) - 1
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            x, own = rows[number[t]], state @ recurrent
            gates = _sigmoid(x[:, : 2 * h] + own[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * own[:, 2 * h :])
            before, state = state, new + z * (state - new)
            if side == "b" and keep is None:
                state *= (number[t] != none)[:, None]
            elif side == "b":
                state = state * (number[t] != none)[:, None]
            states[t] = state
            if keep is not None:
                keep.append((t, before, z, r, new, own[:, 2 * h :]))
        return states

    def forward(self, inputs: np.ndarray, number: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        sides = []
        for side in ("f", "b"):
            rows = inputs @ self.p["W" + side] + self.p["c" + side]
            keep = None if kept is None else kept.setdefault(side, [])
            sides.append(self._read(side, rows, number, keep))
        states = np.concatenate(sides, 2)
        u = np.tanh(states @ self.p["Wa"] + self.p["ba"])
        s = u @ self.p["va"] + np.where(number == len(inputs) - 1, np.float32(-30), np.float32(0))
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        if kept is not None:
            kept |= {"states": states, "u": u, "a": a, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def backward(self, words: Words, inputs: np.ndarray, number: np.ndarray, kept: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        p, h, g = self.p, HIDDEN, {}
        states, u, a = kept["states"], kept["u"], kept["a"]
        g["wo"], g["bo"] = kept["pooled"].T @ slope, slope.sum(keepdims=True)
        pooled = slope[:, None] * p["wo"]
        da = np.einsum("tnh,nh->tn", states, pooled)
        ds = a * (da - (a * da).sum(0))
        g["va"] = np.einsum("tn,tna->a", ds, u)
        du = ds[:, :, None] * p["va"] * (1 - u * u)
        g["Wa"], g["ba"] = np.einsum("tnh,tna->ha", states, du), du.sum((0, 1))
        dstates = a[:, :, None] * pooled + du @ p["Wa"].T
        dinputs = np.zeros_like(inputs)
        for i, side in enumerate(("f", "b")):
            grad = dstates[:, :, i * h : (i + 1) * h]
            carry = np.zeros(grad.shape[1:], np.float32)
            dx = np.zeros((*number.shape, 3 * h), np.float32)
            dU = np.zeros_like(p["U" + side])
            for t, before, z, r, new, own in reversed(kept[side]):
                d = grad[t] + carry
                if side == "b":
                    d = d * (number[t] != len(inputs) - 1)[:, None]
                dnew = d * (1 - z) * (1 - new * new)
                dz = d * (before - new) * z * (1 - z)
                dr = dnew * own * r * (1 - r)
                dx[t] = np.concatenate((dz, dr, dnew), 1)
                dg = np.concatenate((dz, dr, dnew * r), 1)
                dU += before.T @ dg
                carry = d * z + dg @ p["U" + side].T
            g["U" + side], flat, at = dU, dx.reshape(-1, 3 * h), number.reshape(-1)
            order = np.argsort(at, kind="stable")
            used, first = np.unique(at[order], return_index=True)
            rows = np.add.reduceat(flat[order], first)
            g["c" + side], g["W" + side] = rows.sum(0), inputs[used].T @ rows
            dinputs[used] += rows @ p["W" + side].T
        dinputs = dinputs[:-1]
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], words.word, dinputs[:, :EMBEDDED])
        np.add.at(g["char"], words.gram, np.repeat(dinputs[:, EMBEDDED:] / np.sqrt(np.maximum(words.grams, 1))[:, None], words.grams, 0))
        return g

    def logits(self, words: Words, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The logit of each window; arrays are filled up to fixed shapes, as sums in a product of matrices depend on them."""
        if not len(first):
            return np.zeros(0, np.float32)
        own = self.inputs(words)
        inputs = np.zeros((-(-len(own) // TOGETHER) * TOGETHER, own.shape[1]), np.float32)
        inputs[: len(own)] = own
        out = []
        for i in range(0, len(first), TOGETHER):
            number = np.full((WINDOW, TOGETHER), len(inputs) - 1)
            part = window_words(words, first[i : i + TOGETHER], n[i : i + TOGETHER])
            number[:, : part.shape[1]] = np.where(part == len(own) - 1, len(inputs) - 1, part)
            out.append(self.forward(inputs, number)[: part.shape[1]])
        return np.concatenate(out)


def _subset(words: Words, number: np.ndarray) -> tuple[Words, np.ndarray]:
    """Only the words that ``number`` has, renumbered."""
    used, again = np.unique(number, return_inverse=True)
    own = used[used < len(words.word)]
    again = again.reshape(number.shape)
    at = np.cumsum(words.grams) - words.grams
    grams = words.grams[own]
    take = np.repeat(at[own], grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), words.word[own], words.gram[take], grams), again


class Fixed:
    """A score for everything, where the labels have one class or there are none."""

    def __init__(self, logit: float):
        self.logit = logit

    def logits(self, words: Words, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.full(len(first), self.logit, np.float32)


def fit(rows: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 0, batch: int = 256, rate: float = 0.01) -> Network | Fixed:
    if len(set(y.tolist())) < 2:
        return Fixed(-30.0 if not len(y) else 6.9 if y[0] else -6.9)
    rng, net, words = np.random.default_rng(seed), Network(seed), read_words(rows)
    owner, first, n = window_starts(words.length)
    bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
    means = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    text = np.repeat(np.arange(len(rows)), words.length)
    own = np.unique(text * len(words.word) + words.number) % len(words.word) if len(words.word) else np.zeros(0, np.int64)
    seen = np.bincount(own, minlength=len(words.word))
    common = {"word": np.bincount(words.word, seen, 1 << WORD_BITS), "char": np.bincount(words.gram, np.repeat(seen, words.grams), 1 << CHAR_BITS)}
    common = {k: (v >= LEAST_SEEN)[:, None] for k, v in common.items()}
    for k, v in common.items():
        net.p[k] *= v
    step = 0
    epochs = max(epochs, min(40, epochs * 800 // max(1, len(rows))))  # small samples are read more often
    for epoch in range(epochs):
        logit = net.logits(words, first, n) if epoch else rng.normal(size=len(first))
        chosen, label = [], []
        for i in range(len(rows)):
            own = np.arange(bounds[i], bounds[i + 1])
            top = own[np.argsort(-logit[own], kind="stable")]
            if y[i]:
                pick = top[: 4 if epoch == 0 else 1 + (epoch < 3)]
            else:
                pick = np.unique(np.concatenate((top[:1], rng.choice(own, min(2, len(own)), replace=False))))
            chosen.append(pick)
            label.append(np.full(len(pick), y[i]))
        chosen, label = np.concatenate(chosen), np.concatenate(label).astype(np.float32)
        weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-3), 0.5 / max(1 - label.mean(), 1e-3)).astype(np.float32)
        order = rng.permutation(len(chosen))
        size = max(16, min(batch, len(order) // 12))  # a small sample still gets a dozen steps
        for k in range(0, len(order), size):
            own = order[k : k + size]
            subset, number = _subset(words, window_words(words, first[chosen[own]], n[chosen[own]]))
            kept: dict = {}
            inputs = net.inputs(subset)
            p = _sigmoid(net.forward(inputs, number, kept))
            slope = ((p - label[own]) * weight[own] / len(own)).astype(np.float32)
            grads = net.backward(subset, inputs, number, kept, slope)
            step += 1
            pace = rate * (1 - 0.7 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, g in grads.items():
                if name in common:
                    g = g * common[name]
                m, v = means[name]
                m += (g - m) * np.float32(0.1)
                v += (g * g - v) * np.float32(0.001)
                net.p[name] -= np.float32(pace) * m / (np.sqrt(v) + np.float32(1e-8))
    return net


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("windows", pa.int64())])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, fit_chars: int = FIT_CHARS) -> Network | Fixed:
    """Fit on at most ``per_class`` labelled documents of each class, of any length; of one of over ``fit_chars`` characters passages are read."""
    sample = labelled_sample(docs, labels, label, per_class, fit_chars)
    rows = sorted((r.doc_id, r.y, r.text.encode()) for r in sample.select("doc_id", "y", "text").collect())
    kept = rows[::KEPT_BACK]
    enough = min(sum(x[1] == y for x in kept) for y in (0, 1)) >= LEAST_KEPT
    own = [x for i, x in enumerate(rows) if i % KEPT_BACK] if enough else rows
    model = fit([x[2] for x in own], np.array([x[1] for x in own], np.int64))
    if enough and isinstance(model, Network):
        model.p["bo"] = (model.p["bo"] - _cut(document_logits(model, [x[2] for x in kept]), np.array([x[1] for x in kept]))).astype(np.float32)
    return model


def document_logits(model: Network | Fixed, rows: list[bytes]) -> np.ndarray:
    """The logit of each text's highest window."""
    words = read_words(rows)
    owner, first, n = window_starts(words.length)
    logit = np.full(len(rows), -np.inf)
    np.maximum.at(logit, owner, model.logits(words, first, n))
    return logit


def _cut(logit: np.ndarray, y: np.ndarray) -> float:
    """Where to cut between the classes: halfway between the two documents that the best cut parts."""
    order = np.argsort(-logit, kind="stable")
    found, false = np.cumsum(y[order] == 1) / max(1, (y == 1).sum()), np.cumsum(y[order] == 0) / max(1, (y == 0).sum())
    best = int(np.argmax(found - FALSE_COSTS * false))
    last = logit[order[best]]
    return float((last + logit[order[best + 1]]) / 2) if best + 1 < len(order) else float(last - 1)


def score(docs: DataFrame, model: Network | Fixed) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of windows for each row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = read_words(texts(part, "text"))
                owner, first, n = window_starts(words.length)
                logit = np.full(part.num_rows, -np.inf)
                np.maximum.at(logit, owner, own.logits(words, first, n))
                logit = np.round(np.clip(logit, -30, 30), 4)  # sums in single precision differ a little from batch to batch
                yield record_batch(SCORES, [part.column(0), 1 / (1 + np.exp(-logit)), np.bincount(owner, minlength=part.num_rows)])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, windows long")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows")
