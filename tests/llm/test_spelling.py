"""Spelling variants against comparing all words, and bounds against what edits do."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trackloom.llm import queries, spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def without_one(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and short in without_one(long)


def plain_variants(counts, times=10):
    """By words that lose one character, for speed; checked against all pairs below."""
    losing = {}
    for word in counts:
        for x in {word} | without_one(word):
            losing.setdefault(x, set()).add(word)
    near = {w: {v for x in {w} | without_one(w) for v in losing.get(x, ()) if is_near(w, v)} for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def told(found):
    return {tuple(r[x] for x in COLUMNS) for r in found.collect()}


def made_words(seed, n=400):
    """Words of few characters and their misspellings, so that lists are long; some are of one character throughout."""
    rng = random.Random(seed)
    words = {"a" * k for k in range(7, 12)} | {"".join(rng.choice("abé") for _ in range(rng.randrange(7, 12))) for _ in range(n)}
    for word in sorted(words):
        k = rng.randrange(len(word) + 1)
        words |= {word[:k] + rng.choice("abz") + word[k:], word[:k] + "z" + word[k + 1 :], word[:k] + word[k + 1 :]}
    words |= {"x" * 30 + w + "y" * 60 for w in sorted(words)[:20]} | {"\U0001f600" + w for w in sorted(words)[:20]}
    return {w: rng.choice([2, 3, 30, 300, 3000, 30000]) for w in sorted(words) if len(w) >= 7}


@pytest.mark.parametrize("long_list", [2048, 3])
def test_variants_equal_all_pairs(spark, long_list):
    counts = made_words(long_list)
    near = {w: {v for v in counts if is_near(w, v)} for w in counts}
    expected = plain_variants(counts)
    assert {(w, k) for w, _, _, _, k, _ in expected} == {(w, len(x)) for w, x in near.items()}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert told(spelling.variants(words, long_list=long_list)) == expected
    assert max(len(x) for x in near.values()) > 5


def test_bounds_cover_every_edit():
    """Grams that an edit takes from a word are no more than its bound, at their places, or one on behind what is inserted."""
    rng = random.Random(4)
    words = sorted(made_words(9, 150))
    made = spelling.Words(words)
    some = [sorted(set(made.grams(k).tolist())) for k in range(spelling.SHORTEST, spelling.LONGEST)]
    frequent = {k: np.sort(rng.sample(x, 2 * len(x) // 3)) for k, x in enumerate(some, spelling.SHORTEST)}

    def grams(word):
        name, size, bound = spelling.decompose(spelling.Words([word]), frequent)
        return name.tolist(), set(size.tolist()), int(bound[0])

    sizes = set()
    for word in words:
        own, seen, bound = grams(word)
        sizes |= seen
        for i in range(len(word) + 1):
            other, _, _ = grams(word[:i] + "q" + word[i:])
            assert sum(own[p] != other[p + (p >= i)] for p in range(len(word))) <= bound
            if i < len(word):
                other, _, _ = grams(word[:i] + "q" + word[i + 1 :])
                assert sum(a != b for a, b in zip(own, other)) <= bound
                other, _, _ = grams(word[:i] + word[i + 1 :])
                assert sum(p == i or own[p] != other[p - (p > i)] for p in range(len(word))) <= bound
    assert sizes == {2, 3, 4, 5}


def test_verification_is_exact():
    rng = random.Random(5)
    words = sorted(made_words(6, 60)) + ["w" * 70, "w" * 71, "w" * 69 + "v", "v" + "w" * 70]
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words)) if i != j and len(words[j]) - len(words[i]) in (0, 1)]
    pairs = rng.sample(pairs, 4000) + [p for p in pairs if len(words[p[0]]) >= 64]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    assert spelling.verify(words, a, b).tolist() == [is_near(words[i], words[j]) for i, j in pairs]


def test_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_FREQUENT", 50)
    monkeypatch.setattr(spelling, "LIST", 1)
    words = spark.createDataFrame([(w, 2) for w in made_words(3)], "word string, n long")
    found = spelling.dictionary(words)
    assert all(len(x) < 50 for x in found.values()) and any(len(x) for x in found.values())


def test_words_of_awkward_rows(spark, monkeypatch):
    rows = [
        (1, None), (2, ""), (None, "Überfall überfall ÜBERFALL " * 3), (3, "abcdefgh×÷ABCDEFGH-abcdefgh1abcdefgh"), (3, "abcdefgh×÷ABCDEFGH"),
        (4, "hijklmnop " * 5000), (5, "q" * 200000 + " " + "q" * 200000), (6, "ŵabcdefghŵ abcdefgi")
    ]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    found = spelling.word_counts(docs, errors=True)
    assert {r.word: r.n for r in found.collect()} == plain_counts(rows)
    assert told(spelling.variants(found)) == plain_variants(plain_counts(rows))
    assert spelling.variants(spelling.word_counts(docs.where("false"))).count() == 0


def test_query_equals_plain_loops(spark, sf_dir):
    rows = [tuple(r) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()]
    found = queries.queries()["op11_spelling_variants"](spark, sf_dir)
    assert found.columns == COLUMNS
    assert told(found) == plain_variants(plain_counts(rows))
