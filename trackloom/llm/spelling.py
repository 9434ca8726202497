"""Spelling variants grouped by an index of variable-length grams.

Two words are near if one inserted, deleted or replaced character turns one into
the other. A dictionary says how long a gram is: from every place of a word the
gram has two characters, and one more as long as the gram so far is frequent
among all words, up to five. A gram's length follows from its own characters, so
an edit affects those grams only that cover its place; the most that any place
has is the word's bound. A word of L places whose bound is B shares at least
L - B grams with every near word, so one of its B + 1 rarest is shared: only the
lists of those are merged. Lists are told apart by the gram's place and the
words' length; a word is also put into the lists of words one longer, at the same
place and the next. Of a list those words are compared that are equal in a half
and whose characters, as a set of bits, differ in two at most; they are verified
character by character.

The dictionary has the grams that more than a given share of all places have, so
its size is bounded by that share whatever the corpus, as are the tables of gram
and list sizes, which are counted by hash. Lists of many words are cut: near
words of one list are equal in their first or in their second half, so such a
list becomes lists by half, an exact cut that both words take.

A word's form is its near word of largest count (the first in code-point order
of equal ones) if that is at least so many times the word's. Forms are followed
to the last by doubling: each step multiplies the count, so there are few.

Defined cases: a null or empty text has no words; a null id is written as
nothing; repeated rows count again; extra columns are ignored; an empty table
gives an empty table. Words of any length and characters are taken.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, ship_package, written
from .arrow_text import ascii_lower, mix64, record_batch, slices

#: A word is a run of these; only A-Z are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, TIMES, ERROR_EVERY = 7, 2, 10, 31
#: Characters of a gram, at least and at most.
SHORTEST, LONGEST = 2, 5
#: A gram is frequent if more places have it than this, and than one in MOST_FREQUENT of all: there are fewer than that of each length.
LIST, MOST_FREQUENT = 64, 1 << 18
#: Hash buckets in which grams and lists are counted.
BUCKETS = 1 << 18
#: A list of more words is cut by halves.
LONG_LIST = 2048
#: Words whose characters are put into one array; longer words are compared one by one.
WIDE = 64
#: Characters of a text, and rows, that are worked on at once.
STRETCH, AT_ONCE = 1 << 20, 1 << 16

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_GRAMS = pa.schema([("size", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
_BUCKETS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
_LISTED = pa.schema([("list", pa.int64()), ("longer", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def with_error(word: str, h: int) -> str:
    """``word`` without one character, if ``h`` says so."""
    if h % ERROR_EVERY:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(docs: DataFrame, errors: bool = False, letters: str = LETTERS, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of all words of ``docs``; with ``errors``, some lose a character, by crc32 of ``doc_id:word``."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, other = re.compile(letters), re.compile(letters.replace("[", "[^").rstrip("+"))
        held: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    base, at, text = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), 0, text or ""
                    while at < len(text):
                        end = other.search(text, at + STRETCH)
                        end = end.start() if end else len(text)
                        own = Counter(run.findall(ascii_lower(text[at:end].encode()).decode()))
                        at = end
                        for word, n in own.items():
                            word = with_error(word, zlib.crc32(word.encode(), base)) if errors else word
                            if len(word) >= least_letters:
                                held[word] += n
                        if len(held) > AT_ONCE * 4:
                            yield record_batch(_COUNTS, [list(held), list(held.values())])
                            held.clear()
        yield record_batch(_COUNTS, [list(held), list(held.values())])

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Words:
    """Words end to end as codes, each with room for a gram behind it; ``place`` has the words' characters, ``owner`` the words."""

    def __init__(self, words: list[str]):
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        room = self.sizes + LONGEST
        self.starts = np.cumsum(room) - room
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        firsts = np.cumsum(self.sizes) - self.sizes
        self.place = self.starts[self.owner] + np.arange(len(self.points)) - firsts[self.owner]
        self.codes = np.zeros(int(room.sum()) + LONGEST, np.int64)
        self.codes[self.place] = 1 + self.points % 255

    def grams(self, size: int) -> np.ndarray:
        """The gram of so many characters at each place, as a number."""
        return sum(self.codes[self.place + k] << (8 * k) for k in range(size))


def _found_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def decompose(words: Words, frequent: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each place the gram's name and size, and for each word its bound: the most grams that one place is covered by."""
    size = np.full(len(words.place), SHORTEST)
    name = words.grams(SHORTEST)
    for k in range(SHORTEST, LONGEST):
        more = (size == k) & _found_in(name, frequent[k])
        size[more] = k + 1
        name[more] |= words.codes[words.place[more] + k] << (8 * k)
    edge = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(edge, words.place, 1)
    np.add.at(edge, words.place + size, -1)
    covered = np.cumsum(edge)[: len(words.codes)]
    bound = np.maximum.reduceat(covered, words.starts) if len(words.starts) else np.zeros(0, np.int64)
    return name | (size << 48), size, bound


def _bucket(names: np.ndarray) -> np.ndarray:
    return (mix64(names.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def rarest(words: Words, frequent: dict[int, np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, name and place in the word of the grams that are to be merged: of each word the bound and one more, rarest first."""
    name, _, bound = decompose(words, frequent)
    firsts = np.cumsum(words.sizes) - words.sizes
    place = np.arange(len(name)) - firsts[words.owner]
    order = np.lexsort((place, name, sizes[_bucket(name)], words.owner))
    kept = order[place <= bound[words.owner]]  # places number the rows of a word in any order
    return words.owner[kept], name[kept], place[kept]


def lists_of(words: Words, owner: np.ndarray, name: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each list that a word is in: owner, list, and whether the list is that of words one longer, which may have the gram one place on."""
    longer = np.repeat([False, True, True], len(owner))
    place = np.concatenate([place, place, place + 1]).astype(np.uint64)
    owner = np.tile(owner, 3)
    size = (words.sizes[owner] + longer).astype(np.uint64)
    name = mix64(np.tile(name, 3).astype(np.uint64) + place * np.uint64(_ODD))
    return owner, mix64(name ^ size * np.uint64(0xD6E8FEB86659FD93)).view(np.int64), longer


def halves(words: Words, owner: np.ndarray, longer: np.ndarray) -> list[np.ndarray]:
    """Names of the two parts of which one is equal in words that are near, in a list of words of this length, or one more if ``longer``."""
    n = len(words.points)
    power, inverse = np.full((2, n + 1), 1, np.uint64)
    power[1:], inverse[1:] = _ODD, _INVERSE
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(words.points.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    size = words.sizes[owner]
    start = (np.cumsum(words.sizes) - words.sizes)[owner]
    half = (size + longer) // 2
    parts = (start, start + half), (start + half - longer, start + size)
    return [mix64((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)) + np.uint64(side) for side, (a, b) in enumerate(parts)]


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int]]]:
    for batch in batches:
        for part in slices(batch, "word"):
            for i in range(0, part.num_rows, AT_ONCE // 4):
                cut = part.slice(i, AT_ONCE // 4)
                yield cut.column(0).to_pylist(), cut.column(1).to_pylist()


def _summed(words: DataFrame, made, schema: pa.Schema, ddl: str, keys: list[str]) -> DataFrame:
    """Numbers with counts, from ``made`` for some words at a time, summed in the task and then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _ in _word_batches(batches):
            yield record_batch(schema, made(Words(some)))

    return words.mapInArrow(run, ddl).groupBy(*keys).agg(F.sum("n").alias("n"))


def dictionary(words: DataFrame) -> dict[int, np.ndarray]:
    """The frequent grams of each size, fewer than MOST_FREQUENT of each, whatever the number of words."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    limit = max(LIST, total // MOST_FREQUENT)

    def made(some: Words) -> list[np.ndarray]:
        found = [(k, *np.unique(some.grams(k), return_counts=True)) for k in range(SHORTEST, LONGEST)]
        return [np.concatenate([np.full(len(g), k, np.int32) for k, g, _ in found]), *(np.concatenate([x[i] for x in found]) for i in (1, 2))]

    found = _summed(words, made, _GRAMS, "size int, gram long, n long", ["size", "gram"]).where(F.col("n") > limit).select("size", "gram").toArrow()
    size, gram = (found.column(x).to_numpy() for x in ("size", "gram"))
    return {k: np.sort(gram[size == k]) for k in range(SHORTEST, LONGEST)}


def _counted(words: DataFrame, made) -> np.ndarray:
    """How many numbers of ``made`` fall into each bucket."""

    def buckets(some: Words) -> list[np.ndarray]:
        return list(np.unique(_bucket(made(some)), return_counts=True))

    found = _summed(words, buckets, _BUCKETS, "bucket long, n long", ["bucket"]).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def listed(words: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """``words`` (word, n) with each list that is to be merged: list, longer, word, n."""
    sc = words.sparkSession.sparkContext
    frequent = sc.broadcast(dictionary(words))
    sizes = sc.broadcast(_counted(words, lambda some: decompose(some, frequent.value)[0]))
    lengths = sc.broadcast(_counted(words, lambda some: lists_of(some, *rarest(some, frequent.value, sizes.value))[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, counts in _word_batches(batches):
            made = Words(some)
            owner, name, longer = lists_of(made, *rarest(made, frequent.value, sizes.value))
            cut = lengths.value[_bucket(name)] > long_list
            if cut.any():
                whole = ~cut
                split = [mix64(name[cut].view(np.uint64) ^ x).view(np.int64) for x in halves(made, owner[cut], longer[cut])]
                name = np.concatenate([name[whole], *split])
                owner, longer = (np.concatenate([x[whole], x[cut], x[cut]]) for x in (owner, longer))
            yield record_batch(_LISTED, [name, longer, pa.array(some, pa.string()).take(pa.array(owner)), np.asarray(counts, np.int64)[owner]])

    return words.mapInArrow(run, "list long, longer boolean, word string, n long")


def one_apart(a: str, b: str) -> bool:
    """Whether one edit turns ``a`` into ``b``, which is as long or one longer."""
    if a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def verify(words: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """:func:`one_apart` of each pair of numbers of words; the left word is as long as the right one or one shorter."""
    used, both = np.unique(np.concatenate([left, right]), return_inverse=True)
    words, left, right = [words[i] for i in used.tolist()], both[: len(left)], both[len(left) :]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    found = np.zeros(len(left), bool)
    fit = sizes[right] < WIDE
    short = np.minimum(sizes, WIDE)
    width = int(short.max(initial=0)) + 1
    table = np.zeros((len(words), width), np.uint32)
    points = np.frombuffer("".join([w[:WIDE] for w in words]).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(words)), short)
    table[row, np.arange(len(points)) - np.repeat(np.cumsum(short) - short, short)] = points
    equal = fit & (sizes[left] == sizes[right])
    found[equal] = (table[left[equal]] != table[right[equal]]).sum(1) == 1
    near = np.flatnonzero(fit & ~equal)
    if len(near):
        a, b = table[left[near]], table[right[near]]
        first = (a != b).argmax(1)
        found[near] = ~((a[:, :-1] != b[:, 1:]) & (np.arange(width - 1) >= first[:, None])).any(1)
    for i in np.flatnonzero(~fit).tolist():
        found[i] = one_apart(words[left[i]], words[right[i]])
    return found


def pairs_of(name: np.ndarray, longer: np.ndarray, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one list that are to be verified, as they are equal in a half; in each the shorter word comes first."""
    made, rows = Words(words), np.arange(len(words))
    bits = np.bitwise_or.reduceat(np.uint64(1) << (made.points % 64).astype(np.uint64), np.cumsum(made.sizes) - made.sizes)
    for part in halves(made, rows, longer):
        key = mix64(name.view(np.uint64) ^ part)
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begins, len(key)))
        end, at, d = np.repeat(begins + size, size), np.flatnonzero(np.repeat(size > 1, size)), 0
        while len(at):
            d += 1
            at = at[at + d < end[at]]
            a, b = order[at], order[at + d]
            kept = (np.bitwise_count(bits[a] ^ bits[b]) <= 2) & ~(longer[a] & longer[b])  # two that are one shorter meet in a list of their own
            a, b = a[kept], b[kept]
            yield np.where(longer[b], b, a), np.where(longer[b], a, b)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of lists to verified pairs, in both directions."""
    held: list[pa.RecordBatch] = []

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        column = pa.array(words, pa.string())
        for a, b in pairs_of(rows.column("list").to_numpy(), rows.column("longer").to_numpy(), words):
            near = verify(words, a, b)
            left, right = np.concatenate([a[near], b[near]]), np.concatenate([b[near], a[near]])
            if len(left):
                yield record_batch(_NEAR, [column.take(pa.array(left)), column.take(pa.array(right)), n[right]])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < AT_ONCE:
            continue
        rows = pa.Table.from_batches(held)
        name = rows.column("list").to_numpy()
        whole = int(np.searchsorted(name, name[-1]))  # the last list may go on
        if whole:
            yield from told(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
    if held:
        yield from told(pa.Table.from_batches(held))


def near_words(words: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """word, near and near_n for each two near words of ``words`` (word, n: different words), in both directions."""
    ship_package(words.sparkSession)
    rows = listed(words, long_list).repartition("list").sortWithinPartitions("list")
    found = rows.mapInArrow(_merged, "word string, near string, near_n long")
    return found.repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word and root of ``forms`` (word, form): where following forms ends. Each step follows what is known, so steps double."""
    with scratch() as kept:
        now = written(forms.select("word", F.col("form").alias("root")), "roots")
        while True:
            onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
            after = now.join(onward, "root", "left")
            after = written(after.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
            if not after.where("moved").limit(1).count():
                kept.append(after)
                return after
            now = after


def variants(words: DataFrame, times: int = TIMES, long_list: int = LONG_LIST) -> DataFrame:
    """word, form, root, n, n_near and form_n for each of ``words`` (word, n: different words)."""
    with scratch() as kept:
        words = written(words.select("word", "n"), "words")
        near = near_words(words, long_list).groupBy("word")
        best = near.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        is_form = -F.col("best.less") >= F.lit(times) * F.col("n")
        found = written(words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, -F.col("best.less")).alias("form_n")
        ), "forms")
        ends = roots(found.where("form is not null"))
        kept.extend([found, ends])
    joined = found.join(ends.select("word", "root"), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
