"""The text operators against brute force, on awkward rows and on the small tables."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm import arrow_text, bpe, components, decontaminate, fingerprints, labelled, pii, quality, queries, shingles, simhash, substrings, token_counts, toxicity, warc

NAMES = queries.queries()
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Extra columns whose names operators use for their own.
SCHEMA = "doc_id long, text string, score string, key string, fp int, h int, packed string, spans string, y int, base int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "s", "k", 1, 2, "p", "q", 3, 4) for i, t in texts], SCHEMA)


def awkward():
    rng = random.Random(0)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared = line(40)
    texts = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Zwei Über \U0001f600 naïve"), (6, shared), (7, shared),
        (8, line(30) + " " + shared + " " + line(25)), (9, line(6000)), (10, "x" * 30000), (None, line(50)), (12, shared.upper()), (13, "a " * 300),
        (6, shared)
    ]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return rows_of(spark, awkward())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def con(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return db


def told(rows, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    found = NAMES[name](spark, sf_dir)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert told(found.collect(), names) == told([dict(zip(names, r)) for r in cursor.fetchall()], names)


# 1


def removed_words(texts):
    """Kept text and words removed of each row, by looking at every window."""
    rows = [(2**63 - 1 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    first = {}
    for i, w in rows:
        for p in range(len(w) - 19):
            run = tuple(w[p : p + 20])
            first[run] = min(first.get(run, (i, p)), (i, p))
    out = []
    for i, w in rows:
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] < (i, p):
                gone |= set(range(p, p + 20))
        out.append((str(i), str(len(w)), str(len(gone)), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("bucket", [substrings.BUCKET_BYTES, 2000])
def test_substrings_equal_brute_force(docs, bucket, monkeypatch):
    found = substrings.deduplicate(docs, bucket).withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    assert told(found.collect(), ["doc_id", "n_words", "n_removed", "kept"]) == removed_words(awkward())


def test_substring_spans_are_maximal(spark):
    run = " ".join(f"w{i}" for i in range(30))
    found = substrings.deduplicate(rows_of(spark, [(1, f"a b {run} c"), (2, f"{run} d")])).where("doc_id = 2").first()
    assert [(s.start, s.end) for s in found.spans] == [(0, 30)]
    assert found.kept == "d"


def test_substrings_of_random_texts(spark):
    rng = random.Random(11)
    for trial in range(2):
        pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(15, 60))) for _ in range(6)]
        texts = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 4)))) for i in range(25)]
        assert told(substrings.deduplicate(rows_of(spark, texts), 500).collect(), ["doc_id", "n_words", "n_removed", "kept"]) == removed_words(texts)


def test_substrings_tell_words_apart(spark):
    """A Thue-Morse word and its complement have one name under any polynomial modulo a power of two."""
    word, other = "a", "b"
    for _ in range(10):
        word, other = word + other, other + word
    lead = " ".join(f"w{k}" for k in range(20))
    texts = [(1, f"{lead} {word}"), (2, f"v {lead[3:]} {other}"), (3, f"x {lead[3:]} {word}")]
    found = substrings.deduplicate(rows_of(spark, texts))
    assert told(found.collect(), ["doc_id", "n_words", "n_removed", "kept"]) == removed_words(texts)
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: 0, 3: 20}


@pytest.mark.parametrize("first,second", [(-5, None), (-(2**62), 2**62), (-(2**63), None), (5, None)])
def test_substrings_of_distant_ids(spark, first, second):
    run = " ".join(f"w{k}" for k in range(40))
    texts = [(second, run + " b"), (first, "a " + run)]
    found = substrings.deduplicate(rows_of(spark, texts), 100).withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    assert told(found.collect(), ["doc_id", "n_words", "n_removed", "kept"]) == removed_words(texts)
    assert {r.n_removed for r in found.collect()} == {0, 40}


def test_substrings_of_rows_repeated_whole(spark, monkeypatch):
    """Rows that are repeated whole go to several homes and count as one."""
    monkeypatch.setattr(substrings, "TOGETHER", 2)
    run = " ".join(f"w{k}" for k in range(30))
    texts = [(4, run)] * 40 + [(9, "a " + run)]
    found = substrings.deduplicate(rows_of(spark, texts), 200).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(4, 0)] * 40 + [(9, 30)]


def test_names_of_runs():
    names = arrow_text.word_names([b"a b c a b c d", b"", b"a b c"])
    assert names.shape == (10, 2)
    assert (names[:3] == names[7:]).all()
    for n in (1, 2, 3, 5, 7, 10):
        runs = arrow_text.run_names(names[:, 0], n)
        assert len(runs) == 11 - n
        assert n > 3 or (runs[0] == runs[3]) == (runs[0] == runs[7]) == True  # noqa: E712
        assert len(set(runs.tolist())) == len({tuple(names[i : i + n, 0].tolist()) for i in range(11 - n)})
    assert len(arrow_text.run_names(names[:2, 0], 5)) == 0


@pytest.mark.parametrize("shared_id", [None, 7])
def test_substrings_of_rows_that_share_an_id(spark, shared_id):
    own = lambda c: " ".join(f"{c}{k}" for k in range(30))
    run = own("r")
    texts = [
        (1, run), (shared_id, run + " " + own("a")), (shared_id, own("b") + " " + own("c")), (shared_id, own("d") + " " + own("e")),
        (shared_id, own("d") + " " + own("f"))
    ]
    found = sorted(r.kept for r in substrings.deduplicate(rows_of(spark, texts)).collect())
    first = [run, own("a"), own("b") + " " + own("c")]
    # of the last two, which repeat at the same place, one keeps the run
    assert found in (sorted([*first, own("d") + " " + own("e"), own("f")]), sorted([*first, own("e"), own("d") + " " + own("f")]))


# 2


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def parsed(text):
    """Names of the phrases of each level, by loops over symbols."""
    levels, symbols = [], [b + 1 for b in text.encode()]
    while symbols and (not levels or len(levels[-1]) > 1):
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        x = [mixed((s + n * 0x9E3779B97F4A7C15) % 2**64) for s, n in runs]
        label, width = list(x), 2**64
        for _ in range(5):
            new = []
            for i, v in enumerate(label):
                differ = v ^ (label[i - 1] if i else ~v % width)
                bit = (differ & -differ).bit_length() - 1
                new.append(2 * bit + (v >> bit & 1))
            label, width = new, 256
        start = [i for i in range(len(x)) if i == 0 or (i + 1 < len(x) and label[i] > label[i - 1] and label[i] > label[i + 1])]
        symbols = []
        for i, j in zip(start, [*start[1:], len(x)]):
            symbols.append(mixed(sum(x[k] * pow(0x9E3779B97F4A7C15, k - i + 1, 2**64) for k in range(i, j)) % 2**64))
        levels.append(symbols)
    return levels


def fingerprint_by_hand(text):
    levels, out = parsed(text), [255] * 64
    factors = fingerprints._FACTORS.tolist()
    for k in range(64):
        lowest, highest = (1, 1) if k < 6 else (2, 2) if k < 20 else (3, 1000)
        names = [mixed((s + n) % 2**64) for n, level in enumerate(levels, 1) if lowest <= n <= highest for s in level]
        if names:
            out[k] = mixed(min((s * factors[0][k] + factors[1][k]) % 2**64 >> 20 for s in names)) >> 56
    return bytes(out)


def likeness_by_hand(a, b):
    shares = [(a[i:j], b[i:j]) for i, j in ((0, 6), (6, 20), (20, 64)) if set(a[i:j]) != {255} and set(b[i:j]) != {255}]
    if not shares:
        return float(a == b)
    same = sum(x == y for p, q in shares for x, y in zip(p, q)) / sum(len(p) for p, _ in shares)
    return min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


@pytest.mark.parametrize("extra", [[], [(6, "another text with the id six"), (6, "x"), (None, "zz top"), (None, None), (-3, "a" * 700)]])
def test_fingerprints_equal_an_independent_parse(spark, extra):
    """Every row, those with one id and those without one too: they are in order of a hash of their text."""
    rows = [x for x in awkward() if x[0] != 9] + extra
    tie = lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "big", signed=True)
    order = sorted(rows, key=lambda x: (2**63 - 1 if x[0] is None else x[0], tie(x[1])))
    texts, want = [t or "" for _, t in order], []
    for k, (i, _) in enumerate(order):
        own, after = texts[k], texts[(k + 1) % len(texts)]
        changed = fingerprints.edited(own, after)
        a, b, c = map(fingerprint_by_hand, (own, changed, after))
        want.append((
            str(i), len(own), hashlib.sha256(changed.encode()).hexdigest(), a.hex(), b.hex(), round(likeness_by_hand(a, b), 9),
            round(likeness_by_hand(a, c), 9)
        ))
    found = fingerprints.compare_neighbours(rows_of(spark, rows)).collect()
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    assert sorted(got) == sorted(want)


def test_likeness_has_no_step_in_length():
    """Texts that differ in their last two characters are near at every length, more so the longer they are."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8)))
    for low, high, least in ((40, 80, 0.35), (380, 420, 0.7), (1980, 2020, 0.85)):
        near = []
        for _ in range(8):
            text = " ".join(word() for _ in range(900))
            for n in range(low, high, 5):
                near.append(float(fingerprints.likeness(*(fingerprints._sketches([text[:k]]) for k in (n - 1, n + 1)))[0]))
        assert np.mean(near) > least
        assert np.min(near) > least - 0.35


def test_long_texts_are_parsed_to_one_symbol():
    """A text of more than twelve levels, whose upper ones count too."""
    rng = random.Random(13)
    text = " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(40000))
    levels = parsed(text)
    assert len(levels) > 12 and len(levels[-1]) == 1
    assert fingerprints._sketches([text])[0].tobytes() == fingerprint_by_hand(text)


def test_equal_substrings_share_their_interior():
    rng = random.Random(4)
    inner = "".join(rng.choice("abcdefghij ") for _ in range(3000))

    def names(text):
        symbols, owner = np.frombuffer(text.encode(), np.uint8).astype(np.uint64) + np.uint64(1), np.zeros(len(text), np.int32)
        for _ in range(3):
            symbols, owner = fingerprints._phrases(symbols, owner)
        return symbols.tolist()

    for offset in (1, 2, 3, 7, 50):
        lead = "".join(rng.choice("klmnop ") for _ in range(offset))
        a, b = names(inner), names(lead + inner)
        assert len(set(a) & set(b)) >= len(set(a)) - 6


def test_likeness_follows_what_is_shared():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8)))
    a, b = " ".join(word() for _ in range(600)), " ".join(word() for _ in range(600))
    half = a[: len(a) // 2] + b[len(b) // 2 :]
    s = fingerprints._sketches([a, b, half, a])
    near = lambda i, j: float(fingerprints.likeness(s[i : i + 1], s[j : j + 1])[0])
    assert near(0, 3) == 1.0
    assert near(0, 1) < 0.05
    assert 0.15 < near(0, 2) < 0.55


# 3 and 8


def test_network_gradients():
    net, rng = toxicity.Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["word"][:] = rng.normal(size=net.p["word"].shape) * 0.3
    words = toxicity.read_words([b"abc de fghij k the cat", b"xx yy", b""])
    _, first, n = toxicity.window_starts(words.length, 8, 6)
    number, weight = toxicity.window_words(words, first, n, 8), np.arange(1, len(first) + 1)
    kept = {}
    inputs = net.inputs(words)
    net.forward(inputs, number, kept)
    grads = net.backward(words, inputs, number, kept, weight.astype(np.float32))
    loss = lambda: float((net.forward(net.inputs(words), number) * weight).sum())
    for name, value in net.p.items():
        at = np.unravel_index(np.argmax(np.abs(grads[name])), value.shape)
        keep = value[at]
        value[at] = keep + 1e-2
        up = loss()
        value[at] = keep - 1e-2
        down = loss()
        value[at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, rel=0.02, abs=1e-4)


def test_windows_cover_every_word():
    length = np.array([0, 1, 32, 33, 56, 57, 500])
    owner, first, n = toxicity.window_starts(length)
    begin = np.cumsum(length) - length
    for i, size in enumerate(length):
        own = owner == i
        covered = {w for f, k in zip(first[own] - begin[i], n[own]) for w in range(f, f + k)}
        assert covered == set(range(size))
        assert own.sum() >= 1


def _labelled(spark, n=160):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        bad = i % 2
        if bad:
            t[rng.randrange(len(t))] = "zzyx!!"
            t.insert(rng.randrange(len(t)), "qqqw!!")
        texts.append((i, " ".join(t)))
        labels.append((i, 1 - bad, bad))
    return rows_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers_on_held_out_rows(spark, docs, empty, kind):
    module = toxicity if kind == "toxic" else quality
    train, labels = _labelled(spark)
    model = module.train(train, labels)
    got = module.score(train, model).where("held_out").join(labels, "doc_id").select(F.col(kind).alias("y"), "score", "doc_id").collect()
    assert got
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5) == 0 for r in got)
    ones, zeros = [r.score for r in got if r.y == 1], [r.score for r in got if r.y == 0]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.9
    scored = module.score(docs, model)
    assert scored.count() == len(awkward())
    assert scored.where("score between 0 and 1 and predicted in (0, 1)").count() == len(awkward())
    assert module.score(empty, model).count() == 0
    one = module.train(train, labels.where(F.col(kind) == 1))
    assert module.score(train, one).where("predicted = 0").count() == 0
    none = module.train(train, labels.limit(0))
    assert module.score(train, none).count() == 160
    assert module.train(empty, labels) is not None


def test_equal_texts_have_equal_scores(spark):
    """However rows are batched."""
    train, labels = _labelled(spark)
    model = toxicity.train(train, labels)
    texts = [r.text for r in train.select("text").collect()]
    many = rows_of(spark, [(i, t) for i, t in enumerate(texts + ["a b", ""] + texts[::-1] + texts[:7])])
    scores = {}
    for parts in (1, 3, 7):
        for r in toxicity.score(many.repartition(parts), model).join(many.select("doc_id", "text"), "doc_id").collect():
            scores.setdefault(r.text, set()).add(r.score)
    assert all(len(x) == 1 for x in scores.values())


def test_toxicity_of_held_out_rows_of_the_large_table(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    known = labels.where(labelled.held_out("doc_id"))
    scored = toxicity.score(docs.join(known.select("doc_id"), "doc_id"), toxicity.train(docs, labels))
    rows = scored.join(known, "doc_id").select("score", "toxic").collect()
    toxic, clean = ([r.score for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 80 and len(clean) > 600
    assert sum(x >= 0.5 for x in toxic) >= 0.85 * len(toxic)
    assert sum(x >= 0.5 for x in clean) <= 0.04 * len(clean)


def test_long_texts_are_sampled_in_passages(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    docs = rows_of(spark, [(1, text), (2, text[:500]), (3, None), (4, "é" * 2000)])
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)], "doc_id long, toxic int")
    found = {r.doc_id: r.text for r in labelled.labelled_sample(docs, labels, "toxic", 10, 640).collect()}
    assert found[2] == text[:500] and found.get(3, "") == ""
    assert len(found[1]) <= 640 and found[1].startswith("w0 w1 ") and found[1].endswith("w4999") and "w2" in found[1][300:340]
    assert set(found[4]) == {"é", " "} and len(found[4]) <= 640


def plain_logit(net, words):
    """The network's logit of one window by loops over words, in double precision."""
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        name = arrow_text.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
        edged, own = b" " + word + b" ", np.zeros(toxicity.EMBEDDED)
        grams = [edged[i : i + n] for n in toxicity.GRAMS for i in range(len(edged) - n + 1)]
        for g in grams:
            number = np.array([int.from_bytes(g, "little") + (len(g) << 56)], np.uint64)
            own = own + p["char"][toxicity._bucket(number, toxicity.CHAR_BITS)[0]]
        return np.concatenate([p["word"][toxicity._bucket(name, toxicity.WORD_BITS)[0]], own / np.sqrt(max(1, len(grams)))])

    x = [vector(w) for w in words]
    both = {}
    for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        state, both[side] = np.zeros(h), {}
        for t in order:
            a, u = x[t] @ p["W" + side] + p["c" + side], state @ p["U" + side]
            z, r = sig(a[:h] + u[:h]), sig(a[h : 2 * h] + u[h : 2 * h])
            state = (1 - z) * np.tanh(a[2 * h :] + r * u[2 * h :]) + z * state
            both[side][t] = state
    states = [np.concatenate([both["f"][t], both["b"][t]]) for t in range(len(x))]
    weight = np.exp([np.tanh(s @ p["Wa"] + p["ba"]) @ p["va"] for s in states])
    return float(sum(w * s for w, s in zip(weight, states)) / weight.sum() @ p["wo"] + p["bo"][0])


def test_toxicity_scores_equal_a_plain_forward_pass(spark):
    train, labels = _labelled(spark)
    net = toxicity.train(train, labels)
    rows = {r.doc_id: r for r in toxicity.score(train, net).collect()}
    for r in train.limit(25).collect():
        words = r.text.lower().encode().split()
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        logit = max(plain_logit(net, words[i : i + toxicity.WINDOW]) for i in starts)
        assert rows[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-logit)), abs=2e-4)


def test_samples_are_full_and_bounded(spark):
    docs = rows_of(spark, [(i, "x" * (9000 if i % 2 else 10)) for i in range(400)] + [(2, f"copy {k}") for k in range(50)])
    labels = spark.createDataFrame([(i, i % 3 // 2) for i in range(400)] + [(4, 0), (4, 1)], "doc_id long, toxic int")
    rows = labelled.labelled_sample(docs, labels, "toxic", 30, 100).collect()
    assert sorted(r.y for r in rows) == [0] * 30 + [1] * 30
    assert all(len(r.text) <= 100 for r in rows)
    everything = labelled.labelled_sample(docs, labels, "toxic", 10**6).collect()
    assert len(everything) == len({r.doc_id for r in everything})
    assert 4 not in {r.doc_id for r in everything}


def test_features_are_plain_ngrams(spark):
    rng = random.Random(4)
    for n in (0, 1, 3, 40, 90000):
        text = "".join(rng.choice("abcdé 7\n.X") for _ in range(n)).encode()
        found = quality.features(text)
        trigrams = {int.from_bytes(text[i : i + 3], "big") + (1 << 32) for i in range(len(text) - 2)}
        words = text.split()
        name = lambda w: int(arrow_text.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
        names = [name(w) for w in words]
        kind = lambda c: 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
        shapes = [kind(w[0]) << 16 | kind(w[-1]) << 8 | min(len(w), 15) >> 1 << 1 | (i > 0 and words[i - 1] == w) for i, w in enumerate(words)]
        want = trigrams | set(names) | {x | 1 << 40 for x in shapes} | {a << 24 | b | 1 << 50 for a, b in zip(shapes, shapes[1:])}
        want |= {(a * 0x9E3779B97F4A7C15 + b + 7) % 2**64 for a, b in zip(names, names[1:])}
        numbers = arrow_text.mix64(np.array(sorted(want), np.uint64)) >> np.uint64(64 - quality.BITS)
        assert found.tolist() == sorted(set(numbers.tolist()))
        assert (quality.unpack_features(quality.pack_features(found)) == found).all()


def test_hinge_fit_is_the_primal_optimum():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(60, 12, replace=False)) for _ in range(80)]
    y = rng.integers(0, 2, 80)
    ratio = np.zeros(quality.BUCKETS)
    ratio[:60] = rng.normal(size=60)
    weight, intercept = quality.fit_hinge(rows, y, ratio, sweeps=3000)
    x = np.zeros((80, 61))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    x[:, 60] = 1  # the intercept is a weight as any other
    sign, cost = np.where(y == 1, 1.0, -1.0), 0.5 / np.where(y == 1, (y == 1).mean(), (y == 0).mean())
    w = np.append(weight[:60], intercept)
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (x @ w)) ** 2).sum()
    slope = w - x.T @ (2 * cost * sign * np.maximum(0, 1 - sign * (x @ w)))
    assert abs(slope).max() < 0.05  # of the gradient, against some 10 at zero
    assert all(loss(w) <= loss(w + 0.02 * rng.normal(size=61)) for _ in range(200))


def test_quality_keeps_all_columns(spark):
    train, labels = _labelled(spark)
    kept = quality.keep(train, quality.train(train, labels))
    assert kept.columns == train.columns
    assert 60 <= kept.count() <= 100


# 4

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(s):
        return sum(v - 9 if (v := int(c) * (1 + k % 2)) > 9 else v for k, c in enumerate(reversed(s))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    holds = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15
    }
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(
        (m.start(), n, k, m.end()) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if holds[k](m.group())
    ))


def private_texts():
    rng = random.Random(3)
    parts = [
        "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "7536784127813050 4845168114407329", "+1 (017) 555-7713", "+4 9",
        "+123456789012345678", "1.2.3.4", "999.1.2.3.4", "1.2.3.256", "01.002.3.4.5.6.7.8", "a@b.c", "a@b.c_d@e.f", "x.y%z@mail-1.example.com.",
        "@no", "a@b", "\U0001f600", "über@x.de", "5-5-5", "..", " ", "-", "tel", "1 1 1 1 1 1 1 1 1 1 1 1 1 1"
    ]
    texts = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "x", ", ", "-"]) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    return [
        *texts, (900, "1.2.3.4 " * 3000), (901, "a" * 200000), (902, "b@" + "c." * 30000 + "d"), (903, "9 " * 40000), (904, "+1" + " " * 50000),
        (905, None)
    ]


def test_base_spans_equal_plain_patterns(spark):
    texts = private_texts()
    found = pii.base_spans(rows_of(spark, texts)).select("doc_id", pii.listed("base").alias("s"))
    want = {i: plain_spans(t or "") for i, t in texts}
    assert {r.doc_id: r.s for r in found.collect()} == want


def disclosed_by_hand(texts, support=pii.SUPPORT, least=pii.GENERALISE):
    """(kind, entity, term) whose share reaches the threshold, with plain loops over the different texts."""
    seen, entities, n_t, held, contexts_of = {}, {}, {}, {}, {}
    different = {t or "" for _, t in texts}
    for t in different:
        for term in {w.lower() for w in re.split(r"[\W_]+", t) if len(w) >= 3}:
            n_t[term] = n_t.get(term, 0) + 1
    for t in different:
        for s in filter(None, plain_spans(t).split(",")):
            kind, a, b = s.split(":")
            left, right = t[: int(a)], t[int(b) :]
            left = left if len(left) < pii.REACH else re.sub(r"^[^\W_]+", "", left[-pii.REACH :])
            right = right if len(right) < pii.REACH else re.sub(r"[^\W_]+$", "", right[: pii.REACH])
            value, context = t[int(a) : int(b)].lower(), (left.lower(), right.lower())
            for term in re.split(r"[\W_]+", left) + re.split(r"[\W_]+", right):
                if len(term) >= 3 and term[0].isalpha():
                    key = (kind, value, term.lower())
                    seen.setdefault(key, set()).add(context)
                    held.setdefault(key, set()).add(t)
                    entities.setdefault(key[:2], set()).add(t)
                    contexts_of.setdefault(key[:2], set()).add(context)
    out, n = set(), len(different)
    for (kind, value, term), where in seen.items():
        n_e, n_et = len(entities[kind, value]), len(held[kind, value, term])
        if len(where) >= support and len(contexts_of[kind, value]) >= support and n > n_e:
            share = np.log2(n_et * n / (n_e * max(n_t.get(term, 0), n_et))) / np.log2(n / n_e)
            if share >= least:
                out.add((kind, value, term))
    return out


@pytest.mark.parametrize("copies", [1, 20])
def test_copies_hide_no_disclosing_term(spark, copies):
    """The terms are the same whether each text is there once or often, as are those that begin with a digit."""
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    private = [f"{line(4)} Quillon {line(3)} 3abc q.zed@mail.example {line(2)} 4Vexford İzmir {line(4)}" for _ in range(5)]
    texts = [(i, line(30) + " abc") for i in range(200)] + [(1000 + k, t) for k, t in enumerate(private * copies)]
    spans = pii.find(rows_of(spark, texts)).select("doc_id", F.explode("spans").alias("s")).where("s.kind = 'term'")
    by_id = dict(texts)
    found = {by_id[r.doc_id][r.s.start : r.s.end].lower() for r in spans.collect()}
    assert found == {t for _, _, t in disclosed_by_hand(texts)}
    assert "quillon" in found
    assert not {"abc", "vexford", "3abc"} & found
    assert spans.where("doc_id >= 1000").count() == copies * spans.where("doc_id between 1000 and 1004").count()


def test_disclosing_terms_equal_plain_loops(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [(i, line(30)) for i in range(200)]
    texts += [(300 + i, f"{line(20)} Quillon {line(3)} q.zed@mail.example {line(2)} Vexford {line(20)}") for i in range(5)]
    texts += [(400 + i, f"{line(10)} plain@mail.example {line(10)}") for i in range(2)]
    docs = rows_of(spark, texts)
    found = pii.find(docs)
    terms = {(r.doc_id, r.s.start, r.s.end) for r in found.select("doc_id", F.explode("spans").alias("s")).where("s.kind = 'term'").collect()}
    by_id, want = dict(texts), disclosed_by_hand(texts)
    assert {("email", "q.zed@mail.example", "quillon"), ("email", "q.zed@mail.example", "vexford")} <= want
    assert {by_id[i][a:b].lower() for i, a, b in terms} == {t for _, _, t in want}
    assert {i for i, *_ in terms} == {300 + i for i in range(5)}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[300]
    assert "Quillon" not in clean[300]
    assert "Vexford" not in clean[304]
    assert "[EMAIL]" in clean[400]
    assert all(clean[i] == by_id[i] for i in range(200))


def test_private_data_equals_sql_where_terms_disclose(spark, tmp_path):
    """The query against its SQL on texts with every kind of span, with terms, copies and awkward rows."""
    rng = random.Random(14)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    private = [f"{line(9)} Quillon {line(3)} +1 (017) 555-7713 {line(2)} Vexford_x {line(20)}" for _ in range(4)]
    texts = private_texts()[:304] + [(1000 + i, line(30)) for i in range(200)] + [(2000 + i, t) for i, t in enumerate(private * 3)] + awkward()
    rows_of(spark, texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cursor = db.execute(queries.OP4_SQL)
    names = [d[0] for d in cursor.description]
    found = NAMES["op4_pii"](spark, str(tmp_path))
    want = told([dict(zip(names, r)) for r in cursor.fetchall()], names)
    assert told(found.collect(), names) == want
    assert sum("term:" in r[names.index("spans")] for r in want) >= 12


def disclosing_places_by_hand(texts, support=pii.SUPPORT, least=pii.GENERALISE):
    """(doc_id, start, end) of terms that disclose an entity which stands anywhere in the same text, with plain loops over the different texts."""
    spans = {t: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in plain_spans(t).split(",") if s)] for t in {t or "" for _, t in texts}}
    runs = {t: [(m.group().lower(), *m.span()) for m in re.finditer(r"[^\W_]+", t) if len(m.group()) >= 3 and m.group()[0].isalpha()] for t in spans}
    digits = lambda s: re.sub("[^0-9]", "", s)
    entities = {t: {(k, digits(t[a:b]) if k in ("card", "phone") else t[a:b].lower()) for k, a, b in found} for t, found in spans.items()}
    terms, n = {t: {w for w, *_ in found} for t, found in runs.items()}, len(spans)
    n_t, n_e = Counter(w for found in terms.values() for w in found), Counter(e for found in entities.values() for e in found)
    n_et = Counter((e, w) for t in spans for e in entities[t] for w in terms[t])
    strong = {
        (e, w) for (e, w), both in n_et.items()
        if both >= support and n > n_e[e] and np.log2(both * n / (n_e[e] * n_t[w])) / np.log2(n / n_e[e]) >= least
    }
    return {
        (i, a, b) for i, t in texts for w, a, b in runs[t or ""]
        if any((e, w) in strong for e in entities[t or ""]) and not any(x < b and a < y for _, x, y in spans[t or ""])
    }


@pytest.mark.parametrize("paired", [1, 64])
def test_terms_anywhere_in_a_text_equal_plain_loops(spark, monkeypatch, paired):
    """Also with more sets of entities than meet one part of a text's terms."""
    monkeypatch.setattr(pii, "_PAIRED", paired)
    rng = random.Random(21)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    people = [(f"p{k}@mail.example", f"+1 (017) 555-77{k:02}", f"10.0.{k}.1") for k in range(8)]
    texts = [(i, line(30)) for i in range(200)]
    for i in range(40):
        own = [x for k in rng.sample(range(8), 3) for x in [*rng.sample(people[k], 2), f"Name{k}", f"Town{k}" if rng.random() < 0.8 else "Elsewhere"]]
        rng.shuffle(own)
        texts.append((300 + i, " ".join(f"{line(rng.choice([2, 30]))} {x}" for x in own)))
    texts += [(500 + i, texts[-1][1]) for i in range(5)] + [(600, None), (601, ""), (None, texts[-1][1])]
    spans = pii.find(rows_of(spark, texts)).select("doc_id", F.explode("spans").alias("s")).where("s.kind = 'term'").collect()
    want = disclosing_places_by_hand(texts)
    assert {(r.doc_id, r.s.start, r.s.end) for r in spans} == want
    assert len(spans) == len(want) >= 40


def test_the_pipeline_looks_for_terms_in_whole_texts(spark):
    """Beyond the reach of operator 4's SQL, and behind other matches of the kind."""
    import corpus_pipeline

    rng = random.Random(22)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [(i, line(60)) for i in range(200)]
    texts += [(300 + i, f"Quillon {line(60)} q.zed@mail.example {line(2)} other{i}@mail.example Vexford {line(60)} Yarrowby") for i in range(5)]
    clean = {r.doc_id: r.text for r in corpus_pipeline.personal_data_stage(spark, rows_of(spark, texts), "").collect()}
    assert [w for i in range(300, 305) for w in ("Quillon", "Vexford", "Yarrowby") if w in clean[i]] == []
    assert all(clean[i] == t for i, t in texts[:200])


def test_private_data_on_awkward_rows(docs, empty):
    assert pii.find(docs).count() == len(awkward())
    assert pii.find(empty).count() == 0
    kept = pii.sanitise(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(awkward())


def test_sanitised_rows_keep_columns_of_any_name(spark):
    names = ["_spans", "_doc", "_h", "spans", "h", "row", "found", "start", "base", "_row"]
    text = "write to ann@example.org today"
    docs = spark.createDataFrame([(1, text, *range(10)), (None, None, *range(10))], ["doc_id", "text", *names])
    found = pii.sanitise(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "write to [EMAIL] today", *range(10)), (None, None, *range(10))], key=str)


def test_copies_are_no_evidence(spark):
    texts = [(i, "Quillon writes from a@b.example about Vexford") for i in range(20)] + [(50 + i, "other words here " + "abc " * i) for i in range(100)]
    spans = pii.find(rows_of(spark, texts)).select(F.explode("spans").alias("s")).where("s.kind = 'term'")
    assert spans.count() == 0


# 5 and 10


def test_byte_bpe_equals_the_library(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    want = sorted((str(i), str(library.encode_ordinary(t or "")), str((t or "").encode())) for i, t in awkward())
    assert sorted((str(r.doc_id), str(r.ids), str(bytes(r.decoded))) for r in found.collect()) == want
    assert bpe.encode_texts(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_remembered_pre_tokens_are_bounded_by_bytes(monkeypatch):
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, simple=True)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 20000)
    rng = random.Random(3)
    for k in range(60):
        text = " ".join("".join(rng.choice("abcdexyz") for _ in range(rng.choice([3, 9, 90]))) for _ in range(20))
        assert codec.encode(text) == library.encode_ordinary(text)
        assert len(codec.known) < 120 and max(map(len, codec.known)) <= bpe.SHORT


def test_minimal_hash_is_minimal_and_perfect():
    ranks = bpe.read_ranks(RANKS)
    table = bpe.MinimalHash(list(ranks), list(ranks.values()))
    assert sorted(table.tokens) == sorted(ranks)
    assert all(table.find(t) == r for t, r in list(ranks.items())[::17])
    assert table.find(b"certainly not one token of the table") == -1
    assert bpe.MinimalHash([], []).find(b"a") == -1


def test_patterns_agree_on_odd_characters():
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, simple=True)
    slow = bpe.Codec(codec.ranks, public_tokenizers.PATTERN, simple=False)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice([chr(rng.randrange(0x250)), "a", " ", "'", "\n", "7", "中"]) for _ in range(40))
        assert codec.pieces(text) == slow.pieces(text)


def test_token_counts_equal_the_library(docs, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = token_counts.count_tokens(docs, PIECES)
    want = sorted((str(i), str(len((t or "").encode())), str(len(model.encode(t or "")))) for i, t in awkward())
    assert told(found.collect(), ["doc_id", "n_bytes", "n_tokens"]) == want
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_calls_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_counts, "CALL_BYTES", 100)
    pieces = ["a" * 40, "中" * 20, "b" * 30, "ü" * 200, "", "c"]
    runs = list(token_counts._calls(pieces))
    assert runs == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_cuts_change_no_count():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.cut_is_safe(model)
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["ab", " ", "  ", "▁", "中", "the", "\n", "<s>", "x"]) for _ in range(200))
        for size in (5, 40):
            assert sum(len(model.encode(x)) for x in token_counts.cut(text, size)) == len(model.encode(text))


# 6


def hit_by_hand(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    runs = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            runs.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for run, own in runs.items():
            for k in range(len(w) - len(run) + 1):
                if tuple(w[k : k + len(run)]) == run:
                    hit |= set(range(k, k + len(run)))
                    found |= own
        out.append((str(i), str(len(w)), str(len(hit)), str(sorted(str(x) for x in found if x is not None))))
    return sorted(out)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_contamination_equals_brute_force(spark, docs, block):
    shared = awkward()[5][1]
    items = [
        (1, shared), (2, "one"), (3, None), (4, "!!"), (5, "Alpha, BETA"), (None, " ".join(shared.split()[5:20])), (1, "über"),
        (7, " ".join(shared.split()[:10])), (8, "a a a")
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [x for x in awkward() if len(x[1] or "") < 20000]
    found = decontaminate.find_contamination(docs.where("doc_id is null or doc_id not in (9, 10)"), benchmark, block)
    texts = [x for x in texts if x[0] != 9]
    assert told(found.withColumn("items", F.col("items")).collect(), ["doc_id", "n_words", "n_hit", "items"]) == hit_by_hand(texts, items)


def test_buckets_hold_the_patterns_of_one_suffix():
    rng = random.Random(9)
    patterns = sorted({("x" * rng.randrange(9) + " " + " ".join(rng.choice(WORDS) for _ in range(5)) + " ").encode() for _ in range(300)})
    search = decontaminate.WuManber(patterns)
    place = {int(i): k for k, i in enumerate(search.order)}
    for i, pattern in enumerate(patterns):
        tail = np.frombuffer(pattern[search.m - search.block : search.m].ljust(8, b"\0"), "<u8")
        h = int(search._hash(tail)[0])
        low, high = search.bucket[h >> search.coarse], search.bucket[(h >> search.coarse) + 1]
        assert search.shift[h] == 0 and low <= place[i] < high
        assert (np.diff(search.begins[low:high].astype(object)) >= 0).all()
    assert search.bucket[-1] == len(patterns) and len(search.bucket) <= 4 * len(patterns) + 1


def test_search_in_many_common_patterns():
    """Stop words against thousands of patterns of stop words, with a short item: bounded slices, all occurrences, little memory."""
    import resource

    rng = random.Random(4)
    stop = "the of and to a in is it for on".split()
    line = lambda n: " ".join(rng.choice(stop) for _ in range(n))
    own = [line(12) for _ in range(5000)]
    items = decontaminate.Items([(str(k), x.encode()) for k, x in enumerate(own)] + [("short", b"zz the of and")])
    text = decontaminate.joined(decontaminate.words_of((line(30000) + " zz the of and " + " ".join(own[::50])).encode()))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    at, number = items.hits(text)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    keys = {k: i for s, own in items.searches for i, k in zip(own.tolist(), s.patterns)}
    blanks = [i for i in range(len(text)) if text[i] == 32]
    want = set()
    for k, i in enumerate(blanks):
        for words in (4, 10):
            if k + words < len(blanks) and (p := keys.get(text[i : blanks[k + words] + 1])) is not None:
                want.add((i, p))
    assert set(zip(at.tolist(), number.tolist())) == want
    assert len(at) == len(want) > 300


def test_a_benchmark_of_many_blocks(spark, docs):
    """Repeated items count once for a block's size, and blocks keep within theirs."""
    items = [(k, f"alpha w{k} " + "x" * 50) for k in range(40)] * 30 + [(99, "alpha beta")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate._blocks(benchmark, 500))
    assert sorted(int(i) for _, b in blocks for i, _ in b) == [*range(40), 99]
    assert all(sum(len(t) for _, t in b) <= 500 for _, b in blocks)


def test_contamination_without_items(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).where("n_hit > 0").count() == 0
    some = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert decontaminate.find_contamination(empty, some).count() == 0
    kept = decontaminate.clean(docs, some)
    hit = decontaminate.find_contamination(docs, some).where("n_hit = 0").count()
    assert (kept.columns, kept.count()) == (docs.columns, hit)


# 7


def test_archives_come_back(spark, tmp_path):
    big = "<p>" + "x" * 1200
    pages = [
        (1, "http://a/b c\n", big, 1), (2, None, big, 1), (3, "u", "small", 1), (4, "u", "small", 1), (5, "u", None, 1), (None, "n", big, 1),
        (7, "u", "ü" * 600, 1), (8, "u", "", 1), (2, None, big, 1)
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload_digest int")
    found = {(r.page_id, r.payload_bytes): r for r in warc.round_trip(spark, df).collect()}
    assert found[(1, 1203)].record_type == "revisit"
    assert found[(1, 1203)].refers_to == 2
    assert found[(2, 1203)].record_type == "response"
    assert found[(3, 5)].record_type == found[(4, 5)].record_type == "response"
    assert found[(None, 1203)].record_type == "response"
    assert found[(7, 1200)].payload_digest == hashlib.sha1(("ü" * 600).encode()).hexdigest()
    assert bytes(found[(2, 1203)].payload).decode() == big
    assert warc.round_trip(spark, df).count() == len(pages)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_archives_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    pages = spark.range(40).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 700).alias("html")
    ).repartition(2)
    folder = "file://" + str(tmp_path)
    files = warc.write_archives(pages, folder).cache()
    assert files.count() > 8
    found = warc.read_archives(files, folder)
    assert found.rdd.getNumPartitions() == min(files.count(), 8 * spark.sparkContext.defaultParallelism)
    assert found.groupBy(F.spark_partition_id()).count().count() > 4
    assert found.count() == 40


def test_many_empty_pages_are_dealt_out(spark):
    """Pages without content share a digest; no task gets them all."""
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("html"))
    folder = warc.fresh_dir(spark, "warc")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = [r.records for r in warc.write_archives(pages, folder).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(records) == 4000
    assert max(records) < 2000


def test_a_very_long_page_comes_back(spark):
    long = "<p>" + "".join(chr(97 + k % 26) for k in range(3 << 20))
    df = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "x")], "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.round_trip(spark, df).collect()}
    assert bytes(found[2].payload).decode() == long
    assert (found[1].record_type, found[1].refers_to, found[1].payload_bytes) == ("revisit", 2, len(long))


def test_broken_archives_are_noticed():
    import io

    good = warc.pack(1, "http://a", b"payload") + warc.pack(2, None, b"")
    assert [warc.parse(m)["page_id"] for m in warc.members(io.BytesIO(good), 7)] == [1, 2]
    with pytest.raises(warc.WarcError, match="ends within"):
        list(warc.members(io.BytesIO(good[:-5])))
    with pytest.raises(warc.WarcError, match="not a gzip"):
        list(warc.members(io.BytesIO(b"plain text")))
    member = next(warc.members(io.BytesIO(good)))
    with pytest.raises(warc.WarcError, match="digest"):
        warc.parse(member.replace(b"payload\r\n\r\n", b"payl0ad\r\n\r\n"))
    with pytest.raises(warc.WarcError, match="Content-Length"):
        warc.parse(member + b"x")


# 9


def print_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


@pytest.mark.parametrize("group", [simhash.GROUP, 2])
def test_near_duplicates_equal_brute_force(docs, group):
    found = simhash.near_duplicates(docs, group).collect()
    texts = awkward()
    prints = [print_by_hand(t) for _, t in texts]
    roots = components_by_hand(prints)
    least = {r: min(i for (i, _), q in zip(texts, roots) if q == r and i is not None) if any(i is not None for (i, _), q in zip(texts, roots) if q == r) else None for r in roots}
    want = sorted((str(i), str(p if p < 1 << 63 else p - (1 << 64)), str(least[r])) for (i, _), p, r in zip(texts, prints, roots))
    assert told(found, ["doc_id", "fp", "component_id"]) == want


@pytest.mark.parametrize("group", [1024, 3, 1])
def test_links_lose_no_component(spark, group):
    rng, prints = random.Random(12), set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(20):
            for _ in range(rng.randint(0, 2)):
                base ^= 1 << rng.randrange(64)
            prints.add(base)
    prints = sorted(prints)
    signed = [p if p < 1 << 63 else p - (1 << 64) for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.root for r in components.connected_components(simhash.links(nodes, group)).collect()}
    roots = components_by_hand(prints)
    groups = lambda names: {frozenset(s for s, n in zip(signed, names) if n == k) for k in set(names)}
    assert groups([found.get(s, s) for s in signed]) == groups(roots)


def test_a_large_group_goes_through_the_rings(spark):
    """5000 fingerprints that agree in their first segment, with links planted among them."""
    rng = random.Random(3)
    prints = {rng.getrandbits(42) << 22 | 12345 for _ in range(4900)}
    for p in sorted(prints)[:100]:
        prints.add(p ^ 1 << rng.randrange(22, 64) ^ 1 << rng.randrange(22, 64))
    prints = sorted(prints)
    signed = [p if p < 1 << 63 else p - (1 << 64) for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    found = {r.node: r.root for r in components.connected_components(links).collect()}
    whole = np.array(prints, np.uint64)
    want = {(signed[i], signed[j]) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(whole ^ whole[i]) <= 2).tolist() if i < j}
    assert len(want) >= 90
    assert all(found[a] == found[b] for a, b in want)
    assert len(found) == len({x for pair in want for x in pair})


def test_frequent_keys_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(components, "FREQUENT", 3)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 20), (3, 2), (4, 1)) for i in range(n)], "k long, i long")
    named = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.col("k") * 10)
    found = components.with_frequent(rows, named, "k", "n", 73)
    assert sorted((r.k, r.i, r.name) for r in found.collect()) == sorted((r.k, r.i, r.k * 10) for r in rows.collect())


def shingles_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard_components_by_hand(texts, likeness=0.8):
    sets, root = [shingles_by_hand(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= likeness:
                root = [root[j] if r == root[i] else r for r in root]
    return [root.index(r) for r in root]


def edited_copies():
    """Copies whose five-word Jaccard to the one before, and to the first, lies on either side of 0.8."""
    rng, texts = random.Random(21), []
    for _ in range(12):
        base = [f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(5):
            for _ in range(rng.randint(1, 4)):
                base[rng.randrange(len(base))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(base))
    rng.shuffle(texts)
    return [*texts, "one two three four", "One  two three four", "one two three", None, "", " ", texts[0].upper()]


def test_near_copies_equal_five_word_jaccard(spark):
    texts = edited_copies()
    found = {r.doc_id: r.component_id for r in shingles.near_duplicates(rows_of(spark, list(enumerate(texts)))).collect()}
    want = jaccard_components_by_hand(texts)
    assert [found[i] for i in range(len(texts))] == want
    assert 12 < len(set(want)) < len(texts) - 20  # some copies are near and some are not


def hubless_copies():
    """Many texts of which few pairs are near and none is near to all: edits of one base, which isn't there itself."""
    rng = random.Random(5)
    base = [f"{rng.choice(WORDS)}{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block", [shingles.BLOCK, 1000])
def test_families_without_a_hub_equal_five_word_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "AROUND_PIVOT", 7)
    texts = hubless_copies()
    found = {r.doc_id: r.component_id for r in shingles.near_duplicates(rows_of(spark, list(enumerate(texts)))).collect()}
    assert [found[i] for i in range(len(texts))] == jaccard_components_by_hand(texts)


def pairs_around(likeness, sizes):
    """Pairs of texts, no word in two of them, whose five-word sets just reach ``likeness``, or, of every fifth one, just miss it."""
    texts = []
    for k, n in enumerate(sizes):
        words = [f"w{k}x{i}" for i in range(n + 4)]
        cut = int(n * (1 - likeness) + 1e-9) + (k % 5 == 0)  # what the longer one has on its own
        texts += [" ".join(words), " ".join(words[cut:])]
    return texts


@pytest.mark.parametrize("likeness", [0.6, 0.8])
def test_rings_miss_no_pair(spark, likeness):
    """Bands of MinHashes missed some of these pairs at 0.6."""
    texts = pairs_around(likeness, list(range(3, 240)) * 2)
    found = {r.doc_id: r.component_id for r in shingles.near_duplicates(rows_of(spark, list(enumerate(texts))), likeness=likeness).collect()}
    assert [found[i] for i in range(len(texts))] == jaccard_components_by_hand(texts, likeness)


def test_rings_need_a_part_that_is_equal(spark):
    with pytest.raises(ValueError, match="over 0.5"):
        shingles.ring_links(rows_of(spark, [(1, "a b c d e f")]), likeness=0.5)


def test_chains_in_groups_equal_all_pairs():
    """Links of groups, large and small ones, connect what all pairs within budget connect, and join no others."""
    rng = np.random.default_rng(4)
    part = np.sort(np.concatenate((np.repeat([1, 2], [300, 60]), rng.integers(3, 90, 400)))).astype(np.int64)
    nodes, chains = rng.permutation(len(part)).astype(np.int64), rng.integers(0, 1 << 63, 4, dtype=np.uint64)[rng.integers(0, 4, len(part))]
    for _ in range(3):
        chains = chains ^ np.where(rng.random(len(part)) < 0.6, np.uint64(1) << rng.integers(0, 64, len(part)).astype(np.uint64), np.uint64(0))

    def components_of(pairs):
        root = list(range(len(part)))
        for i, j in pairs:
            root = [root[j] if r == root[i] else r for r in root]
        return [root.index(r) for r in root]

    def within(x, y):
        return all((int(x ^ y) & (1 << 16 * k) - 1).bit_count() <= k for k in range(1, 5))

    met = list(zip(*(x.tolist() for x in shingles.chain_links(part, nodes, chains)), strict=True))
    at = np.argsort(nodes)
    met = [(at[i], at[j]) for i, j in met]
    assert all(part[i] == part[j] and within(chains[i], chains[j]) for i, j in met)
    want = [(i, j) for i in range(len(part)) for j in range(i) if part[i] == part[j] and within(chains[i], chains[j])]
    assert components_of(met) == components_of(want)


def test_links_of_blocks_equal_brute_force():
    sets = [x for x in shingles.shingle_sets([t.encode() for t in hubless_copies()])]
    nodes, side = np.arange(len(sets)), np.arange(len(sets)) % 2
    for sides in (np.zeros(len(sets), int), side):
        want = {(i, j) for i in range(len(sets)) for j in range(i) if shingles.jaccard(sets[i], sets[j]) >= 0.7 and (sides is not side or side[i] != side[j])}
        root = list(range(len(sets)))
        for i, j in want:
            root = [root[j] if r == root[i] else r for r in root]
        own = list(range(len(sets)))
        for i, j in shingles.block_links(nodes, sets, sides, 0.7):
            assert (max(i, j), min(i, j)) in want
            own = [own[j] if r == own[i] else r for r in own]
        assert [root.index(r) for r in root] == [own.index(r) for r in own]


def test_first_rows_of_awkward_groups(spark):
    """Rows that share an id but not a text are apart, rows that share both are one, rows without an id come last."""
    line = lambda c: " ".join(f"{c}{k}" for k in range(30))
    texts = [
        (1, line("a")), (1, line("b")), (2, line("b")), (3, line("c")), (3, line("c")), (None, line("a")), (None, line("d")), (None, line("d")),
        (None, line("e"))
    ]
    docs = rows_of(spark, texts).withColumn("score", F.monotonically_increasing_id().cast("string"))
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text[:2]) for r in kept.collect()) == [("1", "a0"), ("1", "b0"), ("3", "c0"), ("None", "d0"), ("None", "e0")]
    assert kept.where("doc_id = 3").first() == simhash.first_of_each(docs.repartition(3)).where("doc_id = 3").first()


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    texts = edited_copies()
    kept = corpus_pipeline.near_duplicate_stage(spark, rows_of(spark, list(enumerate(texts))), "")
    assert {r.doc_id for r in kept.collect()} == set(jaccard_components_by_hand(texts))


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0}
    assert {found[1000 + i] for i in range(80)} == {1000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_operators_on_an_empty_table(empty):
    assert substrings.deduplicate(empty).count() == 0
    assert fingerprints.compare_neighbours(empty).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_a_single_row_is_its_own_next(spark):
    r = fingerprints.compare_neighbours(rows_of(spark, [(3, "abcdefgh")])).first()
    assert r.near_next == 1.0
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


# the pipeline


def test_pipeline_stages(spark, sf_dir, con):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "encoding"]
    from trackloom.session import written

    before, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, sf_dir), name)
        if name != "encoding":
            assert [f.name for f in after.schema] == docs.columns
        kept.append(after)
        before = after
    good, distinct, clean, safe, encoded = kept
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    texts = [(r.doc_id, r.text) for r in good.orderBy("doc_id").collect()]
    roots = jaccard_components_by_hand([t for _, t in texts])
    assert {r.doc_id for r in distinct.collect()} == {texts[k][0] for k in set(roots)}
    assert decontaminate.find_contamination(clean, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").count() == 0
    assert all(plain_spans(r.text) == "" for r in safe.collect())
    assert sorted((r.doc_id, r.text) for r in encoded.collect()) == sorted((r.doc_id, r.text) for r in safe.collect())
    assert corpus_pipeline.run(spark, sf_dir).count() == encoded.count()


def test_pipeline_on_awkward_rows(spark, sf_dir):
    import corpus_pipeline

    schema = T.StructType([*spark.read.parquet(f"{sf_dir}/documents.parquet").schema, T.StructField("fp", T.StringType())])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in awkward()], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "encoding":
            assert docs.columns == schema.names
    docs.count()
