"""Encoding by backtracking against the library, and against plain merging."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from trackloom.llm import pieces, queries
from trackloom.llm.token_counts import read_model

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = " \n▁abcdeétionthe\t一人\U0001f600\x00"
FIXED = ["", " ", "  ", "a", " a", "a ", "a  ", "▁", "a▁▁b", "a\n", "\n", " \n ", "\n\n a", "a \nb", "<s>", "<0x41>", "<unk>", "   " * 20, "e" * 300, "�"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(read_model(PATH))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def agree(codec, library, text):
    ids = library.encode(text)
    assert list(codec.encode(text)) == ids, text
    assert codec.decode(ids) == library.decode(ids), text
    assert codec.digests(text) == expected(library, text), text


@pytest.mark.parametrize("stretch, window, held", [(1 << 20, 1 << 16, 1 << 26), (7, 5, 3000)])
def test_codec_equals_the_library(codec, library, monkeypatch, stretch, window, held):
    monkeypatch.setattr(pieces, "STRETCH", stretch)
    monkeypatch.setattr(pieces, "WINDOW", window)
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", held)
    rng = random.Random(1)
    some = [x.replace("▁", " ") for x in codec.score]
    for text in FIXED:
        agree(codec, library, text)
    for _ in range(1500):
        agree(codec, library, "".join(rng.choice(ODD) for _ in range(rng.randrange(60))))
        agree(codec, library, "".join(rng.choice(some) for _ in range(rng.randrange(12))))


def test_any_ids_decode_as_the_library_does(codec, library):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, *range(3, 400)]) for _ in range(rng.randrange(8))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_pairs_fit_as_plain_merging_says(codec):
    """``fits`` and what merging two pieces again gives by the plain rule."""
    rng = random.Random(3)
    names = list(codec.id_of)

    def merged(text):
        parts = list(text)
        while True:
            best = max(((codec.score.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(float("-inf"), 0))
            if best[0] == float("-inf"):
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    seen = set()
    for _ in range(3000):
        a, b = rng.choice(names[:400]), rng.choice(names[:3000])
        said = codec.fits(codec.id_of[a], codec.id_of[b])
        assert said == (merged(a + b) == [a, b]), (a, b)
        seen.add(said)
    assert seen == {True, False}


def test_a_long_run_is_worked_through_in_windows(codec, library, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOW", 1000)
    run = "thequickbrownfoxisunbelievably" * 2000
    assert list(codec.encode(run)) == library.encode(run)


def test_long_texts_are_digested_in_stretches(codec, library):
    text = "the quick brown fox\nis unbelievably quick " * 60000
    ids = library.encode(text)
    assert codec.digests(text) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_operator_on_awkward_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "of null"), (3, "x" * 5000), (3, "x" * 5000), (4, "Zwei Über \U0001f600 naïve")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    found = pieces.encode_digests(docs, PATH)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str((i, *expected(library, t))) for i, t in rows)
    whole = pieces.encode_texts(docs, PATH).collect()
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in whole) == sorted((str(i), library.encode(t or ""), t or "") for i, t in rows)
    assert pieces.encode_digests(docs.where("false"), PATH).count() == 0


def test_query_equals_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in queries.documents(spark, sf_dir).collect()}
    found = queries.queries()["op12_sentencepiece"](spark, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == {i: expected(library, t) for i, t in texts.items()}


def test_other_models_are_refused(spark):
    with pytest.raises(ValueError):
        pieces.PieceCodec(b"")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    with pytest.raises(FileNotFoundError):
        pieces.encode_digests(docs, PATH + ".missing")
