"""Long words, and what counts as a letter."""

import random
import time

import numpy as np
import pytest

from ledgerline.llm.lattice import MARK, PieceLattice, by_chars, words_of
from ledgerline.llm.sentencepiece_coding import piece_file


@pytest.fixture(scope="module")
def lat():
    return PieceLattice(piece_file())


def texts():
    r = random.Random(3)
    yield "".join(r.choice("abcdefghijklmnop") for _ in range(2000))
    yield "".join(r.choice("日本語の文章はとても長い🎉é") for _ in range(2000))
    yield "thequickbrownfoxjumpsoverthelazydog" * 60
    yield "x" * 3000
    yield MARK * 500 + "a" * 65


def test_cuts_leave_segmentations_the_same(lat, monkeypatch):
    monkeypatch.setattr("ledgerline.llm.lattice.WINDOW", 100)
    logp = np.random.default_rng(0).normal(-8, 2, (2, len(lat.pieces)))
    for text in texts():
        whole, parts = words_of(text), lat.words(text)
        assert "".join(whole) == "".join(parts)
        a, b = lat.viterbi(whole), lat.viterbi(parts)
        assert a[0].tolist() == b[0].tolist() and abs(a[2].sum() - b[2].sum()) < 1e-6 * abs(a[2].sum())
        assert np.allclose(lat.forward(whole, logp)[0].sum(1), lat.forward(parts, logp)[0].sum(1))


@pytest.mark.parametrize("alphabet", ["日本語の文章はとても長い", "abcdefghijklmnopqrstuvwxyz"])
def test_a_million_unspaced_characters(lat, alphabet):
    r = random.Random(5)
    text = "".join(r.choice(alphabet) for _ in range(1_000_000))
    began = time.time()
    parts = lat.words(text)
    assert "".join(parts) == MARK + text
    assert time.time() - began < 30 and max(map(len, parts)) < 2000


def test_texts_are_taken_by_characters(monkeypatch):
    monkeypatch.setattr("ledgerline.llm.lattice.TEXT_CHARS", 10)
    own = ["x" * 4, None, "x" * 30, "", "x" * 9, "x" * 2]
    assert [own[s] for s in by_chars(own, 3)] == [own[:2], own[2:3], own[3:5], own[5:]]


def test_numbers_are_no_letters(spark):
    from ledgerline.llm.language_id import predict, train

    rows = [(k, "the quick brown fox jumps over it", "en") for k in range(5)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ _ 12"), (3, "½ a"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in predict(odd, model).collect()} == {1: "und", 2: "und", 3: "en", 4: "und"}


def test_a_text_with_the_space_mark_does_not_round_trip(spark):
    from ledgerline.llm.sentencepiece_coding import encode

    rows = spark.createDataFrame([(1, f"a{MARK}b"), (2, " a  b\n é🎉 "), (3, "x" * 5000), (4, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["round_trip"] for r in encode(rows, digest=True).collect()} == {1: False, 2: True, 3: True, 4: True}
