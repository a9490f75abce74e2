"""Very long texts give what short pieces of code see in the whole."""

import random

import numpy as np
import pyarrow as pa
import pytest

from framequarry.llm import decontamination, language, quality, textkernel, toxicity
from framequarry.llm.decontamination import Index, Rule, _matches


@pytest.mark.parametrize("word,hit", [("category", False), ("cat egory", True), ("a cat", True), ("bobcat egory", False)])
def test_short_items_at_a_piece_border_are_whole_words(monkeypatch, word, hit):
    monkeypatch.setattr(decontamination, "PIECE", 1000)
    search = Index([(1, "cat"), (2, "the" * 30)], Rule())
    rng = random.Random(1)
    for start in range(985, 1010):
        text = "".join(rng.choice("dg .") for _ in range(start - 1)) + " " + word + " " + "".join(rng.choice("dg .") for _ in range(2500))
        assert [m["item_id"] for m in _matches(search, [text])[0]] == [1] * hit
        assert [m["item_id"] for m in _matches(search, [" " + word + " "])[0]] == [1] * hit


def test_a_carried_piece_does_not_start_a_word(monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 50)
    search = Index([(1, "cat")], Rule())
    for n in range(30, 60):
        assert _matches(search, ["x" * n + "cat" + "y" * 200, "x" * n + "cat y" + "y" * 200]) == [[], []]


TEXTS = ["中文没有空格" * 900, "two words", None, "", "x" * 5000 + " y " + "z" * 3000, "é" * 2500 + "!", "short " * 700, "!" * 4000]


def test_grams_of_words_longer_than_a_piece(monkeypatch):
    def all_counts():
        return np.concatenate(list(language.term_counts(pa.array(TEXTS))))

    def all_grams():
        vocabulary = toxicity.Vocabulary(np.unique(np.concatenate([h for *_, h in toxicity.grams(pa.array(TEXTS))])))
        return [(terms[a:b].tolist(), counts[a:b].tolist()) for _, bounds, terms, counts in toxicity.counted(pa.array(TEXTS), vocabulary) for a, b in zip(bounds, bounds[1:])]

    want, grams = all_counts(), all_grams()
    for piece in (7, 64, 1000):
        monkeypatch.setattr(textkernel, "PIECE", piece)
        assert (all_counts() == want).all()
        assert all_grams() == grams
        sizes = [len(x[1]) for x in textkernel._cuts(pa.array(TEXTS), textkernel.NOT_ALNUM, textkernel.LOWER, None, 3)]
        assert max(sizes) <= piece


def test_distinct_words_of_a_text_in_pieces(monkeypatch):
    texts = pa.array(["one two two three " * 300, "four"])
    unknown = np.full(2, np.nan)
    view = lambda: np.concatenate([t for _, t, _ in quality.features(texts, unknown, np.zeros(2, int), np.zeros(2, int))])
    want = view()
    monkeypatch.setattr(textkernel, "PIECE", 100)
    assert np.allclose(view(), want)
