"""Chunk budgets in pieces of a model."""

import random

import numpy as np
import pytest

from lectern.operators import pages, tokens


def some_texts():
    r = random.Random(5)
    words = ["a", "bb", "longer", "Straße", "日本語", "x" * 90, "end.", "it's", "(z)"]
    return ["", " \n"] + ["".join(r.choice(words) + r.choice([" ", " ", "\n", "\n\n"]) for _ in range(r.randint(1, 300))) for _ in range(40)]


@pytest.mark.parametrize("most", [1, 7, 40, 500])
def test_chunks_hold_every_word_within_the_limit(most):
    letters = [chr(c) for c in range(97, 123)]
    lengths = tokens.word_piece_lengths(["[UNK]", *letters, *[f"##{c}" for c in letters], "longer", "日", "'"])
    for text in some_texts():
        weights = pages.piece_weights(lengths, most)
        starts, ends, weight = weights(text)
        spans = pages.weighted_spans(text, most, weights)
        covered = np.zeros(len(starts), bool)
        for s, e, n in spans:
            inside = (starts >= s) & (ends <= e)
            assert n == weight[inside].sum() and n <= most
            covered |= inside
        assert covered.all() and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(spans, spans[1:]))
        assert "".join(text[s:e] for s, e in zip(starts.tolist(), ends.tolist())) == "".join(text.split())


def test_equal_weights_are_plain_chunks():
    for text in some_texts():
        weights = pages.piece_weights(lambda word: [len(word)], 9)
        assert pages.weighted_spans(text, 9, weights) == pages.chunk_spans(text, 9)


def test_lengths_of_word_pieces():
    lengths = tokens.word_piece_lengths(["ab", "##c", "(", "d"])
    assert lengths("abc") == [2, 1] and lengths("(abcd)") == [1, 4, 1] and lengths("ABC(") == [2, 1, 1] and lengths("日x") == [1, 1]
