import itertools

import numpy as np
import pytest

from tempora.llm import language


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 8, 9, 20])
def test_codewords_are_far_apart(n):
    words = language.codewords(n)
    apart = [int((a != b).sum()) for a, b in itertools.combinations(words, 2)]
    assert words.shape[0] == n and min(apart) >= (4 if n >= 4 else 1)
    partings = {tuple(c * c[0]) for c in words.T}
    assert len(partings) == words.shape[1] and all(len(set(c)) == 2 for c in words.T)


@pytest.mark.parametrize("n", [4, 5, 6, 9])
def test_one_wrong_bit_still_decodes(n):
    model = language.Model([f"l{i:02d}" for i in range(n)], np.random.default_rng(1).integers(0, 50, (n, language.FEATURES)))
    for i, word in enumerate(model.words):
        for bit in range(len(word)):
            margins = word.astype(float)
            margins[bit] *= -1
            best, share = model.decode(margins[None], np.array([9]))
            assert best[0] == i and 0 < share[0] <= 1


def test_none_and_one_language():
    assert language.codewords(1).shape == (1, 1)
    model = language.Model(["en"], np.ones((1, language.FEATURES)))
    assert model.decode(np.zeros((1, 1)), np.array([0]))[0][0] == 0


def test_tables_that_are_empty_or_repeat(spark):
    none = language.fit(spark.createDataFrame([], "lang string, text string"))
    asked = spark.createDataFrame([(1, "one word"), (1, "one word"), (None, None), (2, "... 12")], "doc_id long, text string")
    assert {(r["lang_pred"], r["score"]) for r in language.predict(asked, none, ["doc_id"]).collect()} == {("und", 0.0)}
    rows = [("en", "the house and the garden"), ("de", "das Haus und der Garten"), ("fr", "la maison et le jardin"), ("es", "la casa y el huerto")] * 3
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    long = " ".join(["the garden and the house"] * 20_000)
    got = language.predict(spark.createDataFrame([(1, long), (1, long), (2, None)], "doc_id long, text string"), model, ["doc_id"]).collect()
    assert sorted(r["lang_pred"] for r in got) == ["en", "en", "und"] and model.words.shape == (4, 7)
