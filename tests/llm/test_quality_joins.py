"""Scores by joins with blocks of texts against the plain version; one scoring for limits and verdicts."""

import math
import random

import plain_quality
import pytest

from tempora.llm import quality


@pytest.mark.parametrize("block", [16 << 20, 500])
def test_scores_by_joins_match_the_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    rng = random.Random(4)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(1, 9)))
    text = lambda s: " ".join(word(s) for _ in range(rng.randint(60, 130)))
    trusted = [("en", text("abcde")) for _ in range(60)] + [("zh", text("漢字仮名交文")) for _ in range(40)] + [(None, text("xyz"))]
    model = quality.fit(spark.createDataFrame(trusted, "lang string, text string"))
    tables = {lang: plain_quality.table_of(model, lang) for lang in model.languages}
    asked = [(i % 7 or None, rng.choice(["en", "zh", "fr", None]), rng.choice([text("abcdeq9Z"), text("漢字假"), None, " ", "a\U0001f600\0b"])) for i in range(60)]
    asked += asked[:5]
    got = quality.score(spark.createDataFrame(asked, "doc_id long, lang string, text string"), model).collect()
    assert sorted((tuple(r["row"]) for r in got), key=str) == sorted(asked, key=str)
    for r in got:
        lang = r["row"]["lang"] if r["row"]["lang"] in tables else quality.POOLED
        want = plain_quality.text(tables[lang], r["row"]["text"] or "", model.order)
        assert r["model"] == lang
        if want is None:
            assert r["perplexity"] is None and r["worst_perplexity"] is None and r["keep"]
            continue
        assert (r["perplexity"], r["worst_perplexity"]) == pytest.approx(tuple(map(math.exp, want)), rel=1e-5)
        top = model.limit(lang)
        assert r["keep"] == (r["perplexity"] <= top[0] and r["worst_perplexity"] <= top[1])


def test_nothing_of_the_model_is_gathered(spark, monkeypatch):
    rows = spark.createDataFrame([("en", "some words to train on")], "lang string, text string")
    monkeypatch.setattr(type(rows), "toLocalIterator", lambda *a, **k: pytest.fail("the model came to the driver"))
    model = quality.fit(rows)
    assert quality.score(rows, model).count() == 1


def test_classify_scores_once_with_the_limits_of_trusted_rows(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, rng.choice(["en", "de", None]), " ".join(rng.choice(["the", "thing", "that", "then"]) for _ in range(30))) for i in range(80)]
    docs += [(100, "en", "@@## ~~ xq zzq"), (None, "en", None), (101, "xx", "the thing"), (7, "en", "@@## ~~ xq zzq")]
    labels = [(i, int(i % 5 > 0), int(i % 7 == 1)) for i in range(80)] + [(None, 1, 0), (3, 0, None)]
    rows = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumn("p", quality.F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(rows, marks).collect()
    model = quality.fit(quality.trusted_documents(rows, marks))
    want = quality.score(rows, model).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(docs)
    calls, run = [], quality.perplexities
    monkeypatch.setattr(quality, "perplexities", lambda *a: calls.append(1) or run(*a))
    quality.classify(rows, marks, "doc_id")
    assert len(calls) == 1


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab\u00e9 \u2003\n\U0001f600") for _ in range(rng.choice([0, 5, 300]))) for _ in range(40)] + ["x" * 900, " " * 50]
    want = [quality.normal(t).split() for t in texts]
    for size in (1, 7, 100, 10_000):
        monkeypatch.setattr(quality, "CHUNK", size)
        got = [[] for _ in texts]
        for words, owner in quality.pieces(texts):
            assert len(words) == len(owner)
            for word, i in zip(words, owner, strict=True):
                got[i].append(word)
        assert got == want
