"""Candidates travel without texts, and the results are those of a scan by hand with and without broadcasts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tempora.llm import decontaminate as D


def _words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def _by_hand(docs, items):
    out = []
    for key, text in docs:
        words, hit, named = _words(text), set(), set()
        for item, body in items:
            own = _words(body)
            runs = [own[i : i + 10] for i in range(max(len(own) - 9, 1))] if own else []
            for run in runs:
                for i in range(len(words) - len(run) + 1):
                    if words[i : i + len(run)] == run:
                        hit.update(range(i, i + len(run)))
                        named.add(str(item))
        out.append((key, len(words), len(hit), len(named)))
    return sorted(out, key=str)


def _tables():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 9, 10, 14, 25])))) for i in range(25)] + [(90, "w1 w1 w1 w1 w1 w1"), (91, ""), (92, None)]
    docs = []
    for key in range(30):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))]
        parts += [rng.choice(items[:25])[1].upper() for _ in range(rng.randint(0, 3))]
        docs.append((key, ", ".join(parts)))
    long = " ".join(rng.choices(vocabulary, k=20_000))
    return docs + [(100, long + " " + items[3][1]), (100, "other text"), (101, None), (None, items[5][1]), (None, ""), docs[0]], items


@pytest.mark.parametrize("broadcasts", [True, False])
def test_hits_are_those_of_a_scan(spark, monkeypatch, broadcasts):
    staged = {}
    own = D.stage

    def seen(df, name):
        staged[name] = df.columns
        return own(df, name)

    monkeypatch.setattr(D, "stage", seen)
    if not broadcasts:
        monkeypatch.setattr(D, "when_small", lambda df, size: df)
        monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, items = _tables()
        table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("print", F.lit("x")).withColumn("id", F.lit(1))
        out = D.decontaminate(table, spark.createDataFrame(items, "item_id long, text string"))
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in out.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == _by_hand(docs, items)
    assert staged["places"] == ["id", "print", "key", "pos", "n"]
