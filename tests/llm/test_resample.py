"""Resampling against a plain version that joins every feature and sorts every document."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tempora.llm import queries_scan, resample

UPPER = {i: i + 32 for i in range(65, 91)}


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000))))
    rows = []
    for i, text in docs:
        n, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        rank.setdefault(r, []).append(k)
    return [(r[0], *r[2:], rank[r].pop(0) if rank.get(r) else None) for r in rows]


def tables(spark, path, docs, target):
    spark.createDataFrame([(i, t, 3, "x") for i, t in docs], "doc_id long, text string, rank int, weight string").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_equal_the_plain_version(spark, tmp_path, seed):
    r = random.Random(seed)
    pool = ["Alpha", "beta", "x1", "É", "漢字", "end.", "a-b", "\x00", "tail\n", "ÀB", "0"]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(300)] + [(1000 + i, "one two " * 15) for i in range(100)]
    docs += [(None, text(40)), (5, None), (6, ""), (7, " \t"), (8, "\x00"[:0] + "word " * 19), (9, "word " * 20), (10, text(30_000))]
    docs += [(77, "same words again " * 10)] * 60 + [(None, text(40))]
    target = [text(12), None, "", "beta " * 8, "漢字 É"]
    tables(spark, tmp_path, docs, target)
    got = [tuple(x) for x in queries_scan.op13_resample(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(plain(docs, target), key=str)


def test_no_documents_no_target_and_too_few_to_draw(spark, tmp_path):
    for name, docs, target in (("a", [], []), ("b", [(1, "w " * 30)], []), ("c", [], ["x y"])):
        tables(spark, tmp_path / name, docs, target)
        got = [tuple(x) for x in queries_scan.op13_resample(spark, str(tmp_path / name)).collect()]
        assert got == plain(docs, target)


def test_long_texts_are_read_in_steps():
    r = random.Random(5)
    raw = " ".join("".join(r.choice("aB9é.") for _ in range(r.randrange(1, 40))) for _ in range(400)).encode()
    whole = [w for step in resample.words(raw) for w in step]
    for step in (1, 7, 64, 1000):
        assert [w for x in resample.words(raw, step) for w in x] == whole
        for k in (1, 2, 4):
            got = Counter(s for levels in resample.grams(raw, k, step) for level in levels for s in level)
            want = Counter(zlib.crc32(b" ".join(whole[i : i + n])) for n in range(1, k + 1) for i in range(len(whole) - n + 1))
            assert got == want
