"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import plain_quality
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tempora.llm import chat, decontaminate, jaccard, language, lines, packing, pages, quality, sharding, vectors
from tempora.llm.common import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
LONG = " ".join(f"w{i}" for i in range(5000))
TEXTS = [
    (1, " ".join(BASE)), (2, " ".join(BASE)), (3, " ".join([*BASE, "more"])), (4, " ".join(BASE[::-1])), (5, None), (6, ""),
    (7, " \n\t "), (8, LONG), (9, LONG + " tail"), (None, "lone text of nobody at all"), (10, "Two"), (10, "three words here"),
    (11, "É É É"), (1, " ".join(BASE)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 5, 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, pos int, start int")


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def test_decontamination(spark, docs):
    items = [(1, " ".join(BASE[3:15])), (2, "TWO"), (3, None), (4, ""), (None, "é é"), (5, " ".join(BASE[3:15])), (6, "w1 w2 w4")]
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = []
    for doc, text in TEXTS:
        words, hit, names = cut(text), set(), set()
        for item, body in items:
            own = cut(body)
            for i in range(max(len(own) - 9, 1) if own else 0):
                win = own[i : i + 10]
                at = [p for p in range(len(words) - len(win) + 1) if words[p : p + len(win)] == win]
                hit |= {q for p in at for q in range(p, p + len(win))}
                names |= {str(item)} if at and item is not None else set()
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want.append((doc, len(words), len(hit), len(names), sha, bool(hit)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_line_dedup(spark):
    long_line = " ".join(f"v{i}" for i in range(60))
    block = "\n".join(f"line {i} of a block" for i in range(40))
    rows = [(1, f"a\n{long_line}\nb"), (2, f"c\n{long_line}\nd"), (3, "x\n" + block), (4, "y\nz\n" + block + "\nq"), (5, None), (6, ""), (None, long_line), (7, "a")]
    got = {r["row"]["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["new_text"] == rows[0][1] and got[2]["new_text"] == "c\nd" and got[None]["new_text"] == ""
    left = got[4]["new_text"].split("\n")
    assert left[:2] == ["y", "z"] and left[-1] == "q" and len(left) < 12  # all but the edges' chunks are gone
    assert got[3]["n_removed"] == 0 and got[5]["new_text"] is None and got[6]["new_text"] == "" and got[7]["new_text"] == "a"


def test_packing_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = packing.pack(docs, path, ranks).collect()
    coder = Tokenizer.from_file(path)
    ids = lambda t: [*coder.encode(t or "", add_special_tokens=False).ids, 0]
    texts = {i: t for i, t in TEXTS if i != 10}
    for r in got:
        if r.doc_id == 10:
            continue
        own = ids(texts[r.doc_id])
        piece = own[r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) == r.ids_crc32 and r.doc_tokens == len(own)
    assert sum(r.length for r in got) == sum(len(ids(t)) for _, t in TEXTS)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024


def test_chunk_ids_equal_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    quick = packing.ChunkIds(path, (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    for text in ["a  b", " a", "a ", "it's a 'test'", "x\n\ny z", "a \nb", "tab\tb c", "é ü ß", "<|endoftext|> x", "emoji 😀 z", ""]:
        assert quick.of(text) == quick.whole(text), text


def test_best_fit_takes_the_tightest_window():
    assert packing.best_fit([700, 600, 400, 300], 1024) == [(0, 0), (1, 0), (1, 600), (0, 700)]


def test_jaccard(docs):
    got = {(r.doc_id, r.text_print): r for r in jaccard.link(docs).collect()}
    known = [(i, sets(t)) for i, t in TEXTS]
    comp = {k: i for k, (i, _) in enumerate(known)}
    for _ in known:
        for x, (_, a) in enumerate(known):
            for y, (_, b) in enumerate(known):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[x] = comp[y] = min((c for c in (comp[x], comp[y]) if c is not None), default=None)
    want = sorted({(i, len(s), comp[k]) for k, (i, s) in enumerate(known)}, key=str)
    assert sorted({(r.doc_id, r.n_shingles, r.component_id) for r in got.values()}, key=str) == want


def test_signatures_meet_at_the_bound():
    """Random pairs at or above the threshold share a signature, whatever their sizes."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 100, 300, 1000]:
        for _ in range(12):
            pool = np.unique(rng.integers(0, 2**63, 2 * n + 4, dtype=np.uint64))
            rng.shuffle(pool)
            lost = int(rng.integers(0, n // 4 + 1))
            gained = int(max(0, (n - lost) * 4 / 3 - n))
            a, b = pool[:n], np.concatenate([pool[lost:n], pool[n : n + gained]])
            if 100 * (n - lost) >= 75 * (n + gained):
                x, y = (set(np.concatenate(jaccard.signatures(np.sort(s))).tolist()) for s in (a, b))
                assert x & y, (n, lost, gained)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (50, 49), (49, 51)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[k] for k in range(100, 140)} == {100} and got[51] == 49


def test_sharding(docs):
    got = sharding.shard(docs, 3).collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(3)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(got) == len(TEXTS)
    for r in got:
        assert any(r.doc_id == i and r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) for i, t in TEXTS)


def test_pages():
    html = """<html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">Accept</div><article><h1>Head &amp; more</h1><p>First   paragraph, quite long, with a <b>bo</b>ld word.
    <p>Second&nbsp;one<br>goes on, long enough to count.</p></article><section id="comments"><p>I disagree with you a lot.</p></section>
    <footer>&copy; us</footer></body>"""
    want = "Head & more First paragraph, quite long, with a bold word. Second one goes on, long enough to count."
    assert pages.main_text(html) == want
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<script>1") == ""
    assert pages.main_text("plain words") == "plain words"
    assert len(pages.main_text("<div>" * 20000 + "deep")) == 4


def test_chat(spark):
    call = '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":1}},{"id":"b","name":"f","arguments":{"y":{"$ref":"a"}}}]}'
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"b","content":{"k":[1]}}'),
        (1, 1, "tool", '{"tool_call_id":"a","content":"ok"}'), (1, 3, "tool", '{"tool_call_id":"zz","content":null}'),
        (2, None, None, None), (None, 5, "user", "{bad json"), (2, None, None, None),
    ]
    schema = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}
    out = chat.link(chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), {"f": schema}).collect()
    one = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(6)) and [r.kind for r in one[:1]] == ["message"]
    place = {(r.kind, r.call_id): r for r in one}
    assert place["call", "a"].position < place["call", "b"].position < place["result", "b"].position
    assert place["call", "a"].valid and not place["call", "b"].valid and place["result", "zz"].state == "orphan"
    assert place["call", "a"].line == '{"arguments":{"x":1},"id":"a","name":"f","role":"assistant","type":"tool_call"}'
    assert sorted(r.position for r in out if r.conv_id == 2) == [0, 1] and len(out) == 9


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 16))
    base[1::3] = base[::3] + 0.1 * rng.normal(size=(300, 16))
    base[600:650] = base[600]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [None] * 16)]
    got = {r.vec_id: r for r in vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near = vectors.unit(base) @ vectors.unit(base).T >= 0.9
    want = {i: int(near[i].sum()) - 1 for i in range(900)}
    assert sum(got[i].n_links for i in want) >= 0.95 * sum(want.values()) and all(got[i].n_links <= want[i] for i in want)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 905))


def test_language(spark):
    rows = [("en", f"the cat and the dog number {'abcdefgh'[i % 8]}") for i in range(40)] + [("de", f"der hund und die katze {'abcdefgh'[i % 8]}") for i in range(40)]
    model = language.fit(spark.createDataFrame([*rows, (None, "x"), ("fr", None)], "lang string, text string"))
    asked = [(1, "the dog"), (2, "und der hund"), (3, None), (4, "123 !"), (5, ""), (6, LONG)]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(asked, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("en", "de") and [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality(spark):
    rng = np.random.default_rng(1)
    good = [("en", " ".join(rng.choice(["the", "thing", "that", "there", "then"], 60))) for _ in range(200)]
    model = quality.fit(spark.createDataFrame(good, "lang string, text string"))
    table = plain_quality.table_of(model, "en")
    letters = sorted({g[-1] for g in table if g})
    for context in ("", " ", "t", " th"):
        assert sum(math.exp(-plain_quality.cost(table, context + x)) for x in letters) == pytest.approx(1, abs=0.1)
    asked = [(1, "en", good[0][1]), (2, "en", "@@## ~~ %% xq zzq"), (3, None, good[1][1]), (4, "en", None), (5, "en", "")]
    got = {r["row"]["doc_id"]: r for r in quality.score(spark.createDataFrame(asked, "doc_id long, lang string, text string"), model).collect()}
    assert got[1]["keep"] and not got[2]["keep"] and got[3]["keep"] and got[4]["keep"] and got[5]["keep"] and got[4]["perplexity"] is None


def test_gram_counts_match_plain_counting(spark):
    texts = [("en", "The cat\nsat on 1999 mats"), ("en", "the CAT"), ("fr", "été \U0001f600 \0 x"), (None, "the été"), ("fr", None), ("en", "")]
    got = {(r["lang"], plain_quality.gram_of(r["gram"])): r["n"] for r in quality.gram_counts(spark.createDataFrame(texts, "lang string, text string"), 4).collect()}
    want = Counter()
    for lang, text in texts:
        for grams in plain_quality.grams(text or "", 4):
            for key in {lang or quality.POOLED, quality.POOLED}:
                want.update((key, g) for g in grams)
    assert got == want


@pytest.mark.parametrize("order", [2, 3, 4])
def test_text_scores_match_plain_backoff(order):
    rng, letters = random.Random(order), "abcdeéß0 Ωx"
    table = {"": (0.01, None)}
    for _ in range(2000):
        gram = "".join(rng.choice(letters) for _ in range(rng.randint(1, order)))
        table[gram] = (rng.random(), rng.choice([None, rng.random()]))
    grams = np.array([plain_quality.number_of(g) for g in table], np.uint64)
    costs = quality.Costs(grams, np.array([p for p, _ in table.values()]), np.array([b or np.nan for _, b in table.values()]))
    texts = ["".join(rng.choice(letters + "\n9A\0\U0001f600\t") for _ in range(rng.randint(0, 300))) for _ in range(100)]
    got = zip(*costs.texts(texts, len(texts), order), strict=True)
    for text, found in zip(texts, got, strict=True):
        want = plain_quality.text(table, text, order)
        assert found == pytest.approx(want, rel=1e-6) if want else all(map(math.isnan, found))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    items = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for df in (decontaminate.decontaminate(none, items), lines.dedup_lines(none), packing.pack(none, path), jaccard.link(none), sharding.shard(none), quality.score(none, quality.fit(none))):
        assert df.count() == 0
    assert vectors.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
