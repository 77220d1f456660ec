"""Codes by adaptive bounds against plain integer k-means that computes every distance."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tempora.llm import queries_scan, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code int, row string"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) of every kept row, and the digest."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1]) if kept else 0
    kept = [r for r in kept if len(r[1]) == length]
    d = length // parts
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[nearest(v, p)].append(part(v, p))
            for e, got in members.items():
                books[p][e] = [sum(x) // len(got) for x in zip(*got, strict=True)]
    out, total = [], defaultdict(int)
    for i, v, label in kept:
        code = [nearest(v, p) for p in range(parts)]
        error = sum(far(part(v, p), books[p][e]) for p, e in enumerate(code))
        total[label] += error
        out.append((i, "".join(f"{e:02x}" for e in code), error, label))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, c, e, total[label]) for i, c, e, label in out], digest


def table(spark, path, rows):
    spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")


@pytest.mark.parametrize("kind", ["clusters", "ties", "crowd", "few", "one", "short"])
def test_codes_equal_plain_kmeans(spark, tmp_path, kind):
    rng = np.random.default_rng(len(kind))
    n, length = {"few": (9, 16), "one": (1, 8), "short": (60, 0)}.get(kind, (400, 32))
    if kind == "clusters":
        vectors = rng.normal(size=(20, length))[rng.integers(0, 20, n)] + rng.normal(size=(n, length)) / 20
    else:
        vectors = rng.integers(-2, 3, (n, length)) / 4096 if kind == "ties" else rng.normal(size=(n, length))
    if kind == "crowd":
        vectors[50:300] = vectors[7]
    rows = [(int(i), v.tolist(), [None, 1, 2][i % 3]) for i, v in zip(rng.permutation(n) * 3, vectors, strict=True)]
    bad = [(-5, None, 1), (-4, [*([0.5] * (length - 1)), None][:length] or None, 1), (-3, [math.nan] * max(length, 1), None), (-2, [math.inf] * max(length, 1), 2)]
    odd = [(10_001, [0.1] * (length + 1), 1), (None, vectors[0].tolist(), None), rows[-1], rows[-1]]
    table(spark, tmp_path, rows + bad + odd)
    got = queries_scan.op12_vector_codes(spark, str(tmp_path)).collect()
    want, digest = plain(rows + bad + odd)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=str) == sorted(want, key=str)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_bounds_spare_comparisons_and_b_shrinks(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(16, 64)) * 4
    vectors = centers[np.r_[0:16, rng.integers(0, 16, 2000)]] + rng.normal(size=(2016, 64)) / 50
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    coded = vector_codes.encode(rows, ["vec_id"])
    assert coded.sizes[0] == [4] * 8 and coded.sizes[-1] == [2] * 8
    book = (centers * 4096).astype(np.int64)[:, :8]
    data = (vectors * 4096).astype(np.int64)[:, :8]
    first, used = vector_codes.assign(data, book, vector_codes.Bounds.blank(len(data), 4))
    assert (used == 5).all()
    moved = book + 3
    again, used = vector_codes.assign(data, moved, first.moved(np.full(16, 10.0, np.float32)))
    assert (used == 0).mean() > 0.9
    assert (again.near[:, 0] == vector_codes.squares(data, moved[None]).argmin(1)).all()


def test_no_rows(spark, tmp_path):
    table(spark, tmp_path, [])
    assert queries_scan.op12_vector_codes(spark, str(tmp_path)).collect() == []


def test_components_beyond_the_limit_are_held(spark):
    rows = spark.createDataFrame([(1, [1e300, -1e300] * 4), (2, [0.0] * 8)], "vec_id long, embedding array<double>")
    got = vector_codes.encode(rows, ["vec_id"])
    assert got.books[0].tolist() == [[vector_codes.LIMIT - 1], [0]] and {r.error for r in got.rows.collect()} == {0}
