import numpy as np

from tempora.llm import vectors


def units(spark, rows):
    return spark.createDataFrame([(i, t, v.tolist()) for i, t, v in rows], "vec long, times long, unit array<double>")


def test_a_vector_with_many_copies_counts_once(spark):
    rng = np.random.default_rng(2)
    base = vectors.unit(rng.normal(size=(40, 16)))
    base[1] = vectors.unit(base[:1] + 0.01 * rng.normal(size=(1, 16)))[0]
    truth = vectors.audit(units(spark, [(i, 10**6 if i == 1 else 1, v) for i, v in enumerate(base)]), 0.9)
    assert truth[0] == truth[1] == 1 and sum(truth.values()) == 2


def test_missing_evidence_raises_the_overlap(spark, monkeypatch):
    rng = np.random.default_rng(2)
    own = units(spark, [(i, 1, v) for i, v in enumerate(vectors.unit(rng.normal(size=(60, 16))))])
    tried, search = [], vectors.search_links
    monkeypatch.setattr(vectors, "search_links", lambda c, m, w, x: tried.append(w) or search(c, m, w, x))
    means = vectors.centroids(vectors.unit(rng.normal(size=(40, 16))), 12)
    assert vectors.audited_links(own, means, 2, 0.9).count() > 0 and tried == [2, 4]


def test_recall_is_a_mean_over_queries_and_a_crowd_is_apart():
    truth = {1: 1000, 2: 1000, 3: 2, 4: 1, 5: 0}
    got = vectors.recalls(truth, {1: 1000, 2: 900, 3: 1, 4: 1})
    assert got == {"sparse": 0.75, "crowded": 0.95}
    assert vectors.recalls({5: 0}, {}) == {}


def test_sparse_pairs_beside_a_crowd_are_found(spark):
    rng = np.random.default_rng(12)
    spread = rng.normal(size=(1500, 32))
    # pairs that are just in range, beside near copies that outnumber them
    near = vectors.unit(spread[:500])
    side = rng.normal(size=near.shape)
    side = vectors.unit(side - (side * near).sum(1, keepdims=True) * near)
    close = rng.uniform(0.901, 0.93, size=(500, 1))
    crowd = vectors.unit(rng.normal(size=(1, 32)))
    both = np.vstack([spread, near * close + side * np.sqrt(1 - close**2), crowd + 0.03 * rng.normal(size=(700, 32))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vectors.link(rows).collect()}
    want = (vectors.unit(both) @ vectors.unit(both).T >= 0.9).sum(1) - 1
    sparse = [i for i in range(len(both)) if 0 < want[i] <= vectors.FEW]
    share = np.mean([got[i]["n_links"] / want[i] for i in sparse])
    assert len(sparse) >= 900 and share >= 0.95 and all(r["n_links"] <= want[i] for i, r in got.items())
    assert {r["audit_recall"] for r in got.values()} <= {x for x in [got[0]["audit_recall"]] if x >= 0.95}
