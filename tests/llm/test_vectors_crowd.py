import numpy as np

from tempora.llm import vectors


def test_crowded_shards_are_compared_by_pairs_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1300, 16))
    base[:500] = base[0] + 0.25 * rng.normal(size=(500, 16))
    base[700:710] = base[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    # the rows of each group that a task compares
    groups, pairs = [], vectors.block_pairs
    monkeypatch.setattr(vectors, "CROWD", 150)
    monkeypatch.setattr(vectors, "BLOCK", 50)

    def seen(members, crowded):
        made = pairs(members, crowded)
        groups.extend(r["count"] for r in made.groupBy("shard", "low", "high").count().collect())
        return made

    monkeypatch.setattr(vectors, "block_pairs", seen)
    got = {r.vec_id: r for r in vectors.link(rows).collect()}
    near = vectors.unit(base) @ vectors.unit(base).T >= 0.9
    assert groups and max(groups) <= 150
    want = near.sum(1) - 1
    assert all(got[i].n_links <= want[i] for i in got) and sum(r.n_links for r in got.values()) >= 0.95 * want.sum()
    assert {got[i].component_id for i in range(500) if want[i] > 100} == {0}
