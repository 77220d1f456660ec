"""Stages of the corpus pipeline against brute force, with null and repeated ids."""

import random

import corpus_pipeline as pipeline

WORDS = [f"w{i}" for i in range(40)]
NEAR = [" ".join([*WORDS, tail]) for tail in ("alpha", "beta", "gamma")]
FAR = [" ".join(f"f{k}x{i}" for i in range(30)) for k in range(4)]
ROWS = [
    (None, NEAR[0]), (None, NEAR[1]), (None, " ".join(FAR[0].split() + ["x"])), (None, FAR[0]),
    (5, FAR[1]), (5, FAR[1] + " y"), (5, FAR[1] + " z"), (6, FAR[1] + " v"), (5, FAR[1]), (7, NEAR[2]), (8, None), (8, ""), (9, FAR[2]), (5, FAR[3]), (None, None),
]


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def table(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "en") for i, t in rows], "doc_id long, text string, n_chars long, lang string")


def save(spark, path, name, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/{name}.parquet")


def test_one_document_of_each_group_stays(spark):
    got = pipeline.jaccard_join(spark, table(spark, ROWS), "").collect()
    groups = []
    for row in dict.fromkeys(ROWS):
        own = shingles(row[1])
        hits = [g for g in groups if own and any(100 * len(own & shingles(t)) >= 75 * len(own | shingles(t)) for _, t in g)]
        groups = [g for g in groups if g not in hits] + [sum(hits, [row])]
    ids = lambda rows: sorted((i is None, i or 0) for i, _ in rows)
    kept = [(r.doc_id, r.text) for r in got]
    for group in groups:
        own = [r for r in kept if r in group]
        # null and empty texts of one id have one fingerprint
        assert ids(own) == ids(group)[:1] or not any(shingles(t) for _, t in group), (group, own)
    assert sum(bool(shingles(t)) for _, t in kept) == sum(bool(shingles(g[0][1])) for g in groups)


def test_line_dedup_keeps_first_places_and_drops_emptied_documents(spark):
    para = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a\n{para}\nb"), (2, f"c\n{para}\nd"), (None, para), (3, None), (3, "short")]
    got = {(r.doc_id, r.text, r.n_chars) for r in pipeline.line_dedup(spark, table(spark, rows), "").collect()}
    assert got == {(1, rows[0][1], len(rows[0][1])), (2, "c\nd", 3), (3, None, 0), (3, "short", 5)}


def test_decontamination_drops_documents_with_a_window(spark, tmp_path):
    item = " ".join(WORDS[:10])
    save(spark, tmp_path, "benchmark", [(1, item), (None, None)], "item_id long, text string")
    got = pipeline.benchmark_decontamination(spark, table(spark, ROWS), str(tmp_path)).collect()
    want = [r for r in ROWS if item not in (r[1] or "")]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_quality_keeps_what_the_model_keeps(spark, tmp_path):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(["the", "thing", "that", "there"]) for _ in range(50))) for i in range(150)]
    save(spark, tmp_path, "labels", [(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    odd = [(200, "@@## ~~ %% xq zzq"), (None, "@@## ~~ %% xq zzq"), (200, good[0][1]), (None, None)]
    got = [(r.doc_id, r.text) for r in pipeline.quality_classifier(spark, table(spark, good + odd), str(tmp_path)).collect()]
    assert not set(odd[:2]) & set(got) and set(odd[2:]) <= set(got) and len(got) > 140


def test_packing_takes_every_document(spark):
    got = pipeline.pack(spark, table(spark, ROWS), "").collect()
    assert {r.doc_id for r in got} == {i for i, _ in ROWS} and sum(r.start == 0 for r in got) == len(ROWS)
