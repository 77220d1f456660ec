import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tempora.operators import evaluate as E
from tempora.operators import ordered as R
from tempora.operators import splits as S

SCORES = [(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)]


def scored(spark, data):
    df = spark.createDataFrame([("1h", "a", p, y) for p, y in data], "lead string, station_id string, p double, y int")
    return df


def groups(spark, data):
    return E.score_groups(scored(spark, data), ["lead"])


def test_sweep_collapses_ties(spark):
    out = rows(E.sweep(groups(spark, SCORES), ["lead"]).select("threshold", "tp", "fp"), F.desc("threshold"))
    assert out == [(0.9, 1, 0), (0.5, 2, 1), (0.1, 2, 2)]


def test_threshold_under_cap(spark):
    row = E.choose_threshold(E.sweep(groups(spark, SCORES), ["lead"]), ["lead"], cap=0.5).first()
    assert row["threshold"] == 0.9 and row["guardrail_binding"] and row["candidates"] == 3


def test_no_threshold_under_cap_is_unknown(spark):
    row = E.choose_threshold(E.sweep(groups(spark, [(0.5, 1), (0.5, 0)]), ["lead"]), ["lead"], cap=0.2).first()
    assert row["threshold"] is None and row["candidates_inside"] == 0


def test_ap_and_auc(spark):
    row = E.ranking(groups(spark, SCORES), ["lead"]).first()
    assert row["pr_auc"] == pytest.approx(0.8333333333) and row["roc_auc"] == pytest.approx(0.875)


def test_one_class(spark):
    row = E.metrics(scored(spark, [(0.9, 0), (0.1, 0)]), ["lead"], None).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["precision"] == 0 and row["recall"] == 0


def brute_ranking(data):
    pos = [p for p, y in data if y]
    neg = [p for p, y in data if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted({p for p, _ in data}, reverse=True):
        tp = sum(p >= t for p in pos)
        ap += (tp - seen) / len(pos) * tp / sum(p >= t for p, _ in data)
        seen = tp
    return auc, ap


def test_ranking_matches_brute_force(spark):
    data = [(((i * 37) % 50) / 50, int((i * 7) % 5 == 0)) for i in range(300)]
    row = E.ranking(groups(spark, data), ["lead"]).first()
    assert (row["roc_auc"], row["pr_auc"]) == pytest.approx(brute_ranking(data))


def test_bins_keep_empty_rows(spark):
    out = E.bin_table(E.labelled(scored(spark, SCORES).withColumns({"alert": F.lit(1), "verdict": F.lit("TP")})))
    by = {(r["lead"], r["bin_no"]): r["n"] for r in out.collect()}
    assert len(by) == 21 and by[("1h", 7)] == 3 and by[("1h", 5)] == 1 and by[("2h", 1)] == 0


def test_running_sums_over_wide_ranges(spark):
    values = [float(v) for v in (-1e9, -3, -3, 0, 0.0000001, 0.5, 2, 2, 2, 7e5, 7e5 + 1e-3, 1e12)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, x double")
    out = rows(R.running_sums(R.value_groups(df, ["k"], "x"), ["k"], "x", ["n"]).select("x", "n_upto", "n_all"), "x")
    distinct = sorted(set(values))
    assert [r[1] for r in out] == [sum(v <= d for v in values) for d in distinct]
    assert {r[2] for r in out} == {len(values)}


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_percentiles_match_numpy(spark, n):
    values = [float((i * 7919) % 101) ** 1.5 - 50 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = R.pooled_percentiles(df, "x", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}).first()
    assert list(row) == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.9, 1])))


def test_split_by_unique_hours(spark, hour):
    data = [(s, hour(h)) for s in ("a", "b") for h in range(20)]
    df = spark.createDataFrame(data, "station_id string, timestamp_utc timestamp")
    row = S.hour_cutoffs(df).first()
    assert (row["train_hours"], row["validation_hours"], row["test_hours"]) == (14, 3, 3)
    counts = {r["split"]: r["count"] for r in S.with_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 28, "validation": 6, "test": 6}


def test_alert_patterns(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (0, 0, 0), (1, None, 0)], "alert_1h int, alert_2h int, alert_3h int")
    by = {r["pattern"]: r["count"] for r in E.alert_patterns(df).collect()}
    assert by["110"] == 2 and by["000"] == 1 and by["111"] == 0 and by["N_comparable"] == 3
    assert by["alert_freq_1h"] == 2 and by["transition_2h_ne_3h"] == 2
