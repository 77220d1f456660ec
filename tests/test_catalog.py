import os
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tempora.operators import features as X
from tempora.plans import experiments as P
from tempora.sources import views as V
from tempora.catalog import feed
from tempora.streaming import live, state

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_check_has_a_plan():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


@needs_data
def test_entry_gives_labels_on_the_whole_calendar(spark):
    out = entry.entry(spark)
    assert out.count() == 5 * 720
    assert out.filter("target IS NULL AND target_observed = 1").count() == 0


@needs_data
@pytest.mark.parametrize("name", ["hourly_labels", "station_features", "asof_90min", "scan_station_features", "strike_counts_by_radius", "full_snapshot"])
def test_no_nested_loop_and_no_python(spark, name):
    text = plan_text(entry.queries()[name](spark, DATA))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython", text)


@needs_data
def test_time_filter_and_columns_reach_the_scan(spark):
    text = plan_text(entry.queries()["closed_time_window"](spark, DATA))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", text)
    assert "props" not in re.search(r"ReadSchema: \S+", text).group(0)


@needs_data
def test_one_sort_and_one_chunk_shuffle_serve_all_features(spark):
    hours = V.atmos(spark, DATA).join(V.stations(spark).select("station_id", *X.LOCATION), "station_id")
    text = plan_text(X.station_features(hours).select(*X.FEATURES))
    assert text.split("Initial Plan")[0].count("+- Window") + text.split("Initial Plan")[0].count("Window [") <= 2


@needs_data
def test_hourly_sums_from_one_scan(spark):
    from tempora.catalog.evaluate import scores_only

    assert plan_text(scores_only(spark, DATA)).split("Initial Plan")[0].count("FileScan parquet") == 1


def test_stream_of_hours_equals_batch(spark, hour):
    data = [(s, hour(h), float((h * k) % 13)) for k, s in ((3, "a"), (5, "b")) for h in range(48) if (h * k) % 7]
    df = spark.createDataFrame(data, "station_id string, timestamp_utc timestamp, precipitation double")
    written = feed.run_feed(df, "t", 3, hour(0), hour(47), lambda h: live.trailing_totals(h, "precipitation", 3, "1 hour"))
    got = {(r[0], r[1]): r[2] for r in rows(written.select("station_id", "timestamp_utc", "total"))}
    from tempora.operators.series import Chunked

    series = Chunked(df, ["station_id"], "timestamp_utc", back=3)
    batch = series.select("station_id", "timestamp_utc", series.full_sum(F.col("precipitation"), -2, 0).alias("s"))
    want = {(r[0], r[1]): r[2] for r in rows(batch)}
    closed = {k: v for k, v in want.items() if k[1] <= hour(44)}
    assert closed and all(got[k] == v for k, v in closed.items())


def test_history_state_over_several_deliveries(spark, hour):
    df = spark.createDataFrame([("a", hour(h), float(h)) for h in range(60)], "station_id string, timestamp_utc timestamp, x double")
    written = feed.run_feed(df, "r", 4, hour(0), hour(59), lambda h: state.history(h, "x"), "update")
    out = rows(written.select("timestamp_utc", "history_rows", "ready", "sum_24h", "lag_24h"), "timestamp_utc")
    assert len(out) == 60
    assert out[23][2] is False and out[24][2] is True
    assert out[50][3] == sum(range(27, 51)) and out[50][4] == 26.0 and out[5][3] is None


def test_repeated_hours_are_dropped(spark, hour):
    df = spark.createDataFrame([("a", hour(h), float(i)) for i in range(2) for h in range(5)], "station_id string, timestamp_utc timestamp, x double")
    written = feed.run_feed(df, "d", 1, hour(0), hour(4), lambda h: live.first_seen(h, ["station_id", "timestamp_utc"], "timestamp_utc", "1 hour"))
    assert written.count() == 5


def test_live_status_gates(spark, hour):
    hours = spark.createDataFrame(
        [("fresh", hour(9), 1.0), ("fresh", hour(11), 9.0), ("stale", hour(6), 1.0), ("bare", hour(9), None), ("dark", hour(9), 1.0)],
        "station_id string, timestamp_utc timestamp, x double",
    )
    model = spark.createDataFrame([(s, hour(h)) for s in ("fresh", "stale") for h in range(7, 13)], "station_id string, timestamp_utc timestamp")
    out = {r["station_id"]: (r["observed"], r["reason"]) for r in live.score_ready(hours, model, ["x"], F.lit(hour(10))).collect()}
    assert out["fresh"] == (hour(9), None)
    assert out["stale"][1] == "stale_observation"
    assert out["bare"][1] == "no_complete_hour"
    assert out["dark"][1] == "forecast_horizon_unavailable"


def model_rows(spark, hour):
    data = []
    for s in ("a", "b"):
        for h in range(400):
            x = float((h * 31) % 100)
            y = None if h % 50 == 0 else float(x > 80)
            data.append((s, hour(h), y, x, float((h * 17) % 10)))
    return spark.createDataFrame(data, "station_id string, timestamp_utc timestamp, target_1h double, x double, noise double")


def test_forest_learns_and_threshold_is_locked_on_validation(spark, hour):
    out = P.compare_feature_sets(model_rows(spark, hour), {"A": ["x", "noise"]}, ["target_1h"], trees=10, depth=4).collect()
    by = {r["split"]: r for r in out}
    assert by["test"]["pr_auc"] > 0.95 and by["test"]["limit"] == by["validation"]["limit"]


def test_balanced_weights_sum_to_equal_classes(spark, hour):
    weighted = P.balanced(P.labelled(model_rows(spark, hour), "target_1h"))
    sums = [r[0] for r in weighted.groupBy("y").agg(F.sum("weight")).select("sum(weight)").collect()]
    assert sums[0] == pytest.approx(sums[1])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_partner_is_a_permutation_for_every_key(spark, n):
    got = spark.range(n).select(*[P.partner(F.col("id"), F.lit(n).cast("long"), F.lit(k)).alias(f"k{k}") for k in range(4)]).collect()
    orders = [[r[k] for r in got] for k in range(4)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 64 or len({tuple(o) for o in orders}) == 4 and all(sum(i == x for i, x in enumerate(o)) < 8 for o in orders)


def test_places_are_gapless_and_do_not_depend_on_partitions(spark, hour):
    table = model_rows(spark, hour)
    one, many = (P.numbered(t, buckets=16).select("station_id", "timestamp_utc", "place") for t in (table.coalesce(1), table.repartition(7)))
    assert rows(one, "place") == rows(many, "place") and [r["place"] for r in one.orderBy("place").collect()] == list(range(800))


def test_permutation_moves_one_feature_and_keeps_its_values(spark, hour):
    base = P.numbered(model_rows(spark, hour)).select("place", F.lit(1).alias("y"), F.array("x", "noise").alias("x")).persist()
    own = {r["place"]: r["x"] for r in base.collect()}
    moved = P.permuted(base, 800, 3).collect()
    assert len(moved) == 800 * 2 * 3
    orders = set()
    for at in (0, 1):
        for repeat in range(3):
            part = {r["place"]: r["x"] for r in moved if (r["at"], r["repeat"]) == (at, repeat)}
            assert all(part[k][1 - at] == own[k][1 - at] for k in own) and len(part) == 800
            assert sorted(x[at] for x in part.values()) == sorted(x[at] for x in own.values())
            orders.add(tuple(part[k][at] for k in sorted(part)))
    assert len(orders) == 6
    base.unpersist()


def test_importance_finds_the_feature_that_decides(spark, hour):
    table = P.labelled(P.vectors(model_rows(spark, hour), ["x", "noise"], ["target_1h"]), "target_1h")
    seen = table.withColumn("features", P.sliced(["x", "noise"], ["x", "noise"]))
    model = P.estimator(trees=10, depth=4).fit(P.balanced(seen).select("features", F.col("y").cast("double").alias("y"), "weight"))
    got = {r["feature"]: r for r in P.permutation_importance(model, seen, ["x", "noise"], 3).collect()}
    assert got["x"]["importance_mean"] > 0.4 > 0.05 > abs(got["noise"]["importance_mean"])
    empty = P.permutation_importance(model, seen.limit(0), ["x", "noise"], 3)
    assert empty.count() == 0


def test_feature_sets_are_slices_of_one_vector_and_train_is_judged(spark, hour):
    out = P.compare_feature_sets(model_rows(spark, hour), {"x": ["x"], "both": ["noise", "x"], "noise": ["noise"]}, ["target_1h"], trees=5, depth=3).collect()
    skill = {(r["experiment"], r["split"]): r["pr_auc"] for r in out}
    assert {s for _, s in skill} == {"train", "validation", "test"}
    assert min(skill["x", "test"], skill["both", "test"]) > 0.9 > skill["noise", "test"]


def test_without_complete_rows_there_is_no_score(spark, hour):
    table = model_rows(spark, hour).withColumn("x", F.lit(None).cast("double"))
    assert P.compare_feature_sets(table, {"x": ["x"]}, ["target_1h"], trees=5, depth=3).count() == 0


def test_every_station_is_held_out_when_none_is_named(spark, hour):
    out = P.leave_one_station_out(model_rows(spark, hour), ["x"], ["target_1h"], trees=5, depth=3)
    assert {r["experiment"] for r in out.collect()} == {"a", "b"}


def test_held_out_station_never_trains(spark, hour):
    from tempora.operators.splits import with_split

    out = P.leave_one_out(with_split(model_rows(spark, hour)), "b")
    assert {(r[0], r[1]) for r in rows(out.select("split", "station_id").distinct())} == {("train", "a"), ("validation", "a"), ("test", "b")}


def test_incomplete_rows_are_not_scored(spark, hour):
    table = P.labelled(model_rows(spark, hour), "target_1h").filter("y IS NOT NULL")
    model = P.fit(table, ["x"], trees=5, depth=3)
    requests = spark.createDataFrame([("a", hour(0), "COMPLETE", 90.0), ("b", hour(0), "UNAVAILABLE", None)], "station_id string, timestamp_utc timestamp, data_status string, x double")
    out = {r["station_id"]: r["p_1h"] for r in P.score_leads({1: model}, requests, ["x"]).collect()}
    assert out["a"] > 0.5 and out["b"] is None
