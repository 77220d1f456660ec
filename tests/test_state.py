"""Streams against batch: state over shuffled and late rows, timers, two streams, backfill of single parts."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from conftest import START, rows
from pyspark.sql import functions as F

from tempora.catalog import feed
from tempora.operators import labels as L
from tempora.session import scratch_path
from tempora.streaming import live, state

HOUR = timedelta(hours=1)


def plain_history(hours):
    """{(station, hour): (rows, ready, sum of 24, value 24 hours before)}"""
    out = {}
    for (s, t), _ in hours.items():
        held = [hours.get((s, t - i * HOUR)) for i in range(25)]
        n = sum(x is not None for x in held)
        out[s, t] = (n, n == 25, sum(held[23::-1]) if None not in held[:24] else None, held[24])
    return out


@pytest.mark.parametrize("deliveries", [1, 6])
def test_shuffled_backlog_in_small_arrow_batches_equals_batch(spark, deliveries):
    r = random.Random(deliveries)
    hours = {(s, START + i * HOUR): float(r.randrange(100)) for s in "abc" for i in range(150) if r.random() > 0.03}
    data = [(s, t, x, r.randrange(deliveries)) for (s, t), x in hours.items()]
    data += [(s, t, None, 0) for s, t, _, _ in data[:5]] + [("a", t, 1e6, deliveries - 1) for s, t, _, d in data if s == "a" and d < deliveries - 1][:20]
    r.shuffle(data)
    df = spark.createDataFrame(data, "station_id string, timestamp_utc timestamp, x double, n int")
    source = feed.deliver(df, "shuffled", [F.col("n") == i for i in range(deliveries)])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        written = live.run_to_table(state.history(live.read_files(spark, source, df.schema, files=1), "x", late=200), "shuffled", "update")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {(q[0], q[1]): tuple(q[2:]) for q in rows(live.latest_per_key(written, live.KEY))}
    assert got == plain_history(hours)


def test_state_forgets_what_no_result_needs_and_leaves_out_what_is_too_late(spark):
    data = [("a", START + i * HOUR, float(i), 0) for i in range(100)] + [("a", START - 60 * HOUR, 5.0, 1), ("a", START + 100 * HOUR, 1.0, 1)]
    df = spark.createDataFrame(data, "station_id string, timestamp_utc timestamp, x double, n int")
    source = feed.deliver(df, "late", [F.col("n") == i for i in range(2)])
    plan = state.history(live.read_files(spark, source, df.schema, files=1), "x", late=10)
    got = {q[1]: q[2:5] for q in rows(live.run_to_table(plan, "late", "update"))}
    assert START - 60 * HOUR not in got and got[START + 100 * HOUR] == (25, True, sum(range(77, 100)) + 1.0)


def test_a_silent_station_flips_by_its_timer(spark):
    r = random.Random(9)
    said = {s: sorted(START + timedelta(seconds=r.randrange(200 * 3600)) for _ in range(40)) for s in "ab"}
    said["dark"] = [START + timedelta(minutes=5)]
    said["clock"] = [START + timedelta(minutes=90 * i) for i in range(134)]
    data = [(s, t, min(int((t - START).total_seconds() // 144000), 4)) for s, ts in said.items() for t in ts]
    df = spark.createDataFrame(data, "station_id string, t timestamp, n int")
    source = feed.deliver(df, "said", [F.col("n") == i for i in range(5)])
    plan = state.silences(live.read_files(spark, source, df.schema, files=1), "t", "30 minutes")
    got = sorted(tuple(q) for q in rows(live.run_to_table(plan, "said").select("station_id", "since", "status")))
    mark, limit, want = max(t for ts in said.values() for t in ts) - timedelta(minutes=30), timedelta(minutes=180), []
    for s, ts in said.items():
        ts = [t for t in ts if t <= mark]
        for t, after in zip(ts, [*ts[1:], None]):
            want += [(s, t + limit, "UNAVAILABLE")] if (after or mark) > t + limit else []
        want += [(s, t, "LIVE") for t, before in zip(ts, [None, *ts]) if before is None or t - before > limit]
    assert got == sorted(want) and [q[2] for q in got if q[0] == "dark"] == ["LIVE", "UNAVAILABLE"]


def test_waiting_rows_are_held_as_spans(spark):
    talk = [("a", START + timedelta(seconds=i), 0) for i in range(900)] + [("a", START + timedelta(minutes=30, seconds=i), 0) for i in range(300)]
    late = [("a", START + timedelta(minutes=20), 1), ("b", START + timedelta(minutes=70), 1)]
    df = spark.createDataFrame(talk + late, "station_id string, t timestamp, n int")
    source = feed.deliver(df, "talk", [F.col("n") == i for i in range(2)])
    root = scratch_path(spark, "talk")
    plan = state.silences(live.read_files(spark, source, df.schema, files=1), "t", "35 minutes", 12)
    live._drain(plan, root, "append", None)
    said = rows(spark.read.parquet(f"{root}/data").select("station_id", "since", "status"), "since")
    # the late row fills the gap; the watermark ends at 35 minutes, when the station has not been silent for long enough
    assert said == [("a", START, "LIVE")]
    held = spark.read.format("statestore").option("stateVarName", "waiting").option("batchId", 0).load(f"{root}/checkpoint")
    spans = [tuple(q) for q in rows(held.select("list_element.*"))]
    micros = lambda minutes, seconds: int((START - datetime(1970, 1, 1)).total_seconds() + 60 * minutes + seconds) * 1_000_000
    assert sorted(spans) == [(micros(0, 0), micros(0, 899)), (micros(30, 0), micros(30, 299))]


def test_forecasts_that_come_late_meet_their_hours(spark, hour):
    hours = spark.createDataFrame([(s, hour(i), i // 20) for s in "ab" for i in range(60)], "station_id string, timestamp_utc timestamp, n int")
    model = [(s, hour(i), (i // 20 + (i % 4 == 0)) % 4) for s in "ab" for i in range(0, 64) if i % 7]
    model = spark.createDataFrame(model, hours.schema)
    sides = [live.read_files(spark, feed.deliver(x, "side", [F.col("n") == i for i in range(4)]), x.schema, files=1) for x in (hours, model)]
    got = sorted(tuple(q) for q in rows(live.run_to_table(state.forecast_pairs(*sides, 3, "3 days"), "pairs").drop("batch_id")))
    want = [(s, hour(t), hour(v)) for s in "ab" for t in range(60) for v in range(t + 1, t + 4) if v < 64 and v % 7]
    assert got == sorted(want)


def test_backfill_rewrites_touched_parts_alone(spark):
    r = random.Random(2)
    data = [(i, s, START + timedelta(minutes=r.randrange(5 * 1440)), r.random() < 0.5) for i, s in enumerate("ab" * 300)]
    table = "report_id int, station_id string, valid_ts timestamp, decodable boolean"
    df = spark.createDataFrame(data, table).withColumn("ts_station", F.col("report_id") % 3 == 0).withColumn("ts_vicinity", F.lit(False))
    root = [scratch_path(spark, x) for x in ("archive", "table", "metrics")]
    each = live.hourly_backfill(L.hourly_counts, *root, "1 HOUR")
    late = (F.col("station_id") == "a") & (F.to_date("valid_ts") == "2024-01-02") & (F.col("report_id") % 4 == 0)
    each(df.filter(~late), 0)
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(root[1].removeprefix("file:")).rglob("*.parquet")}
    before = files()
    for _ in range(2):  # a repeated micro-batch changes nothing
        done = rows(each(df.filter(late), 1))
        after = files()
        parts = lambda found: {p.parent for p in found}
        touched = parts(p for p in after if before.get(p) != after[p])
        assert {f"{p.parent.name}/{p.name}" for p in touched} == {"station=a/day=2024-01-02"} and parts(after) == parts(before)
        names = ["station_id", "timestamp_utc", "n_reports", "n_reports_with_wx", "n_ts_reports"]
        assert rows(spark.read.parquet(root[1]).select(*names), *names) == rows(L.hourly_counts(df).select(*names), *names)
        n = sum(s == "a" and str(t)[:10] == "2024-01-02" and i % 4 == 0 for i, s, t, _ in data)
        assert done[0][:3] == (1, n, n) and done[0][4] == 1


def test_history_with_time_to_live_on_a_clock_trigger(spark):
    df = spark.createDataFrame([("a", START + i * HOUR, float(i)) for i in range(30)], "station_id string, timestamp_utc timestamp, x double")
    source, got = feed.deliver(df, "ttl", [F.lit(True)]), []
    plan = state.history(live.read_files(spark, source, df.schema), "x", ttl_ms=3_600_000)
    save = lambda batch, _: got.extend(batch.collect())
    query = plan.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", scratch_path(spark, "ttl")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if got or not query.isActive:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert len(got) == 30 and sum(q["ready"] for q in got) == 6
