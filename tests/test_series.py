from datetime import timedelta

from conftest import rows
from pyspark.sql import functions as F

from tempora.operators import episodes as E
from tempora.operators import features as X
from tempora.operators import labels as L
from tempora.operators import series as S
from tempora.operators import targets as T
from tempora.operators.calendar import hourly_spine


def frame(spark, hour, values, station="a"):
    data = [(station, hour(h), v) for h, v in values]
    return spark.createDataFrame(data, "station_id string, timestamp_utc timestamp, x double")


def sums(df, low, high, chunk=24):
    series = S.Chunked(df, ["station_id"], "timestamp_utc", back=max(0, -low), ahead=max(0, high), chunk=chunk)
    return [r[0] for r in rows(series.select("timestamp_utc", series.full_sum(F.col("x"), low, high).alias("s")).orderBy("timestamp_utc").select("s"))]


def test_window_needs_every_value(spark, hour):
    df = frame(spark, hour, list(enumerate([1.0, None, 3.0, 4.0, 5.0])))
    assert sums(df, -2, 0) == [None, None, None, None, 12.0]


def test_window_runs_on_the_clock(spark, hour):
    df = frame(spark, hour, [(h, 1.0) for h in (0, 1, 3, 4, 5)])
    assert sums(df, -2, 0) == [None, None, None, None, 3.0]


def test_prior_only_and_future(spark, hour):
    df = frame(spark, hour, list(enumerate([1.0, 2.0, 3.0, 4.0])))
    assert sums(df, -2, -1) == [None, None, 3.0, 5.0]
    ones = frame(spark, hour, [(h, 1.0) for h in range(5)])
    assert sums(ones, 1, 3) == [3.0, 3.0, None, None, None]


def test_chunk_borders_do_not_show(spark, hour):
    df = frame(spark, hour, [(h, float(h)) for h in range(60)])
    whole = sums(df, -5, 0, chunk=10_000)
    assert all(sums(df, -5, 0, chunk=c) == whole for c in (1, 3, 7, 24))


def test_lead_targets_keep_unknown(spark, hour):
    labels = frame(spark, hour, list(enumerate([1.0, None, 0.0]))).withColumnRenamed("x", "target")
    out = rows(T.lead_targets(labels).select("timestamp_utc", "target_1h", "target_1h_observed"), "timestamp_utc")
    assert [r[1] for r in out] == [None, 0.0, None]
    assert [r[2] for r in out] == [0, 1, 0]


def test_tri_state_labels(spark, hour):
    at = [(0, "TSRA"), (1, "HZ"), (2, "M")]
    data = [(i, "a", hour(h), hour(h), c) for i, (h, c) in enumerate(at)]
    reports = spark.createDataFrame(data, "report_id long, station_id string, valid_ts timestamp, valid_minute timestamp, wxcodes string")
    spine = hourly_spine(spark.createDataFrame([("a",)], "station_id string"), hour(0), hour(3))
    out = rows(L.hourly_labels(reports, spine).select("timestamp_utc", "target", "target_observed", "label_status"), "timestamp_utc")
    assert [r[1] for r in out] == [1.0, 0.0, None, None]
    assert [r[2] for r in out] == [1, 1, 0, 0]
    assert out[3][3] == "unavailable"


def test_duplicate_reports_keep_the_first(spark, hour):
    data = [(2, "a", hour(0) + timedelta(seconds=9), hour(0), "HZ"), (1, "a", hour(0) + timedelta(seconds=5), hour(0), "TS")]
    reports = spark.createDataFrame(data, "report_id long, station_id string, valid_ts timestamp, valid_minute timestamp, wxcodes string")
    assert rows(L.first_reports(reports).select("report_id")) == [(1,)]


def episode_rows(spark, hour, hours):
    labels = frame(spark, hour, [(h, 1.0) for h in hours]).withColumnRenamed("x", "target")
    return rows(E.episodes(labels).select("event_start", "event_end", "n_hours", "duration_h"), "event_start")


def test_episodes(spark, hour):
    out = episode_rows(spark, hour, [0, 2, 5, 6])
    assert out == [(hour(0), hour(2), 2, 3.0), (hour(5), hour(6), 2, 2.0)]


def brute_islands(hours, gap):
    runs = []
    for h in sorted(hours):
        if runs and h - runs[-1][-1] <= gap:
            runs[-1].append(h)
        else:
            runs.append([h])
    return [(r[0], r[-1], len(r)) for r in runs]


def test_islands_across_chunks_match_brute_force(spark, hour):
    hours = [h for h in range(200) if (h * 7919) % 11 < 4 or 40 <= h <= 120]
    df = frame(spark, hour, [(h, 1.0) for h in hours])
    for chunk in (1, 5, 24, 10_000):
        for gap in (1, 2, 5):
            got = rows(S.islands(df, ["station_id"], "timestamp_utc", gap, chunk).select("start", "end", "n"), "start")
            want = [(hour(a), hour(b), n) for a, b, n in brute_islands(hours, gap)]
            assert got == want, (chunk, gap)


def test_previous_row_over_empty_chunks(spark, hour):
    df = frame(spark, hour, [(h, 1.0) for h in (0, 1, 90, 91, 400)])
    out = rows(S.with_previous(df, ["station_id"], "timestamp_utc", "before", chunk=10).select("timestamp_utc", "before"), "timestamp_utc")
    assert [r[1] for r in out] == [None, hour(0), hour(1), hour(90), hour(91)]


def test_latest_complete_run(spark, hour):
    present = [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12]
    df = frame(spark, hour, [(h, 1.0 if h in present else None) for h in range(13)])
    out = rows(E.latest_complete_run(df, F.col("x").isNotNull(), F.lit(hour(12)), 6).select("run_start", "feature_hour", "run_hours", "trailing_skipped"))
    # the hour without a value is skipped as well as the four after it
    assert out == [(hour(0), hour(7), 8, 5)]


def test_select_cases_prefers_each_season_then_length(spark, hour):
    from datetime import datetime

    starts = [datetime(2023, m, d, 1) for m, d in ((1, 1), (1, 5), (1, 9), (4, 1), (7, 1), (11, 1), (1, 20))]
    lengths = [3, 9, 5, 2, 4, 30, 8]
    data = [("a", s, s + timedelta(hours=n - 1), n, float(n)) for s, n in zip(starts, lengths)]
    df = spark.createDataFrame(data, "station_id string, event_start timestamp, event_end timestamp, n_hours long, duration_h double")
    out = rows(E.select_cases(df).select("event_start", "event_id"), "event_start")
    # one per season (winter 9, spring 2, monsoon 4; the 30-hour one is too long), then the longest of the rest
    assert [r[0] for r in out] == [starts[1], starts[2], starts[6], starts[3], starts[4]]
    assert out[0][1] == "a_TS_01_20230105T01"


def brute_control(labels, start, end, last):
    for days in E.CONTROL_OFFSETS_DAYS:
        a, b = start + 24 * days, end + 24 * days
        if a < 0 or b > last:
            continue
        span = [labels.get(h) for h in range(a - 6, b + 7) if h in labels]
        nxt = [labels.get(h + 1) for h in range(a - 6, b + 7) if h in labels]
        if span and all(v is not None for v in span) and 1.0 not in span and 1.0 not in nxt:
            return days
    return None


def test_controls_match_brute_force(spark, hour):
    last = 24 * 60 - 1
    labels = {h: (None if h % 211 == 0 else 1.0 if h % 97 < 2 else 0.0) for h in range(last + 1)}
    events = [(500, 501), (679, 680), (776, 777), (873, 874)]
    cases = spark.createDataFrame(
        [("a", f"a_TS_{i:02d}_x", hour(s), hour(e)) for i, (s, e) in enumerate(events)],
        "station_id string, event_id string, event_start timestamp, event_end timestamp",
    )
    table = frame(spark, hour, list(labels.items())).withColumnRenamed("x", "target")
    got = {r["event_id"]: r["offset_days"] for r in E.find_controls(cases, T.lead_targets(table), hour(0), hour(last)).collect()}
    want = {f"a_TS_{i:02d}_x": brute_control(labels, s, e, last) for i, (s, e) in enumerate(events)}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert got


def weather(spark, hour, n):
    names = ["temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_speed_10m", "wind_direction_10m", "precipitation", "cloud_cover"]
    data = [("a", hour(h), *[float((h * (i + 3)) % 17) for i in range(7)], 1.0, 2.0, 3.0) for h in range(n)]
    schema = "station_id string, timestamp_utc timestamp, " + ", ".join(f"{c} double" for c in names) + ", latitude double, longitude double, elevation_m double"
    return spark.createDataFrame(data, schema)


def test_features_match_pandas(spark, hour):
    import numpy as np

    df = weather(spark, hour, 80)
    got = X.station_features(df).toPandas().sort_values("timestamp_utc").reset_index(drop=True)
    pdf = df.toPandas()
    for stem, source in X.SOURCES.items():
        for h in X.LAG_HOURS:
            np.testing.assert_allclose(got[f"{stem}_lag_{h}h"], pdf[source].shift(h))
        for h in X.CHANGE_HOURS:
            np.testing.assert_allclose(got[f"{stem}_change_{h}h"], pdf[source] - pdf[source].shift(h))
    for h in X.SUM_HOURS:
        np.testing.assert_allclose(got[f"precipitation_roll_sum_{h}h"], pdf["precipitation"].rolling(h).sum())
    for stem in X.MEAN_STEMS:
        for h in X.MEAN_HOURS:
            np.testing.assert_allclose(got[f"{stem}_roll_mean_{h}h"], pdf[X.SOURCES[stem]].rolling(h).mean())
    assert len(X.FEATURES) == 73 and X.drop_warm_up(X.station_features(df)).count() == 80 - 24


def test_same_result_for_any_partitioning(spark, hour):
    df = weather(spark, hour, 60)
    results = []
    for n in (1, 4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(rows(X.station_features(df.repartition(n)).select("timestamp_utc", *X.ROLLS), "timestamp_utc"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def test_empty_input_keeps_the_schema(spark, hour):
    empty = weather(spark, hour, 1).filter("false")
    out = X.station_features(empty)
    assert out.count() == 0 and set(X.FEATURES) <= set(out.columns)
    labels = frame(spark, hour, [(0, 1.0)]).withColumnRenamed("x", "target").filter("false")
    assert E.episodes(labels).count() == 0
    assert T.lead_targets(labels).count() == 0
