import math
import random
from datetime import timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tempora.operators import joins as J
from tempora.operators import spatial as P
from tempora.operators.profile import column_profile, correlations


def hours_df(spark, hour, ns):
    return spark.createDataFrame([("a", hour(n)) for n in ns], "station_id string, timestamp_utc timestamp")


def scans_df(spark, data):
    return spark.createDataFrame([("a", *d) for d in data], "station_id string, acq_end timestamp, gid long, cloudy double")


def asof(spark, hour, scans, ns=(10,)):
    out = J.asof_hourly(hours_df(spark, hour, ns), scans_df(spark, scans), "acq_end", "gid", ["cloudy"])
    return rows(out.select("timestamp_utc", "gid", "age_minutes", "sat_available"), "timestamp_utc")


def test_asof_limits(spark, hour):
    ten = hour(10)
    for minutes, want in ((91, None), (90, 90.0), (0, 0.0), (-1, None)):
        (row,) = asof(spark, hour, [(ten - timedelta(minutes=minutes), 1, 0.5)])
        assert row[2] == want and row[3] == int(want is not None)


def test_asof_tie_takes_the_smaller_id(spark, hour):
    at = hour(9) + timedelta(minutes=42)
    assert asof(spark, hour, [(at, 10, 0.1), (at, 9, 0.2)])[0][1] == 9


def test_asof_latest_scan_wins_and_serves_two_hours(spark, hour):
    early, late = hour(8) + timedelta(minutes=40), hour(8) + timedelta(minutes=50)
    out = asof(spark, hour, [(early, 1, 0.1), (late, 2, 0.2)], (9, 10, 11))
    assert [(r[1], r[2]) for r in out] == [(2, 10.0), (2, 70.0), (None, None)]


def test_windows_join_gives_each_pair_once(spark, hour):
    points = scans_df(spark, [(hour(n) + timedelta(minutes=17), n, 0.0) for n in range(30)])
    windows = spark.createDataFrame(
        [("a", "w1", hour(3), hour(9)), ("a", "w2", hour(8) + timedelta(minutes=17), hour(8) + timedelta(minutes=17))],
        "station_id string, w string, lo timestamp, hi timestamp",
    )
    for bins in (1, 5, 24):
        out = rows(J.within_windows(points, windows, "acq_end", "lo", "hi", bin_hours=bins).select("w", "gid"), "w", "gid")
        assert out == [("w1", n) for n in range(3, 9)] + [("w2", 8)]


def test_expected_slots(spark, hour):
    w = spark.createDataFrame([("a", hour(0) + timedelta(minutes=10), hour(1) + timedelta(minutes=15))], "station_id string, lo timestamp, hi timestamp")
    got = [r[0] for r in rows(J.expected_slots(w, "lo", "hi").select("slot"), "slot")]
    assert got == [hour(0) + timedelta(minutes=m) for m in (15, 45, 75)]


def test_join_audit(spark, hour):
    out = rows(J.join_audit(hours_df(spark, hour, [0, 1, 2]), hours_df(spark, hour, [2, 3])))
    assert out == [("a", 1, 2, 1, 33.3333)]


def brute_distance(a, b, c, d):
    p = math.radians
    x = math.sin(p(c - a) / 2) ** 2 + math.cos(p(a)) * math.cos(p(c)) * math.sin(p(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))


ANCHORS = [("s1", 10.0, 20.0), ("s2", 0.2, 179.9), ("s3", -60.0, -179.95), ("s4", 80.0, 0.0)]


def points_list(n):
    return [(i, ((i * 7919) % 17000) / 100 - 85, ((i * 104729) % 36000) / 100 - 180) for i in range(n)]


def test_radius_join_matches_brute_force(spark):
    points = points_list(3000)
    p = spark.createDataFrame(points, "point_id int, lat double, lon double")
    a = spark.createDataFrame(ANCHORS, "station_id string, latitude double, longitude double")
    for radius in (150.0, 900.0):
        got = set(rows(P.points_within(p, a, radius).select("station_id", "point_id")))
        want = {(s, i) for s, la, lo in ANCHORS for i, x, y in points if brute_distance(la, lo, x, y) <= radius}
        assert got == want and want


def test_radius_join_at_the_pole_and_the_date_line(spark):
    anchors = [("pole", 89.5, 0.0), ("line", 10.0, 179.95), ("south", -89.9, 120.0)]
    points = [(i, la, lo) for i, (la, lo) in enumerate([(89.5, 180.0), (89.0, -90.0), (88.0, 0.0), (10.0, -179.95), (10.2, 179.0), (-89.8, -60.0), (-88.0, 120.0)])]
    p = spark.createDataFrame(points, "point_id int, lat double, lon double")
    a = spark.createDataFrame(anchors, "station_id string, latitude double, longitude double")
    got = set(rows(P.points_within(p, a, 150.0).select("station_id", "point_id")))
    assert got == {(s, i) for s, la, lo in anchors for i, x, y in points if brute_distance(la, lo, x, y) <= 150.0}
    assert ("pole", 0) in got and ("line", 3) in got


def test_nearest_matches_brute_force(spark):
    points = points_list(150)
    p = spark.createDataFrame(points, "point_id int, lat double, lon double").withColumn("g", F.col("point_id") % 2)
    a = spark.createDataFrame(ANCHORS, "station_id string, latitude double, longitude double")
    grouped = a.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1))))
    got = {(r["g"], r["station_id"]): r["point_id"] for r in P.nearest(p, grouped, ["g"], ["point_id"], ["point_id"]).collect()}
    for g in (0, 1):
        for s, la, lo in ANCHORS:
            near = min((brute_distance(la, lo, x, y), i) for i, x, y in points if i % 2 == g)
            assert got[(g, s)] == near[1]


def test_nearest_descends_the_pyramid_at_poles_and_the_date_line(spark):
    rng = random.Random(5)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)]
    points += [(300, 90.0, 10.0), (301, -90.0, 0.0), (302, 12.0, 180.0), (303, 12.0, -180.0), (304, 0.0, 16.0), (305, 4.0, 16.0)]
    places = [("north", 90.0, -170.0), ("south", -89.9, 100.0), ("east", 12.0, 179.9), ("west", 12.1, -179.9), ("edge", 2.0, 16.0)]
    places += [(f"a{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    p = spark.createDataFrame(points, "point_id int, lat double, lon double")
    a = spark.createDataFrame(places, "station_id string, latitude double, longitude double")
    got = dict(rows(P.nearest(p, a, [], ["point_id"], ["point_id"]).select("station_id", "point_id")))
    km = {(s, i): brute_distance(la, lo, x, y) for s, la, lo in places for i, x, y in points}
    for s, _, _ in places:
        assert km[s, got[s]] <= min(km[s, i] for i, _, _ in points) + 1e-6
    assert got["north"] == 300 and {got["east"], got["west"]} <= {302, 303}


def test_only_the_finest_cells_near_an_anchor_are_left(spark):
    every = spark.range(180 * 360).select((F.expr("id div 360") - 89.5).alias("lat"), (F.col("id") % 360 - 179.5).alias("lon"))
    top = P.pyramid(every, [])
    at = spark.createDataFrame([("s", 10.2, 20.7), ("line", 40.0, 179.99)], "station_id string, latitude double, longitude double")
    left = at.withColumn("_cells", top.scalar()).select("station_id", F.size(P.nearest_cells(F.col("_cells"))).alias("n"))
    assert all(0 < n < 40 for _, n in rows(left))


def test_scan_features_read_pixels_three_times(spark, tmp_path):
    px = spark.createDataFrame([("x", 0, 0, 1.0, 1.0, 0)], "scan_id string, row int, col int, lat double, lon double, cls int")
    px.write.parquet(str(tmp_path / "px"))
    a = spark.createDataFrame([("s", 1.0, 1.0), ("far", -70.0, 179.0)], "station_id string, latitude double, longitude double")
    out = P.scan_features(spark.read.parquet(str(tmp_path / "px")), a)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # two passes fill the staged grid of scans and stations, this last one fetches pixels of the far cells
    assert plan.count("lat#") > 0 and len([x for x in plan.splitlines() if "Relation" in x and "cls#" in x and "lat#" in x]) == 1
    assert {r["station_id"]: r["row"] for r in out.collect()} == {"s": 0, "far": 0}


def test_wide_figures_equal_those_of_each_column(spark):
    data = [(1, 1.0, None, 3.0), (1, 2.0, 5.0, 3.0), (2, None, 7.0, 3.0), (2, 4.0, 1.0, 3.0)]
    df = spark.createDataFrame(data, "g int, a double, b double, flat double")
    got = {(r["g"], r["variable"]): (r["n"], r["n_missing"], r["min"], r["max"]) for r in column_profile(df, ["a", "b"], ["g"]).collect()}
    assert got == {(1, "a"): (2, 0, 1.0, 2.0), (1, "b"): (2, 1, 5.0, 5.0), (2, "a"): (2, 1, 4.0, 4.0), (2, "b"): (2, 0, 1.0, 7.0)}
    assert column_profile(df.limit(0), ["a"]).count() == 0
    r = {x["variable"]: (x["n"], x["r"]) for x in correlations(df, ["b", "flat"], "a").collect()}
    assert r["b"] == (2, pytest.approx(-1.0)) and r["flat"] == (3, 0.0)
    assert correlations(df.filter("g = 3"), ["b"], "a").count() == 0


def test_pixel_shares(spark):
    at = [(0, 1.0, 1.0, 0), (1, 1.0, 1.01, 1), (2, 1.01, 1.0, 2), (3, 1.01, 1.01, 3), (4, 1.0, 1.0, 9)]
    px = spark.createDataFrame([("x", i, 0, la, lo, c) for i, la, lo, c in at], "scan_id string, row int, col int, lat double, lon double, cls int")
    a = spark.createDataFrame([("s", 1.0, 1.0), ("far", 40.0, 40.0)], "station_id string, latitude double, longitude double")
    out = {r["station_id"]: r for r in P.scan_features(px, a).collect()}
    assert (out["s"]["valid_pixels"], out["s"]["cloudy_fraction"], out["s"]["clear_fraction"], out["s"]["cloud_mask"]) == (4, 0.5, 0.5, 0)
    # no pixel in the box: the nearest of all is taken, and nothing is known about the neighbourhood
    assert (out["far"]["valid_pixels"], out["far"]["cloudy_fraction"], out["far"]["cloud_mask"]) == (0, None, 3)


def test_scan_without_valid_pixel_is_unavailable(spark):
    px = spark.createDataFrame([("x", 0, 0, 1.0, 1.0, 9)], "scan_id string, row int, col int, lat double, lon double, cls int")
    a = spark.createDataFrame([("s", 1.0, 1.0)], "station_id string, latitude double, longitude double")
    (row,) = P.scan_features(px, a).collect()
    assert row["available"] == 0 and row["cloud_mask"] is None and row["valid_pixels"] == 0
