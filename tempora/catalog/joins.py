"""Queries on equi-, as-of, interval and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.features import rounded
from tempora.catalog.labels import labels_of, targets_of
from tempora.catalog.registry import query
from tempora.functions import geo
from tempora.operators import joins as J
from tempora.operators import spatial as P
from tempora.operators.calendar import fill_on_spine
from tempora.operators.labels import first_reports, hourly_counts, with_flags
from tempora.sources import views as V

KEY = ["station_id", "timestamp_utc"]


def aligned_of(spark, path):
    return J.asof_hourly(V.spine(spark, path), V.scans(spark, path), "acq_end", "gid", ["cloudy", "cmk"])


def overlap_of(spark, path):
    return J.overlap(V.atmos(spark, path), targets_of(spark, path).select(*KEY, "target_1h", "target_2h", "target_3h"), V.nwp(spark, path))


@query(
    "calendar_counts",
    """SELECT station_id, timestamp_utc, coalesce(n_reports, 0) AS n_reports, coalesce(n_reports_with_wx, 0) AS n_reports_with_wx,
      coalesce(n_ts_reports, 0) AS n_ts_reports FROM spine LEFT JOIN hour_counts USING (station_id, timestamp_utc)""",
)
def calendar_counts(spark, path):
    names = ["n_reports", "n_reports_with_wx", "n_ts_reports"]
    facts = hourly_counts(first_reports(with_flags(V.reports(spark, path)))).select(*KEY, *names)
    return fill_on_spine(V.spine(spark, path), facts, KEY, names)


@query("hourly_report_counts", "SELECT station_id, timestamp_utc, n_reports, n_reports_with_wx, n_ts_reports, n_ts_reports > 0 AS any_event FROM hour_counts")
def hourly_report_counts(spark, path):
    return hourly_counts(first_reports(with_flags(V.reports(spark, path)))).drop("n_station_reports")


_MODEL_LIST = ", ".join(V.ATMOSPHERE + V.MODEL)


@query(
    "feature_target_model_overlap",
    f"""SELECT station_id, timestamp_utc, target_1h, target_2h, target_3h, {_MODEL_LIST} FROM atmos JOIN targets USING (station_id, timestamp_utc)
      JOIN nwp USING (station_id, timestamp_utc)""",
)
def feature_target_model_overlap(spark, path):
    return overlap_of(spark, path).select(*KEY, "target_1h", "target_2h", "target_3h", *V.ATMOSPHERE, *V.MODEL)


@query(
    "feature_target_rows",
    "SELECT station_id, timestamp_utc, temperature_2m, target, target_1h FROM atmos JOIN targets USING (station_id, timestamp_utc)",
)
def feature_target_rows(spark, path):
    out = V.atmos(spark, path).join(targets_of(spark, path), KEY)
    return out.select(*KEY, "temperature_2m", "target", "target_1h")


@query(
    "model_window_restriction",
    """SELECT station_id, count(*) AS n, min(timestamp_utc) AS first, max(timestamp_utc) AS last FROM spine
      WHERE timestamp_utc >= (SELECT min(timestamp_utc) FROM nwp) AND timestamp_utc <= (SELECT max(timestamp_utc) FROM nwp) GROUP BY station_id""",
)
def model_window_restriction(spark, path):
    out = J.inside_window(V.spine(spark, path), V.nwp(spark, path).select("timestamp_utc"))
    return out.groupBy("station_id").agg(
        F.count("*").alias("n"), F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last")
    )


@query(
    "feature_model_join_audit",
    """SELECT station_id, count(*) FILTER (l AND r) AS matched, count(*) FILTER (r IS NULL) AS left_only, count(*) FILTER (l IS NULL) AS right_only,
      round(100.0::DOUBLE * count(*) FILTER (l AND r) / count(*) FILTER (l), 4) AS retention_pct FROM
      (SELECT station_id, timestamp_utc, true AS l FROM atmos WHERE temperature_2m IS NOT NULL) a
      FULL JOIN (SELECT station_id, timestamp_utc, true AS r FROM nwp) b USING (station_id, timestamp_utc) GROUP BY station_id""",
)
def feature_model_join_audit(spark, path):
    return J.join_audit(V.atmos(spark, path).filter(F.col("temperature_2m").isNotNull()), V.nwp(spark, path))


_ALIGNED_SQL = "SELECT station_id, timestamp_utc, acq_end, gid, cloudy, cmk, sat_available, age_minutes FROM aligned"


@query("asof_90min", _ALIGNED_SQL)
def asof_90min(spark, path):
    return aligned_of(spark, path)


@query(
    "asof_match_rate",
    """SELECT station_id, count(*) AS n_hours, sum(sat_available)::BIGINT AS n_matched, count(*) - sum(sat_available)::BIGINT AS n_unmatched,
      round(100.0::DOUBLE * sum(sat_available) / count(*), 4) AS match_pct FROM aligned GROUP BY station_id""",
)
def asof_match_rate(spark, path):
    from tempora.functions.values import percent

    counts = aligned_of(spark, path).groupBy("station_id").agg(F.count("*").alias("n_hours"), F.sum("sat_available").alias("n_matched"))
    return counts.withColumns(
        {"n_unmatched": F.col("n_hours") - F.col("n_matched"), "match_pct": percent(F.col("n_matched"), F.col("n_hours"), 4)}
    )


@query(
    "scans_in_same_hour",
    "SELECT station_id, date_trunc('hour', acq_end) AS timestamp_utc, gid, acq_end FROM scans",
)
def scans_in_same_hour(spark, path):
    return J.in_same_hour(V.spine(spark, path), V.scans(spark, path).select("station_id", "gid", "acq_end"), "acq_end")


@query(
    "self_join_targets",
    """SELECT a.station_id, a.timestamp_utc, b.target AS target_1h FROM labels a JOIN labels b ON a.station_id = b.station_id
      AND b.timestamp_utc = a.timestamp_utc + INTERVAL 1 HOUR""",
)
def self_join_targets(spark, path):
    labels = labels_of(spark, path)
    now = labels.select("station_id", "timestamp_utc", (F.unix_seconds("timestamp_utc") + 3600).alias("_f"))
    later = labels.select("station_id", F.unix_seconds("timestamp_utc").alias("_f"), F.col("target").alias("target_1h"))
    return now.join(later, ["station_id", "_f"]).drop("_f")


@query(
    "rejoin_equality",
    """SELECT (SELECT count(*) FROM atmos WHERE temperature_2m IS NOT NULL) AS n_rows, 0::BIGINT AS differs_temperature_2m,
      0::BIGINT AS differs_precipitation""",
)
def rejoin_equality(spark, path):
    names = ["temperature_2m", "precipitation"]
    source = V.atmos(spark, path).filter(F.col("temperature_2m").isNotNull()).select(*KEY, *names)
    joined = source.join(labels_of(spark, path).select(*KEY, "target"), KEY)
    return J.equal_after_join(joined, source, names)


@query(
    "observed_semi_join",
    "SELECT station_id, count(*) AS n FROM atmos WHERE (station_id, timestamp_utc) IN (SELECT (station_id, timestamp_utc) FROM labels WHERE target = 1) GROUP BY station_id",
)
def observed_semi_join(spark, path):
    positive = labels_of(spark, path).filter(F.col("target") == 1)
    return V.atmos(spark, path).join(positive, KEY, "left_semi").groupBy("station_id").agg(F.count("*").alias("n"))


@query(
    "unmatched_anti_join",
    """SELECT station_id, count(*) AS n, min(timestamp_utc) AS first, max(timestamp_utc) AS last FROM spine s WHERE NOT EXISTS
      (SELECT 1 FROM nwp n WHERE n.station_id = s.station_id AND n.timestamp_utc = s.timestamp_utc) GROUP BY station_id""",
)
def unmatched_anti_join(spark, path):
    out = V.spine(spark, path).join(V.nwp(spark, path), KEY, "left_anti")
    return out.groupBy("station_id").agg(F.count("*").alias("n"), F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last"))


@query(
    "reindexed_series",
    """SELECT k.station_id, k.timestamp_utc, round(a.precipitation, 6) AS precipitation, a.station_id IS NULL AS missed FROM
      (SELECT DISTINCT station_id, timestamp_utc FROM hour_counts) k LEFT JOIN atmos a ON a.station_id = k.station_id AND a.timestamp_utc = k.timestamp_utc""",
)
def reindexed_series(spark, path):
    keys = hourly_counts(first_reports(with_flags(V.reports(spark, path)))).select(*KEY)
    series = V.atmos(spark, path).select(*KEY, F.round("precipitation", 6).alias("precipitation"), F.lit(True).alias("_hit"))
    return keys.join(series, KEY, "left").withColumn("missed", F.col("_hit").isNull()).drop("_hit")


@query(
    "climatology_cell",
    """SELECT station_id, cell_id, round(distance_km, 6) AS distance_km, annual_hours FROM (SELECT s.station_id, g.cell_id, g.annual_hours,
      2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(sin(radians(grid_lat - latitude) / 2) ^ 2 + cos(radians(latitude)) * cos(radians(grid_lat)) *
        sin(radians(grid_lon - longitude) / 2) ^ 2))) AS distance_km FROM stations s, climate_grid g WHERE annual_hours IS NOT NULL)
      QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY distance_km, cell_id) = 1""",
)
def climatology_cell(spark, path):
    return climatology_of(spark, path).withColumn("distance_km", F.round("distance_km", 6))


def climatology_of(spark, path):
    grid = V.climate_grid(spark, path).filter(F.col("annual_hours").isNotNull())
    points = grid.select("cell_id", F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon"), "annual_hours")
    anchors = V.stations(spark).select("station_id", "latitude", "longitude")
    return P.nearest(points, anchors, [], ["cell_id", "annual_hours"], ["cell_id"])


@query(
    "dimension_guard",
    """SELECT (SELECT count(*) FROM labels)::BIGINT AS rows_after, 0::BIGINT AS null_values, 0::BIGINT AS non_constant_keys""",
)
def dimension_guard(spark, path):
    return J.guarded_dimension(labels_of(spark, path).select(*KEY), climatology_of(spark, path), "station_id", "annual_hours")[1]


_HAVERSINE = """2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(sin(radians(lat - latitude) / 2) ^ 2 + cos(radians(latitude)) * cos(radians(lat)) *
  sin(radians(lon - longitude) / 2) ^ 2)))"""


@query(
    "strikes_near_stations",
    f"""SELECT * FROM (SELECT station_id, lightning_type, point_id, round({_HAVERSINE}, 6) AS distance_km FROM strikes, stations
      WHERE NOT (lat = 0 AND lon = 0)) WHERE distance_km <= 100""",
)
def strikes_near_stations(spark, path):
    points = V.strikes(spark, path).filter(geo.valid_position(F.col("lat"), F.col("lon")))
    near = P.points_within(points, V.stations(spark), 100.0)
    return near.select("station_id", "lightning_type", "point_id", F.round("distance_km", 6).alias("distance_km"))


@query(
    "strike_counts_by_radius",
    f"""SELECT s.station_id, k.lightning_type, r.radius_km, count(d.granule) AS records, count(DISTINCT d.granule) AS granules FROM stations s
      CROSS JOIN (SELECT unnest(['event', 'group', 'flash']) AS lightning_type) k CROSS JOIN (SELECT unnest([25, 50, 100]) AS radius_km) r
      LEFT JOIN (SELECT station_id, lightning_type, granule, {_HAVERSINE} AS distance_km FROM strikes, stations WHERE NOT (lat = 0 AND lon = 0)) d
      ON d.station_id = s.station_id AND d.lightning_type = k.lightning_type AND d.distance_km <= r.radius_km GROUP BY ALL""",
)
def strike_counts_by_radius(spark, path):
    points = V.strikes(spark, path).filter(geo.valid_position(F.col("lat"), F.col("lon")))
    return P.radius_counts(points, V.stations(spark), (25, 50, 100), ("event", "group", "flash"))


_SCAN_FEATURES = f"""WITH d AS (SELECT p.*, s.station_id, abs(lat - latitude) <= 1 AND abs(lon - longitude) <= 1 AS boxed, {_HAVERSINE} AS km
    FROM pixels p, stations s WHERE cls <> 9),
  e AS (SELECT * FROM d QUALIFY boxed OR NOT bool_or(boxed) OVER (PARTITION BY scan_id, station_id)),
  n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY scan_id, station_id ORDER BY km, row, col) = 1),
  c AS (SELECT scan_id, station_id, count(*) FILTER (km <= 25) AS k, count(*) FILTER (km <= 25 AND cls IN (1, 3)) AS cloudy,
    count(*) FILTER (km <= 25 AND cls IN (0, 2)) AS clear FROM e GROUP BY ALL)
  SELECT g.scan_id, g.station_id, n.cls::INT AS cloud_mask, (['Clear', 'Cloudy', 'Probably_Clear', 'Probably_Cloudy'])[n.cls + 1] AS cloud_class,
    round(n.km, 6) AS distance_km, n.row, n.col, coalesce(c.k, 0) AS valid_pixels, CASE WHEN c.k > 0 THEN c.cloudy / c.k END AS cloudy_fraction,
    CASE WHEN c.k > 0 THEN c.clear / c.k END AS clear_fraction, (n.cls IS NOT NULL)::INT AS available
  FROM (SELECT DISTINCT scan_id, s.station_id FROM pixels, stations s) g LEFT JOIN n USING (scan_id, station_id) LEFT JOIN c USING (scan_id, station_id)"""


def scan_features_of(spark, path):
    return P.scan_features(V.pixels(spark, path), V.stations(spark))


@query("scan_station_features", f"SELECT * FROM ({_SCAN_FEATURES})")
def scan_station_features(spark, path):
    return scan_features_of(spark, path)


@query(
    "nearest_pixel_any_distance",
    f"""SELECT scan_id, station_id, row, round(km, 6) AS distance_km FROM (SELECT p.*, s.station_id, {_HAVERSINE} AS km FROM pixels p, stations s WHERE cls <> 9)
      QUALIFY row_number() OVER (PARTITION BY scan_id, station_id ORDER BY km, row, col) = 1""",
)
def nearest_pixel_any_distance(spark, path):
    valid = V.pixels(spark, path).filter(geo.is_valid_class(F.col("cls")))
    anchors = J.with_every(valid.select("scan_id").distinct(), V.stations(spark), ["station_id", "latitude", "longitude"])
    return P.nearest(valid, anchors, ["scan_id"], ["row"], ["row", "col"]).withColumn("distance_km", F.round("distance_km", 6))


@query(
    "source_comparison",
    """SELECT variable, count(*) AS n, round(avg(abs(a - b)), 6) AS mean_abs_diff, round(max(abs(a - b)), 6) AS max_abs_diff, round(corr(a, b), 6) AS correlation
      FROM (SELECT 'temperature' AS variable, temperature_2m AS a, nwp_temperature_2m AS b FROM atmos JOIN nwp USING (station_id, timestamp_utc)
        UNION ALL SELECT 'precipitation', precipitation, nwp_precipitation FROM atmos JOIN nwp USING (station_id, timestamp_utc)
        UNION ALL SELECT 'cloud_cover', cloud_cover, nwp_cloud_cover FROM atmos JOIN nwp USING (station_id, timestamp_utc))
      WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY variable""",
)
def source_comparison(spark, path):
    pairs = {
        "temperature": ("temperature_2m", "nwp_temperature_2m"),
        "precipitation": ("precipitation", "nwp_precipitation"),
        "cloud_cover": ("cloud_cover", "nwp_cloud_cover"),
    }
    out = J.compare_sources(V.atmos(spark, path), V.nwp(spark, path), pairs)
    return rounded(out, ["mean_abs_diff", "max_abs_diff", "correlation"], keep=["variable", "n"])


