"""Queries on episodes, cases, controls, interval joins and complete runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tempora.catalog.evaluate import predictions_of
from tempora.catalog.joins import aligned_of
from tempora.catalog.labels import labels_of, targets_of
from tempora.catalog.registry import query
from tempora.functions import clock
from tempora.operators import episodes as E
from tempora.operators import joins as J
from tempora.operators import profile as C
from tempora.operators.series import with_previous
from tempora.operators.targets import lead_targets
from tempora.session import stage
from tempora.sources import views as V

KEY = ["station_id", "timestamp_utc"]
NOW = datetime(2024, 1, 29, 12)


def episodes_of(spark, path):
    return E.episodes(labels_of(spark, path))


def cases_of(spark, path):
    return E.select_cases(episodes_of(spark, path))


def case_table_of(spark, path):
    """Episodes and controls read the labels from one staged copy, so the reports are scanned once."""
    labels = stage(labels_of(spark, path), "labels")
    cases = stage(E.select_cases(E.episodes(labels)), "cases")
    controls = E.find_controls(cases, lead_targets(labels), V.first_hour(spark, path), V.last_hour(spark, path))
    return stage(E.case_table(cases, controls), "case_table")


@query("episodes", "SELECT station_id, event_start, event_end, n_hours, duration_h FROM episodes")
def episodes(spark, path):
    return episodes_of(spark, path)


_CASES = """SELECT *, station_id || '_TS_' || lpad(row_number() OVER (ORDER BY station_id, event_start)::VARCHAR, 2, '0') || '_' || strftime(event_start, '%Y%m%dT%H') AS event_id
  FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY (r > 1)::INT, n_hours DESC, duration_h DESC, event_start) AS pick FROM
    (SELECT *, year(event_start)::INT AS year, 'winter' AS season, row_number() OVER (PARTITION BY station_id, year(event_start) ORDER BY n_hours DESC, duration_h DESC, event_start) AS r
     FROM episodes WHERE duration_h <= 24)) WHERE pick <= 5"""


@query("selected_cases", f"SELECT station_id, event_start, event_end, n_hours, duration_h, year, season, event_id FROM ({_CASES})")
def selected_cases(spark, path):
    return cases_of(spark, path)


_CONTROLS = f"""SELECT station_id, replace(event_id, '_TS_', '_CTL_') AS control_id, event_id, offset_days, control_start, control_end FROM
  (SELECT c.station_id, c.event_id, o.place, o.offset_days, c.event_start + to_days(o.offset_days) AS control_start, c.event_end + to_days(o.offset_days) AS control_end,
     count(*) AS n, bool_and(t.target IS NOT NULL) AS observed, bool_or(coalesce(t.target = 1, false) OR coalesce(t.target_1h = 1, false)) AS positive
   FROM ({_CASES}) c CROSS JOIN (VALUES (0, -14), (1, 14), (2, -21), (3, 21), (4, -7), (5, 7), (6, -28), (7, 28)) o(place, offset_days)
   JOIN targets t ON t.station_id = c.station_id AND t.timestamp_utc BETWEEN c.event_start + to_days(o.offset_days) - INTERVAL 6 HOUR AND c.event_end + to_days(o.offset_days) + INTERVAL 6 HOUR
   WHERE c.event_start + to_days(o.offset_days) >= TIMESTAMP '2024-01-01' AND c.event_end + to_days(o.offset_days) <= TIMESTAMP '2024-01-30 23:00:00'
   GROUP BY ALL) WHERE observed AND NOT positive QUALIFY row_number() OVER (PARTITION BY station_id, event_id ORDER BY place) = 1"""


@query("case_controls", f"SELECT * FROM ({_CONTROLS})")
def case_controls(spark, path):
    return E.find_controls(cases_of(spark, path), targets_of(spark, path), V.first_hour(spark, path), V.last_hour(spark, path))


_TABLE = f"""SELECT *, event_start - INTERVAL 2 HOUR AS window_start, event_end + INTERVAL 2 HOUR AS window_end FROM
  (SELECT station_id, event_id, event_start, event_end, 'thunderstorm_episode' AS case_type, '' AS control_reference FROM ({_CASES})
   UNION ALL SELECT station_id, control_id, control_start, control_end, 'control', event_id FROM ({_CONTROLS}))"""


@query("case_windows", f"SELECT * FROM ({_TABLE})")
def case_windows(spark, path):
    return case_table_of(spark, path)


_HITS = f"SELECT t.*, s.gid, s.acq_end, s.cloudy, s.cmk FROM ({_TABLE}) t JOIN scans s ON s.station_id = t.station_id AND s.acq_end BETWEEN t.window_start AND t.window_end"


@query("scans_in_case_windows", f"SELECT station_id, event_id, gid, acq_end FROM ({_HITS})")
def scans_in_case_windows(spark, path):
    hits = J.within_windows(V.scans(spark, path), case_table_of(spark, path), "acq_end", "window_start", "window_end")
    return hits.select("station_id", "event_id", "gid", "acq_end")


@query(
    "scans_in_all_episodes",
    """SELECT e.station_id, e.event_start, s.gid FROM episodes e JOIN scans s ON s.station_id = e.station_id AND s.acq_end BETWEEN e.event_start - INTERVAL 2 HOUR
      AND e.event_end + INTERVAL 2 HOUR""",
)
def scans_in_all_episodes(spark, path):
    windows = E.with_window(episodes_of(spark, path))
    hits = J.within_windows(V.scans(spark, path), windows, "acq_end", "window_start", "window_end")
    return hits.select("station_id", "event_start", "gid")


@query(
    "missing_scan_slots",
    f"""WITH t AS ({_TABLE}), due AS (SELECT * FROM (SELECT t.*, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, window_start), window_end, INTERVAL 15 MINUTE)) AS slot FROM t)
        WHERE slot >= window_start AND minute(slot) IN (15, 45)),
      seen AS (SELECT DISTINCT station_id, time_bucket(INTERVAL 15 MINUTE, acq_end) AS slot FROM scans)
      SELECT t.station_id, t.event_id, coalesce(d.due, 0) AS due, coalesce(d.missing, 0) AS missing, coalesce(h.scans, 0) AS scans, coalesce(h.scans, 0) = 0 AS no_scans FROM t
      LEFT JOIN (SELECT due.station_id, event_id, count(*) AS due, count(*) FILTER (s.slot IS NULL) AS missing FROM due LEFT JOIN seen s ON s.station_id = due.station_id
        AND s.slot = due.slot GROUP BY ALL) d USING (station_id, event_id)
      LEFT JOIN (SELECT t.station_id, t.event_id, count(*) AS scans FROM t JOIN scans s ON s.station_id = t.station_id AND
        time_bucket(INTERVAL 15 MINUTE, s.acq_end) BETWEEN t.window_start AND t.window_end GROUP BY ALL) h USING (station_id, event_id)""",
)
def missing_scan_slots(spark, path):
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("acq_end") / 900) * 900)
    scans = V.scans(spark, path).select("station_id", slot.alias("slot_time"))
    return J.slot_audit(case_table_of(spark, path), scans, "window_start", "window_end", "slot_time", ["event_id"])


_CASE_ROWS = f"""SELECT t.station_id, t.event_id, t.case_type, h.timestamp_utc, h.cloudy, p.p_1h, p.target_1h FROM ({_TABLE}) t JOIN aligned h ON h.station_id = t.station_id
  AND h.timestamp_utc BETWEEN t.window_start AND t.window_end JOIN alerts p ON p.station_id = h.station_id AND p.timestamp_utc = h.timestamp_utc"""


def case_rows_of(spark, path, table):
    hours = aligned_of(spark, path).select(*KEY, "cloudy").join(predictions_of(spark, path).select(*KEY, "p_1h", "target_1h"), KEY)
    return J.within_windows(hours, table, "timestamp_utc", "window_start", "window_end")


@query(
    "case_summary",
    f"""SELECT station_id, event_id, case_type, count(*) AS n_hours, count(cloudy) AS n_satellite_hours, round(avg(cloudy), 6) AS mean_cloudy, round(min(cloudy), 6) AS min_cloudy,
      round(max(cloudy), 6) AS max_cloudy, min(p_1h) AS risk_min, max(p_1h) AS risk_max, count(*) FILTER (target_1h = 1) AS positive_hours,
      count(*) FILTER (target_1h = 0) AS negative_hours, count(*) FILTER (target_1h IS NULL) AS unknown_hours FROM ({_CASE_ROWS}) GROUP BY ALL""",
)
def case_summary(spark, path):
    table = case_table_of(spark, path)
    out = E.case_summary(table, case_rows_of(spark, path, table))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_cloudy", "min_cloudy", "max_cloudy")})


@query(
    "case_scan_summary",
    f"""WITH t AS ({_TABLE}), h AS ({_HITS}), m AS (SELECT station_id, event_id, cmk FROM (SELECT station_id, event_id, cmk, count(*) AS k FROM h GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY station_id, event_id ORDER BY k DESC, cmk) = 1)
      SELECT t.station_id, t.event_id, t.case_type, count(h.gid) AS n_scans, count(*) FILTER (h.acq_end < t.event_start) AS n_before,
        count(*) FILTER (h.acq_end >= t.event_start AND h.acq_end < t.event_end + INTERVAL 1 HOUR) AS n_during, count(*) FILTER (h.acq_end >= t.event_end + INTERVAL 1 HOUR) AS n_after,
        round(avg(h.cloudy), 6) AS mean_cloudy, max(m.cmk) AS class_mode FROM t LEFT JOIN h ON h.station_id = t.station_id AND h.event_id = t.event_id
      LEFT JOIN m ON m.station_id = t.station_id AND m.event_id = t.event_id GROUP BY t.station_id, t.event_id, t.case_type""",
)
def case_scan_summary(spark, path):
    table = case_table_of(spark, path)
    hits = J.within_windows(V.scans(spark, path), table, "acq_end", "window_start", "window_end")
    return E.scan_summary(table, hits).withColumn("mean_cloudy", F.round("mean_cloudy", 6))


@query(
    "cloud_event_crosstab",
    """SELECT CASE WHEN cloudy >= 0.1::DOUBLE THEN 'high_cloud' ELSE 'lower_cloud' END AS cloud_state, CASE WHEN target_1h = 1 THEN 'future_event' ELSE 'future_none' END AS event_state,
      count(*) AS n FROM aligned JOIN targets USING (station_id, timestamp_utc) WHERE sat_available = 1 AND target_1h IS NOT NULL GROUP BY ALL""",
)
def cloud_event_crosstab(spark, path):
    joined = aligned_of(spark, path).join(targets_of(spark, path).select(*KEY, "target_1h"), KEY)
    known = joined.filter((F.col("sat_available") == 1) & F.col("target_1h").isNotNull())
    cloud = F.when(F.col("cloudy") >= 0.1, "high_cloud").otherwise("lower_cloud")
    event = F.when(F.col("target_1h") == 1, "future_event").otherwise("future_none")
    return known.groupBy(cloud.alias("cloud_state"), event.alias("event_state")).agg(F.count("*").alias("n"))


@query(
    "satellite_model_difference",
    """SELECT station_id, count(*) AS n, round(avg(cloudy - nwp_cloud_cover / 100), 6) AS mean_difference, count(*) FILTER (abs(cloudy - nwp_cloud_cover / 100) >= 0.4::DOUBLE) AS n_disagree,
      count(*) FILTER (cloudy >= 0.75::DOUBLE AND nwp_cloud_cover <= 40) AS n_cloudy_model_clear FROM aligned JOIN nwp USING (station_id, timestamp_utc) WHERE sat_available = 1 GROUP BY station_id""",
)
def satellite_model_difference(spark, path):
    model = V.nwp(spark, path).select(*KEY, "nwp_cloud_cover")
    joined = aligned_of(spark, path).filter(F.col("sat_available") == 1).join(model, KEY)
    gap = F.col("cloudy") - F.col("nwp_cloud_cover") / 100
    return joined.groupBy("station_id").agg(
        F.count("*").alias("n"),
        F.round(F.avg(gap), 6).alias("mean_difference"),
        F.count_if(F.abs(gap) >= 0.4).alias("n_disagree"),
        F.count_if((F.col("cloudy") >= 0.75) & (F.col("nwp_cloud_cover") <= 40)).alias("n_cloudy_model_clear"),
    )


_RUNS = """SELECT station_id, min(timestamp_utc) AS run_start, max(timestamp_utc) AS feature_hour, count(*) AS run_hours FROM (SELECT station_id, timestamp_utc,
  timestamp_utc - to_hours(row_number() OVER (PARTITION BY station_id ORDER BY timestamp_utc)) AS island FROM atmos
  WHERE temperature_2m IS NOT NULL AND timestamp_utc <= TIMESTAMP '2024-01-29 12:00:00') GROUP BY station_id, island HAVING count(*) >= 25"""


@query(
    "latest_complete_run",
    f"""SELECT r.station_id, run_start, feature_hour, run_hours, (SELECT count(*) FROM spine s WHERE s.station_id = r.station_id AND s.timestamp_utc > feature_hour AND
        s.timestamp_utc <= TIMESTAMP '2024-01-29 12:00:00') AS trailing_skipped, (SELECT count(*) FROM spine s WHERE s.station_id = r.station_id AND
        s.timestamp_utc > TIMESTAMP '2024-01-29 12:00:00') AS future_hours FROM (SELECT * FROM ({_RUNS}) QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY feature_hour DESC) = 1) r""",
)
def latest_complete_run(spark, path):
    """25 complete hours in a row are asked for, 24 before the feature hour."""
    hours = V.atmos(spark, path).select(*KEY, "temperature_2m")
    return E.latest_complete_run(hours, F.col("temperature_2m").isNotNull(), F.lit(NOW), 24)


@query(
    "series_steps",
    """SELECT station_id, count(*) AS unique_times, min(timestamp_utc) AS first, max(timestamp_utc) AS last, count(*) FILTER (step > 86400) AS gaps, max(step)::BIGINT AS largest_step_s,
      count(*) FILTER (step < 86400) AS short_steps, 0::BIGINT AS off_grid, (date_diff('day', min(timestamp_utc), max(timestamp_utc)) + 1 - count(*)) AS missing_steps FROM
      (SELECT *, date_diff('second', lag(timestamp_utc) OVER (PARTITION BY station_id ORDER BY timestamp_utc), timestamp_utc) AS step FROM series_day) GROUP BY station_id""",
)
def series_steps(spark, path):
    return C.step_report(V.series_day(spark, path).select(*KEY), ["station_id"], "timestamp_utc", 86400)


@query(
    "previous_report",
    """SELECT station_id, valid_minute, lag(valid_minute) OVER (PARTITION BY station_id ORDER BY valid_minute) AS previous FROM kept""",
)
def previous_report(spark, path):
    minutes = V.reports(spark, path).select("station_id", "valid_minute").distinct()
    return with_previous(minutes, ["station_id"], "valid_minute", "previous", chunk=24)


@query(
    "instrument_clocks",
    """SELECT point_id, TIMESTAMP '1993-01-01 00:00:00' + to_microseconds(((tai93 - 35) * 1000000)::BIGINT) AS observed,
      TIMESTAMP '2000-01-01 00:00:00' + to_microseconds((point_id * 60 * 1000000)::BIGINT) AS slot,
      strftime(TIMESTAMP '1993-01-01 00:00:00' + to_microseconds(((tai93 - 35) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM strikes""",
)
def instrument_clocks(spark, path):
    observed = clock.tai93_to_utc(F.col("tai93"))
    return V.strikes(spark, path).select(
        "point_id",
        observed.alias("observed"),
        clock.minutes_since(F.col("point_id"), "2000-01-01 00:00:00").alias("slot"),
        clock.iso_z(observed).alias("iso"),
    )


@query(
    "scan_names",
    """SELECT gid, 'SCAN_' || upper(strftime(acq_end, '%d%b%Y_%H%M')) || '_L2B.h5' AS file_name, date_trunc('minute', acq_end) AS stamp, strftime(acq_end, '%H%M') AS slot,
      date_trunc('second', acq_end) AS acquired FROM scans""",
)
def scan_names(spark, path):
    """Names built from times and read back to times."""
    name = F.concat(F.lit("SCAN_"), F.upper(F.date_format("acq_end", "ddMMMyyyy_HHmm")), F.lit("_L2B.h5"))
    text = F.date_format("acq_end", "dd-MMM-yyyy'T'HH:mm:ss")
    return V.scans(spark, path).select(
        "gid",
        name.alias("file_name"),
        clock.file_stamp(name).alias("stamp"),
        clock.clock_slot(name).alias("slot"),
        clock.acquisition_stamp(text).alias("acquired"),
    )


@query("shifted_hours", "SELECT station_id, acq_end, acq_end + INTERVAL 3 HOUR AS later, round(date_diff('microsecond', acq_end, acq_end + INTERVAL 90 MINUTE) / 60000000, 3) AS minutes FROM scans")
def shifted_hours(spark, path):
    later = clock.shift_hours(F.col("acq_end"), 3)
    ninety = F.col("acq_end") + F.make_interval(mins=F.lit(90))
    return V.scans(spark, path).select(
        "station_id", "acq_end", later.alias("later"), F.round(clock.minutes_between(ninety, F.col("acq_end")), 3).alias("minutes")
    )
