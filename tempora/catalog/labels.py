"""Queries on reports, codes, labels and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.registry import query
from tempora.functions import codes
from tempora.operators import labels as L
from tempora.operators import targets as T
from tempora.sources import views as V

KEY = ["station_id", "timestamp_utc"]


def labels_of(spark, path):
    return L.hourly_labels(V.reports(spark, path), V.spine(spark, path))


def targets_of(spark, path):
    return T.lead_targets(labels_of(spark, path))


@query(
    "hourly_labels",
    """SELECT station_id, timestamp_utc, n_reports, n_reports_with_wx, n_ts_reports, target, target_observed, label_status FROM labels""",
)
def hourly_labels(spark, path):
    return labels_of(spark, path).drop("n_station_reports")


@query(
    "hourly_labels_any_report",
    """SELECT station_id, timestamp_utc, n_reports, CASE WHEN n_reports > 0 THEN (n_ts_reports > 0)::INT::DOUBLE END AS target
    FROM labels""",
)
def hourly_labels_any_report(spark, path):
    out = L.hourly_labels(V.reports(spark, path), V.spine(spark, path), evidence="reports")
    return out.select(*KEY, "n_reports", "target")


@query(
    "code_tokens",
    """SELECT station_id, wxcodes, len(toks) AS n_tokens, array_to_string(toks, ',') AS token_text, ts_station, ts_vicinity, decodable,
      count(*) AS n FROM flags GROUP BY ALL""",
)
def code_tokens(spark, path):
    flagged = L.with_flags(V.reports(spark, path))
    tokens = codes.tokens(F.col("wxcodes"))
    return flagged.groupBy(
        "station_id",
        "wxcodes",
        F.size(tokens).cast("bigint").alias("n_tokens"),
        F.array_join(tokens, ",").alias("token_text"),
        "ts_station",
        "ts_vicinity",
        "decodable",
    ).agg(F.count("*").alias("n"))


@query(
    "token_classes",
    r"""SELECT tok, CASE WHEN regexp_matches(upper(tok), '^[+-]*VC[+-]*TS') THEN 'vcts' WHEN regexp_matches(upper(tok), '^[+-]*TS') THEN 'ts'
      ELSE 'other' END AS class, count(*) AS n FROM (SELECT unnest(toks) AS tok FROM tokens) GROUP BY ALL""",
)
def token_classes(spark, path):
    tok = F.explode(codes.tokens(F.col("wxcodes"))).alias("tok")
    return (
        V.reports(spark, path)
        .select(tok)
        .groupBy("tok", codes.token_class(F.col("tok")).alias("class"))
        .agg(F.count("*").alias("n"))
    )


_BODY = r"""SELECT *, regexp_extract(metar, '^(.*?)(\b(TEMPO|BECMG|NOSIG|RMK|PROB\d{2}|EMPO|TMPO)\b|$)', 1) AS observed,
  regexp_matches(metar, '\bQ\d{4}\b') AS has_qnh, regexp_matches(metar, '\bM?\d{2}/M?\d{2}\b') AS has_temp,
  regexp_matches(metar, '^\S+\s+\d{6}Z\s+\d{6}\s') AS forecast FROM bodies"""
_EVENT = r"""len(list_filter(regexp_split_to_array(upper(observed), '[/\s]+'),
  lambda w: regexp_matches(regexp_replace(w, '^\d+', ''), '^[+-]*(VC[+-]*)?TS'))) > 0"""


@query(
    "report_bodies",
    f"""SELECT station_id, report_id, observed, has_qnh, has_temp, has_qnh AND has_temp AS full_decode, forecast,
      {_EVENT} AS body_event FROM ({_BODY})""",
)
def report_bodies(spark, path):
    body = F.col("metar")
    return V.bodies(spark, path).select(
        "station_id",
        "report_id",
        codes.observed_part(body).alias("observed"),
        codes.has_pressure(body).alias("has_qnh"),
        codes.has_temperature(body).alias("has_temp"),
        codes.full_decode(body).alias("full_decode"),
        codes.forecast_product(body).alias("forecast"),
        codes.body_event(body).alias("body_event"),
    )


@query(
    "label_variants",
    f"""SELECT sp.station_id, sp.timestamp_utc,
      CASE WHEN n_reports > 0 THEN (n_ts > 0)::INT::DOUBLE END AS label,
      CASE WHEN n_reports > 0 THEN (n_station > 0)::INT::DOUBLE END AS label_strict,
      CASE WHEN n_recovered > 0 THEN 1.0::DOUBLE WHEN n_reports > 0 THEN (n_ts > 0)::INT::DOUBLE END AS label_recovered,
      coalesce(wxcodes_observed, '') AS wxcodes_observed, coalesce(n_reports, 0) AS n_reports, coalesce(n_full, 0) AS n_reports_full_decode,
      coalesce(n_wx, 0) AS n_reports_with_wx, (coalesce(n_wx, 0) > 0)::INT AS wx_field_observed, coalesce(n_ts, 0) AS n_ts_reports
    FROM spine sp LEFT JOIN (
      SELECT station_id, date_trunc('hour', valid_minute) AS timestamp_utc, count(*) AS n_reports, count(*) FILTER (has_qnh AND has_temp) AS n_full,
        count(*) FILTER (decodable) AS n_wx, count(*) FILTER (ts_station OR ts_vicinity) AS n_ts, count(*) FILTER (ts_station) AS n_station,
        count(*) FILTER (body_event AND NOT (ts_station OR ts_vicinity)) AS n_recovered,
        string_agg(DISTINCT wxcodes, ' | ' ORDER BY wxcodes) FILTER (wxcodes NOT IN ('', 'M')) AS wxcodes_observed
      FROM (SELECT b.*, f.decodable, f.ts_station, f.ts_vicinity, {_EVENT} AS body_event FROM ({_BODY}) b JOIN flags f USING (report_id)
        WHERE NOT (forecast AND NOT (has_qnh AND has_temp))
        QUALIFY row_number() OVER (PARTITION BY b.station_id, b.valid_minute ORDER BY metar, report_id) = 1)
      GROUP BY ALL) h USING (station_id, timestamp_utc)""",
)
def label_variants(spark, path):
    return L.label_variants(V.bodies(spark, path), V.spine(spark, path))


@query(
    "duplicate_reports",
    """SELECT station_id, count(*) AS n_minutes, sum(n)::BIGINT AS n_reports, sum(n - 1)::BIGINT AS duplicate_rows,
      count(*) FILTER (codes > 1) AS conflicting_minutes FROM
      (SELECT station_id, valid_minute, count(*) AS n, count(DISTINCT wxcodes) AS codes FROM reports GROUP BY ALL) GROUP BY ALL""",
)
def duplicate_reports(spark, path):
    """Copies are counted per code first, so a minute with very many copies stays small."""
    per_code = V.reports(spark, path).groupBy("station_id", "valid_minute", "wxcodes").agg(F.count("*").alias("n"))
    per_minute = per_code.groupBy("station_id", "valid_minute").agg(F.sum("n").alias("n"), F.count("*").alias("codes"))
    return per_minute.groupBy("station_id").agg(
        F.count("*").alias("n_minutes"),
        F.sum("n").alias("n_reports"),
        F.sum(F.col("n") - 1).alias("duplicate_rows"),
        F.count_if(F.col("codes") > 1).alias("conflicting_minutes"),
    )


@query("first_reports", "SELECT station_id, valid_minute, report_id, wxcodes FROM kept")
def first_reports(spark, path):
    return L.first_reports(V.reports(spark, path)).select("station_id", "valid_minute", "report_id", "wxcodes")


@query(
    "synchronized",
    """SELECT station_id, timestamp_utc, temperature_2m, relative_humidity_2m, surface_pressure, wind_speed_10m, wind_direction_10m,
      precipitation, cloud_cover, target, label_status, n_reports, n_reports_with_wx, n_ts_reports, target_observed, name, latitude,
      longitude, elevation_m FROM atmos JOIN labels USING (station_id, timestamp_utc) JOIN stations USING (station_id)""",
)
def synchronized(spark, path):
    out = L.synchronize(V.atmos(spark, path), labels_of(spark, path))
    return out.join(V.stations(spark).drop("ord"), "station_id")


@query(
    "lead_targets",
    """SELECT station_id, timestamp_utc, target, target_1h, target_2h, target_3h, timestamp_utc + INTERVAL 1 HOUR AS target_1h_timestamp,
      timestamp_utc + INTERVAL 2 HOUR AS target_2h_timestamp, timestamp_utc + INTERVAL 3 HOUR AS target_3h_timestamp,
      (target_1h IS NOT NULL)::INT AS target_1h_observed, (target_2h IS NOT NULL)::INT AS target_2h_observed,
      (target_3h IS NOT NULL)::INT AS target_3h_observed FROM targets""",
)
def lead_targets(spark, path):
    flags = [f"target_{k}h{s}" for k in V.LEADS for s in ("", "_timestamp", "_observed")]
    return targets_of(spark, path).select(*KEY, "target", *flags)


@query(
    "target_shift_check",
    """SELECT lead, count(*) AS n_rows, 0::BIGINT AS disagreements, 0::BIGINT AS unknown_as_zero, count(*) FILTER (y = target) AS same_as_now,
      count(*) FILTER (y <> target) AS differs_from_now FROM (
        SELECT '1h' AS lead, target, target_1h AS y FROM targets UNION ALL SELECT '2h', target, target_2h FROM targets
        UNION ALL SELECT '3h', target, target_3h FROM targets) GROUP BY lead""",
)
def target_shift_check(spark, path):
    labels, targets = labels_of(spark, path), targets_of(spark, path)
    checks = [T.shift_check(targets, labels, k) for k in V.LEADS]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query(
    "target_statistics",
    """SELECT lead, count(*) AS total_rows, count(y) AS observed_rows, count(*) FILTER (y = 1) AS positive_rows, count(*) FILTER (y = 0) AS negative_rows,
      count(*) - count(y) AS unavailable_rows, round(count(*) FILTER (y = 1) / count(y), 6) AS positive_rate,
      min(CASE WHEN y IS NOT NULL THEN timestamp_utc END) AS first_valid, max(CASE WHEN y IS NOT NULL THEN timestamp_utc END) AS last_valid
    FROM (SELECT 'target_1h' AS lead, timestamp_utc, target_1h AS y FROM targets UNION ALL
      SELECT 'target_2h', timestamp_utc, target_2h FROM targets UNION ALL SELECT 'target_3h', timestamp_utc, target_3h FROM targets) GROUP BY lead""",
)
def target_statistics(spark, path):
    y, ts = F.col("y"), F.col("timestamp_utc")
    long = T.unpivot_leads(targets_of(spark, path), KEY)
    return long.groupBy("lead").agg(
        F.count("*").alias("total_rows"),
        F.count("y").alias("observed_rows"),
        F.count_if(y == 1).alias("positive_rows"),
        F.count_if(y == 0).alias("negative_rows"),
        F.count_if(y.isNull()).alias("unavailable_rows"),
        F.round(F.try_divide(F.count_if(y == 1), F.count("y")), 6).alias("positive_rate"),
        F.min(F.when(y.isNotNull(), ts)).alias("first_valid"),
        F.max(F.when(y.isNotNull(), ts)).alias("last_valid"),
    )


@query(
    "missing_target_reasons",
    """SELECT lead, CASE WHEN timestamp_utc + to_hours(CAST(substr(lead, 8, 1) AS INTEGER)) > TIMESTAMP '2024-01-30 23:00:00'
        THEN 'outside_modelling_window' ELSE 'hour_present_in_window_but_no_genuine_observation' END AS reason, count(*) AS n
    FROM (SELECT 'target_1h' AS lead, timestamp_utc, target_1h AS y FROM targets UNION ALL
      SELECT 'target_2h', timestamp_utc, target_2h FROM targets UNION ALL SELECT 'target_3h', timestamp_utc, target_3h FROM targets)
    WHERE y IS NULL GROUP BY ALL""",
)
def missing_target_reasons(spark, path):
    return T.missing_reasons(T.unpivot_leads(targets_of(spark, path), KEY), V.last_hour(spark, path))
