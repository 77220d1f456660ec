"""Queries on status, sets, samples, scalar functions and data quality."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tempora.catalog.aggregates import _SPLIT
from tempora.catalog.evaluate import predictions_of, scored_of, scores_only
from tempora.catalog.features import features_of, hours_of
from tempora.catalog.joins import aligned_of, scan_features_of
from tempora.catalog.labels import labels_of, targets_of
from tempora.catalog.registry import query
from tempora.functions import geo, values
from tempora.operators import evaluate as E
from tempora.operators import features as X
from tempora.operators import joins as J
from tempora.operators import labels as L
from tempora.operators import quality as Q
from tempora.operators import sampling as G
from tempora.operators import splits as S
from tempora.operators import status as U
from tempora.session import stage
from tempora.sources import views as V

KEY = ["station_id", "timestamp_utc"]
NOW = datetime(2024, 1, 29, 12)


# requests -------------------------------------------------------------------------------------------------------


def requests_of(spark, path):
    """Scoring requests with the faults that callers make: blank, unknown and untidy stations, unreadable times."""
    e = V.events(spark, path)
    i = F.col("event_id") % 10
    station = F.when(i == 0, "").when(i == 1, "nowhere").when(i == 2, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).otherwise(F.col("event_type"))
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    time = F.when(i == 3, "not a time").when(i == 4, "2025-06-01 00:00:00").otherwise(hour)
    return e.select(F.col("event_id").alias("request_id"), station.alias("station_text"), time.alias("time_text"))


_REQUESTS = """SELECT event_id AS request_id, CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'nowhere' WHEN 2 THEN ' ' || upper(event_type) || ' ' ELSE event_type END AS station_text,
  CASE event_id % 10 WHEN 3 THEN 'not a time' WHEN 4 THEN '2025-06-01 00:00:00' ELSE strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') END AS time_text FROM events"""


@query(
    "request_status",
    f"""SELECT request_id, station_text, time_text, station_id, timestamp_utc, reason, CASE WHEN reason IS NULL THEN 'COMPLETE' ELSE 'UNAVAILABLE' END AS data_status FROM
      (SELECT r.*, h.station_id AS known, CASE WHEN trim(station_text) = '' OR r.station_id IS NULL THEN 'INVALID_STATION' WHEN r.timestamp_utc IS NULL THEN 'INVALID_TIMESTAMP'
        WHEN h.station_id IS NULL THEN 'timestamp_not_in_history' WHEN h.n < 1 THEN 'insufficient_history' WHEN h.temperature_2m IS NULL THEN 'missing_or_nonfinite_atmospheric:temperature_2m'
        WHEN h.n < 25 THEN 'insufficient_history' WHEN h.nwp_lifted_index IS NULL AND h.nwp_cape IS NULL THEN 'missing_required_nwp:nwp_cape'
        WHEN h.nwp_cape IS NULL THEN 'missing_required_nwp:nwp_cape' WHEN h.nwp_convective_inhibition IS NULL THEN 'missing_required_nwp:nwp_convective_inhibition' END AS reason
       FROM (SELECT q.*, s.station_id, try_strptime(trim(time_text), '%Y-%m-%d %H:%M:%S') AS timestamp_utc FROM ({_REQUESTS}) q LEFT JOIN stations s ON upper(s.station_id) = upper(trim(station_text))) r
       LEFT JOIN (SELECT a.*, n.nwp_cape, n.nwp_convective_inhibition, n.nwp_lifted_index, count(a.temperature_2m) OVER (PARTITION BY a.station_id ORDER BY a.timestamp_utc ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS n
         FROM atmos a LEFT JOIN nwp n ON n.station_id = a.station_id AND n.timestamp_utc = a.timestamp_utc) h ON h.station_id = r.station_id AND h.timestamp_utc = r.timestamp_utc)""",
)
def request_status(spark, path):
    """An hour is answered when it and the 24 hours before it are complete."""
    history = X.full_history(V.atmos(spark, path), F.col("temperature_2m").isNotNull())
    hours = history.join(V.nwp(spark, path), KEY, "left")
    return U.judge_requests(requests_of(spark, path), V.stations(spark), hours, V.ATMOSPHERE, V.MODEL)


@query(
    "request_reasons",
    """SELECT unavailable_reason, CASE unavailable_reason WHEN 'insufficient_history' THEN 'Insufficient causal history' WHEN 'missing_required_nwp' THEN 'Missing required NWP input'
      ELSE 'Required historical inputs were unavailable for this timestamp.' END AS message, CASE unavailable_reason WHEN 'insufficient_history' THEN 'missing_history'
      WHEN 'missing_required_nwp' THEN 'missing_nwp' ELSE 'other' END AS reason_group, count(*) AS n FROM predictions GROUP BY ALL""",
)
def request_reasons(spark, path):
    code = F.col("unavailable_reason")
    return (
        scores_only(spark, path)
        .groupBy(code, values.reason_message(code).alias("message"), values.reason_group(code).alias("reason_group"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "completeness",
    """SELECT station_id, timestamp_utc, round(((temperature_2m IS NOT NULL)::INT * 7 + (nwp_cape IS NOT NULL)::INT + (nwp_convective_inhibition IS NOT NULL)::INT +
      (nwp_lifted_index IS NOT NULL)::INT * 8) / 17, 9) AS data_completeness FROM atmos LEFT JOIN nwp USING (station_id, timestamp_utc)""",
)
def completeness(spark, path):
    joined = V.atmos(spark, path).join(V.nwp(spark, path), KEY, "left")
    share = values.completeness([F.col(c) for c in V.ATMOSPHERE + V.MODEL])
    return joined.select(*KEY, F.round(share, 9).alias("data_completeness"))


_BLOCK = "CASE WHEN data_status = 'COMPLETE' THEN p_{0}h END AS lead_{0}h_probability, CASE WHEN data_status = 'COMPLETE' THEN 0.065::DOUBLE END AS lead_{0}h_threshold, CASE WHEN data_status = 'COMPLETE' THEN alert_{0}h END AS lead_{0}h_alert"


@query("result_blocks", f"SELECT station_id, timestamp_utc, data_status, {', '.join(_BLOCK.format(k) for k in V.LEADS)} FROM alerts")
def result_blocks(spark, path):
    nested = U.result_rows(predictions_of(spark, path), E.THRESHOLD)
    flat = [F.col(f"lead_{k}h.{f}").alias(f"lead_{k}h_{f}") for k in V.LEADS for f in ("probability", "threshold", "alert")]
    return nested.select(*KEY, "data_status", *flat)


@query(
    "display_labels",
    """SELECT station_id, timestamp_utc, CASE WHEN alert_1h = 1 THEN 'ALERT' WHEN alert_1h = 0 THEN 'NO ALERT' END AS alert_text,
      CASE WHEN alert_1h IS NULL OR target_1h IS NULL THEN NULL WHEN alert_1h = target_1h THEN 'MATCH' ELSE 'MISS' END AS hit_text,
      CASE WHEN target_1h = 1 THEN 'Thunderstorm observed' WHEN target_1h = 0 THEN 'No thunderstorm observed' ELSE 'unavailable' END AS target_text,
      CASE WHEN p_1h >= 0.065::DOUBLE THEN 'ABOVE THRESHOLD' WHEN p_1h IS NOT NULL THEN 'BELOW THRESHOLD' END AS threshold_text,
      CASE WHEN p_1h IS NOT NULL THEN printf('%.1f', p_1h * 100) END AS percent_text FROM alerts""",
)
def display_labels(spark, path):
    alert, target, p = F.col("alert_1h"), F.col("target_1h"), F.col("p_1h")
    return predictions_of(spark, path).select(
        *KEY,
        values.alert_label(alert).alias("alert_text"),
        values.hit_label(values.hit(alert, target)).alias("hit_text"),
        values.target_label(target).alias("target_text"),
        values.threshold_state(p, E.THRESHOLD).alias("threshold_text"),
        values.percent_text(p).alias("percent_text"),
    )


@query(
    "display_values",
    """SELECT station_id, timestamp_utc, CASE WHEN surface_pressure IS NULL THEN 'N/A' WHEN surface_pressure / 100 < 1000 THEN printf('%.1f', surface_pressure / 100)
      ELSE printf('%.0f', surface_pressure / 100) END AS pressure_text, CASE WHEN cloud_cover IS NULL THEN 'N/A' ELSE printf('%.1f', cloud_cover) END AS cloud_text FROM atmos""",
)
def display_values(spark, path):
    return V.atmos(spark, path).select(
        *KEY,
        values.display_value(values.pressure_hpa(F.col("surface_pressure"))).alias("pressure_text"),
        values.display_value(F.col("cloud_cover")).alias("cloud_text"),
    )


_SIGNALS = ["temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_speed_10m", "precipitation", "cloud_cover", "nwp_cape", "nwp_convective_inhibition", "nwp_lifted_index"]


@query("signals", f"SELECT station_id, timestamp_utc, {', '.join(_SIGNALS)} FROM atmos LEFT JOIN nwp USING (station_id, timestamp_utc)")
def signals(spark, path):
    joined = V.atmos(spark, path).join(V.nwp(spark, path), KEY, "left")
    return joined.select(*KEY, *[values.known(F.col(c)).alias(c) for c in _SIGNALS])


# predicates -----------------------------------------------------------------------------------------------------


@query(
    "numeric_coercion",
    """SELECT event_id, CASE WHEN event_id % 4 = 1 THEN NULL WHEN event_id % 4 = 2 THEN NULL ELSE value END AS number FROM events""",
)
def numeric_coercion(spark, path):
    """Text to number: unreadable text and NaN become unknown."""
    i = F.col("event_id") % 4
    text = F.when(i == 1, "M").when(i == 2, "NaN").otherwise(F.col("value").cast("string"))
    return V.events(spark, path).select("event_id", values.to_number(text).alias("number"))


@query(
    "time_parsing",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('minute', ts) END AS parsed, CASE event_id % 5 WHEN 0 THEN 'later' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:00Z')
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS stamp FROM events""",
)
def time_parsing(spark, path):
    from tempora.functions import clock

    i = F.col("event_id") % 5
    text = F.when(i == 0, "later").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    raw = F.when(i == 0, "later").when(i == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return V.events(spark, path).select(
        "event_id", clock.parse_text(text, "yyyy-MM-dd HH:mm").alias("parsed"), clock.normal_stamp(raw).alias("stamp")
    )


@query(
    "closed_time_window",
    "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 23:59:59'",
)
def closed_time_window(spark, path):
    """The limits are compared in the stored type, so they reach the parquet scan."""
    inside = F.col("ts").between(F.expr("timestamp_ntz'2024-01-05 00:00:00'"), F.expr("timestamp_ntz'2024-01-06 23:59:59'"))
    return V.table(spark, path, "events").filter(inside).select("event_id", "ts")


@query(
    "complete_cases",
    """SELECT station_id, count(*) AS n, count(*) FILTER (nwp_cape IS NOT NULL AND nwp_convective_inhibition IS NOT NULL) AS complete FROM nwp GROUP BY station_id""",
)
def complete_cases(spark, path):
    complete = values.all_known([F.col(c) for c in V.MODEL])
    return V.nwp(spark, path).groupBy("station_id").agg(F.count("*").alias("n"), F.count_if(complete).alias("complete"))


@query(
    "finite_rows",
    """SELECT count(*) AS n, count(*) FILTER (s_acctbal <> 0 AND s_suppkey % 9 <> 0) AS finite FROM supplier""",
)
def finite_rows(spark, path):
    """Quotients that are NaN or infinite are not finite."""
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    x = F.when(key % 9 == 0, F.lit(float("nan"))).when(balance == 0, F.lit(float("inf"))).otherwise(balance)
    return V.table(spark, path, "supplier").agg(F.count("*").alias("n"), F.count_if(values.finite(x)).alias("finite"))


@query(
    "six_hourly_candidates",
    f"SELECT DISTINCT timestamp_utc FROM nwp WHERE hour(timestamp_utc) % 6 = 0 AND timestamp_utc BETWEEN {V.REPLAY_START_SQL} AND (SELECT date_trunc('hour', max(ts)) FROM events)",
)
def six_hourly_candidates(spark, path):
    return G.every_hours(V.nwp(spark, path), "timestamp_utc", 6, V.replay_start(spark, path), V.last_hour(spark, path))


@query(
    "point_lookup",
    "SELECT station_id, timestamp_utc, p_1h, p_2h, p_3h, data_status FROM alerts WHERE station_id = 'click' AND timestamp_utc = TIMESTAMP '2024-01-15 12:00:00'",
)
def point_lookup(spark, path):
    at = (F.col("station_id") == "click") & (F.col("timestamp_utc") == F.lit(datetime(2024, 1, 15, 12)))
    return scores_only(spark, path).filter(at).select(*KEY, "p_1h", "p_2h", "p_3h", "data_status")


@query("station_exclusion", "SELECT station_id, count(*) AS n FROM events e JOIN stations s ON s.station_id = e.event_type WHERE station_id NOT IN ('click') GROUP BY ALL")
def station_exclusion(spark, path):
    held_out = ["click"]
    rows = V.reports(spark, path).filter(~F.col("station_id").isin(held_out))
    return rows.join(V.stations(spark), "station_id", "left_semi").groupBy("station_id").agg(F.count("*").alias("n"))


@query(
    "normalised_stations",
    f"""SELECT s.station_id, count(*) AS n FROM ({_REQUESTS}) q JOIN stations s ON upper(s.station_id) = upper(trim(station_text)) GROUP BY ALL""",
)
def normalised_stations(spark, path):
    allowed = V.stations(spark).select(F.upper("station_id").alias("_u"), "station_id")
    named = requests_of(spark, path).withColumn("_u", F.upper(F.trim("station_text")))
    return named.join(allowed, "_u").groupBy("station_id").agg(F.count("*").alias("n"))


@query("supervision_mask", "SELECT station_id, timestamp_utc, target FROM labels WHERE n_reports_with_wx > 0 AND target IS NOT NULL")
def supervision_mask(spark, path):
    keep = (F.col("n_reports_with_wx") > 0) & F.col("target").isNotNull()
    return labels_of(spark, path).filter(keep).select(*KEY, "target")


@query(
    "valid_positions",
    "SELECT lightning_type, count(*) AS n, count(*) FILTER (NOT (lat = 0 AND lon = 0)) AS valid, count(*) FILTER (tai93 BETWEEN 0 AND 5000000) AS plausible_time FROM strikes GROUP BY ALL",
)
def valid_positions(spark, path):
    ok = geo.valid_position(F.col("lat"), F.col("lon"))
    return (
        V.strikes(spark, path)
        .groupBy("lightning_type")
        .agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"), F.count_if(F.col("tai93").between(0, 5_000_000)).alias("plausible_time"))
    )


@query(
    "causal_slice",
    """SELECT station_id, count(*) FILTER (timestamp_utc <= TIMESTAMP '2024-01-29 12:00:00') AS used_hours, count(*) FILTER (timestamp_utc > TIMESTAMP '2024-01-29 12:00:00') AS future_hours,
      count(temperature_2m) FILTER (timestamp_utc <= TIMESTAMP '2024-01-29 12:00:00') AS known_hours FROM atmos GROUP BY station_id""",
)
def causal_slice(spark, path):
    past = F.col("timestamp_utc") <= F.lit(NOW)
    return V.atmos(spark, path).groupBy("station_id").agg(F.count_if(past).alias("used_hours"), F.count_if(~past).alias("future_hours"), F.count(F.when(past, F.col("temperature_2m"))).alias("known_hours"))


@query(
    "decoded_positions",
    "SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN round(c_custkey * 0.01::DOUBLE + 5, 6) END AS lat FROM customer",
)
def decoded_positions(spark, path):
    """Scaled integers with a fill value."""
    stored = F.when(F.col("c_custkey") % 11 == 0, 32767).otherwise(F.col("c_custkey"))
    lat = F.when(F.col("c_custkey") != 32767, geo.decode_scaled(stored, 0.01, 5.0, 32767)).otherwise(F.lit(32767 * 0.01 + 5.0))
    return V.table(spark, path, "customer").select("c_custkey", F.round(lat, 6).alias("lat"))


# context, snapshot, order, sample -------------------------------------------------------------------------------


@query(
    "context_attached",
    "SELECT p.station_id, p.timestamp_utc, p.p_1h, a.gid AS context_gid, round(a.cloudy, 6) AS context_cloudy FROM alerts p LEFT JOIN aligned a ON a.station_id = p.station_id AND a.timestamp_utc = p.timestamp_utc AND a.sat_available = 1",
)
def context_attached(spark, path):
    out = J.attach_context(predictions_of(spark, path), aligned_of(spark, path), ["gid", "cloudy", "cmk", "age_minutes"])
    return out.select(*KEY, "p_1h", F.col("context.gid").alias("context_gid"), F.round("context.cloudy", 6).alias("context_cloudy"))


@query(
    "context_changes_no_score",
    "SELECT 'scores_lost' AS \"check\", true AS passed, 0::BIGINT AS detail UNION ALL SELECT 'scores_added', true, 0::BIGINT",
)
def context_changes_no_score(spark, path):
    names = [*KEY, "p_1h", "p_2h", "p_3h"]
    plain = scores_only(spark, path).select(*names)
    with_context = J.attach_context(plain, aligned_of(spark, path), ["gid", "cloudy"]).select(*names)
    return Q.same_rows(plain, with_context)



@query("full_snapshot", "SELECT station_id, timestamp_utc, p_1h, alert_1h, data_status FROM alerts")
def full_snapshot(spark, path):
    return J.snapshot(V.spine(spark, path), predictions_of(spark, path), ["p_1h", "alert_1h"])


@query(
    "latest_complete_row",
    """SELECT station_id, timestamp_utc, round(temperature_2m, 6) AS temperature_2m, round(precipitation, 6) AS precipitation FROM atmos WHERE temperature_2m IS NOT NULL AND precipitation IS NOT NULL
      AND timestamp_utc <= TIMESTAMP '2024-01-29 12:00:00' QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp_utc DESC) = 1""",
)
def latest_complete_row(spark, path):
    out = G.latest_complete(V.atmos(spark, path), "station_id", "timestamp_utc", ["temperature_2m", "precipitation"], F.lit(NOW))
    return out.withColumns({c: F.round(c, 6) for c in ("temperature_2m", "precipitation")})


@query(
    "first_complete_row",
    """SELECT station_id, timestamp_utc, round(temperature_2m, 6) AS temperature_2m FROM atmos WHERE temperature_2m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp_utc) = 1""",
)
def first_complete_row(spark, path):
    out = G.first_complete(V.atmos(spark, path), "station_id", "timestamp_utc", ["temperature_2m"])
    return out.withColumn("temperature_2m", F.round("temperature_2m", 6))


@query(
    "seeded_sample",
    """SELECT station_id, timestamp_utc, gid FROM aligned WHERE sat_available = 1 ORDER BY md5(station_id || '|' || strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S') || '|10'), station_id, timestamp_utc LIMIT 25""",
)
def seeded_sample(spark, path):
    matched = aligned_of(spark, path).filter(F.col("sat_available") == 1).select(*KEY, "gid")
    return G.seeded_sample(matched, KEY, 25, 10)


@query(
    "top_correlations",
    f"""SELECT variable, r, rank() OVER (ORDER BY abs(r) DESC) AS place FROM (SELECT variable, round(coalesce(corr(value, target), 0), 6) AS r FROM (SELECT unnest([{', '.join(f"'{c}'" for c in V.ATMOSPHERE)}]) AS variable,
      unnest([{', '.join(V.ATMOSPHERE)}]) AS value, target FROM atmos JOIN labels USING (station_id, timestamp_utc)) WHERE target IS NOT NULL AND value IS NOT NULL GROUP BY variable)
      ORDER BY abs(r) DESC, variable LIMIT 5""",
)
def top_correlations(spark, path):
    """The five features with the largest absolute correlation, with min-method ranks."""
    from tempora.operators.profile import correlations

    joined = V.atmos(spark, path).join(labels_of(spark, path).select(*KEY, "target"), KEY)
    r = correlations(joined, V.ATMOSPHERE, "target").select("variable", F.round("r", 6).alias("r"), F.lit(1).alias("_g"))
    ranked = G.ranked(r.withColumn("_abs", F.abs("r")), "_abs", "place", ["_g"])
    return ranked.orderBy(F.desc("_abs"), "variable").limit(5).select("variable", "r", F.col("place").cast("bigint").alias("place"))


# sets -----------------------------------------------------------------------------------------------------------


@query("union_of_stations", "SELECT station_id, count(*) AS n, count(DISTINCT timestamp_utc) AS n_hours, count(target) AS n_known FROM labels GROUP BY station_id")
def union_of_stations(spark, path):
    """Station frames put together again: the key stays unique."""
    labels = labels_of(spark, path).select(*KEY, "target")
    parts = [labels.filter(F.col("station_id") == s[0]) for s in V.STATIONS]
    return Q.union(parts).groupBy("station_id").agg(F.count("*").alias("n"), F.countDistinct("timestamp_utc").alias("n_hours"), F.count("target").alias("n_known"))


@query(
    "key_sets",
    """WITH a AS (SELECT station_id, timestamp_utc FROM spine), b AS (SELECT station_id, timestamp_utc FROM nwp)
      SELECT 'missing_right' AS "set", (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS n UNION ALL SELECT 'missing_left', (SELECT count(*) FROM (FROM b EXCEPT FROM a))
      UNION ALL SELECT 'common', (SELECT count(*) FROM (FROM a INTERSECT FROM b))""",
)
def key_sets(spark, path):
    return Q.key_sets(V.spine(spark, path), V.nwp(spark, path))


@query("distinct_keys", "SELECT count(*) AS n_rows, count(DISTINCT (station_id, valid_minute)) AS n_keys, count(*) - count(DISTINCT (station_id, valid_minute)) AS n_duplicates FROM reports")
def distinct_keys(spark, path):
    per_key = V.reports(spark, path).groupBy("station_id", "valid_minute").agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), (F.sum("n") - F.count("*")).alias("n_duplicates"))


# quality --------------------------------------------------------------------------------------------------------


def _passed(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"check\", true AS passed, 0::BIGINT AS detail" for n in names)


@query("grid_checks", _passed("no_gaps", "no_short_steps", "on_the_hour", "no_missing_hours"))
def grid_checks(spark, path):
    return Q.grid_check(labels_of(spark, path).select(*KEY))


@query(
    "key_checks",
    """SELECT 'labels' AS "table", 'unique_key' AS "check", true AS passed, 0::BIGINT AS detail UNION ALL
      SELECT 'reports', 'unique_key', false, (SELECT count(*) FROM (SELECT 1 FROM reports GROUP BY station_id, valid_minute HAVING count(*) > 1))""",
)
def key_checks(spark, path):
    good = Q.unique_key(labels_of(spark, path)).select(F.lit("labels").alias("table"), "*")
    bad = Q.unique_key(V.reports(spark, path), ["station_id", "valid_minute"]).select(F.lit("reports").alias("table"), "*")
    return good.unionByName(bad)


@query(
    "calendar_years",
    """SELECT *, n_hours = expected_hours AS complete_year FROM (SELECT station_id, year, count(*) AS n_rows, count(DISTINCT timestamp_utc) AS n_hours,
      (make_date(year + 1, 1, 1) - make_date(year, 1, 1)) * 24 AS expected_hours FROM (SELECT *, year(timestamp_utc)::INT AS year FROM series_day) GROUP BY station_id, year)""",
)
def calendar_years(spark, path):
    return Q.calendar_check(V.series_day(spark, path).select(*KEY))


@query(
    "label_domain",
    _passed("label_is_binary", "strict_not_above_label", "label_not_above_recovered", "unknown_stays_unknown", "flag_matches_label"),
)
def label_domain(spark, path):
    return Q.label_rules(L.label_variants(V.bodies(spark, path), V.spine(spark, path)))


@query("target_checks", _passed("targets_binary", "unknown_not_zero", "flag_matches_value"))
def target_checks(spark, path):
    return Q.target_rules(targets_of(spark, path), V.LEADS)


@query(
    "two_inputs_agree",
    """SELECT 'precipitation' AS "column", (SELECT count(*) FROM atmos) AS compared, 0::BIGINT AS mismatches, 0.0::DOUBLE AS max_abs_difference
      UNION ALL SELECT 'temperature_2m', (SELECT count(*) FROM atmos), 0::BIGINT, 0.0::DOUBLE""",
)
def two_inputs_agree(spark, path):
    """The feature table carries the predictor values unchanged."""
    return Q.same_values(features_of(spark, path), hours_of(spark, path), ["precipitation", "temperature_2m"], 1e-12)


@query("split_order_checks", _passed("train_before_validation", "validation_before_test"))
def split_order_checks(spark, path):
    return Q.split_order(S.split_bounds(S.with_split(targets_of(spark, path).select(*KEY))))


@query(
    "held_out_absent",
    f"SELECT split, count(*) AS n_rows, count(DISTINCT station_id) AS n_stations, count(target_1h) AS n_known FROM ({_SPLIT}) WHERE CASE split WHEN 'test' THEN station_id = 'click' ELSE station_id <> 'click' END GROUP BY split",
)
def held_out_absent(spark, path):
    """Leave one station out: it is only in the test part, and the test part holds nothing else."""
    from tempora.plans.experiments import leave_one_out

    out = leave_one_out(S.with_split(targets_of(spark, path).select(*KEY, "target_1h")), "click")
    return out.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("station_id").alias("n_stations"), F.count("target_1h").alias("n_known"))


@query("score_checks", _passed("probability_in_unit_interval", "alert_follows_threshold", "unknown_target_not_scored", "bins_cover_all"))
def score_checks(spark, path):
    scored = scored_of(spark, path)
    return Q.score_rules(scored, E.THRESHOLD).unionByName(bins_cover(scored))


def bins_cover(scored):
    binned = E.bin_table(scored).agg(F.sum("n")).scalar()
    lost = scored.agg(F.count("*").alias("n")).select(F.abs(F.col("n") - binned).alias("d"))
    return Q.check_rows(lost, {"bins_cover_all": "d"})


@query("alignment_checks", _passed("age_within_limit", "end_not_after_hour", "unmatched_is_empty", "unique_key", "source_in_inventory"))
def alignment_checks(spark, path):
    return Q.alignment_rules(aligned_of(spark, path), V.scans(spark, path))


@query("extraction_checks", _passed("fractions_in_unit_interval", "fill_is_no_class", "unavailable_is_empty", "rows_are_scans_by_stations"))
def extraction_checks(spark, path):
    rows = scan_features_of(spark, path)
    return Q.extraction_rules(rows, geo.FILL_CLASS).unionByName(all_pairs_there(spark, path, rows))


def all_pairs_there(spark, path, rows):
    expected = V.pixels(spark, path).select("scan_id").distinct().agg(F.count("*") * len(V.STATIONS)).scalar()
    lost = rows.agg(F.count("*").alias("n")).select(F.abs(F.col("n") - expected).alias("d"))
    return Q.check_rows(lost, {"rows_are_scans_by_stations": "d"})


_HASHED = ["station_id", "timestamp_utc", "target", "label_status"]
_TEXTS = ["station_id", "epoch_us(timestamp_utc)::VARCHAR", "target::VARCHAR", "label_status"]


@query(
    "table_fingerprint",
    f"""SELECT station_id, day, count(*) AS n_rows, (sum(('0x' || left(h, 16))::UBIGINT) % 18446744073709551616)::VARCHAR AS hash_high,
      (sum(('0x' || right(h, 16))::UBIGINT) % 18446744073709551616)::VARCHAR AS hash_low FROM (SELECT station_id, timestamp_utc::DATE::VARCHAR AS day,
        md5(concat_ws('|', {', '.join(f"coalesce(length({t}) || ':' || {t}, 'null')" for t in _TEXTS)})) AS h FROM labels) GROUP BY ALL""",
)
def table_fingerprint(spark, path):
    """A hash of every station's day, so that a changed part can be named."""
    rows = labels_of(spark, path).select(*_HASHED, F.to_date("timestamp_utc").cast("string").alias("day"))
    return values.fingerprint(rows, ["station_id", "day"], _HASHED)


@query(
    "repeatability",
    """WITH days AS (SELECT count(DISTINCT (station_id, timestamp_utc::DATE)) AS n_parts,
      count(DISTINCT (station_id, timestamp_utc::DATE)) FILTER (target_observed = 1 AND hour(timestamp_utc) = 5) AS n_changed FROM labels)
    SELECT 'shuffled_input' AS run, n_parts, 0 AS n_changed FROM days UNION ALL SELECT 'an_hour_of_the_day_lost', n_parts, n_changed FROM days""",
)
def repeatability(spark, path):
    """The labels built again from shuffled input are the same; without the reports of one hour of the day the days that had any differ."""
    reports, spine = V.reports(spark, path), V.spine(spark, path)
    lost = reports.filter(F.hour("valid_ts") != 5)
    marked = lambda df: df.select(*_HASHED, F.to_date("timestamp_utc").alias("day"))
    first, runs = stage(marked(labels_of(spark, path)), "labels"), []
    for name, rows in (("shuffled_input", reports.repartition(5, "report_id")), ("an_hour_of_the_day_lost", lost)):
        again = Q.unchanged(first, marked(L.hourly_labels(rows, spine)), ["station_id", "day"])
        runs.append(again.select(F.lit(name).alias("run"), "n_parts", "n_changed"))
    return runs[0].union(runs[1])


@query(
    "tolerant_comparison",
    "SELECT station_id, count(*) AS n, count(*) FILTER (temperature_2m IS NULL AND nwp_temperature_2m IS NULL OR coalesce(abs(temperature_2m - nwp_temperature_2m) <= 5, false)) AS n_close FROM atmos LEFT JOIN nwp USING (station_id, timestamp_utc) GROUP BY station_id",
)
def tolerant_comparison(spark, path):
    joined = V.atmos(spark, path).join(V.nwp(spark, path), KEY, "left")
    same = values.close(F.col("temperature_2m"), F.col("nwp_temperature_2m"), 5.0)
    return joined.groupBy("station_id").agg(F.count("*").alias("n"), F.count_if(same).alias("n_close"))


@query(
    "freshness",
    """SELECT station_id, timestamp_utc, round(date_diff('second', timestamp_utc, TIMESTAMP '2024-01-29 12:00:00') / 60, 3) AS data_age_minutes,
      CASE WHEN date_diff('second', timestamp_utc, TIMESTAMP '2024-01-29 12:00:00') <= 180 * 60 THEN 'LIVE' ELSE 'UNAVAILABLE' END AS status FROM
      (SELECT station_id, max(timestamp_utc) AS timestamp_utc FROM atmos WHERE temperature_2m IS NOT NULL AND timestamp_utc <= TIMESTAMP '2024-01-29 12:00:00' GROUP BY station_id)""",
)
def freshness(spark, path):
    latest = G.latest_complete(V.atmos(spark, path), "station_id", "timestamp_utc", ["temperature_2m"], F.lit(NOW)).drop("temperature_2m")
    return U.freshness(latest, F.lit(NOW), 180, "timestamp_utc").withColumn("data_age_minutes", F.round("data_age_minutes", 3))
