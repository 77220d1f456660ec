"""Queries on causal features, histories and their probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.registry import query
from tempora.functions import clock, wind
from tempora.operators import features as X
from tempora.operators import quality as Q
from tempora.operators.profile import correlations
from tempora.catalog.labels import labels_of
from tempora.operators import series as S
from tempora.sources import views as V

KEY = ["station_id", "timestamp_utc"]
#: Probed are the hours whose number since 1970 divides by this; a sampling operator.
PROBE_EVERY = 7
SHORT_HISTORY = ["temperature_lag_1h", "humidity_change_1h", "precipitation_roll_sum_3h"]


def hours_of(spark, path):
    return V.atmos(spark, path).join(V.stations(spark).select("station_id", *X.LOCATION), "station_id")


def features_of(spark, path):
    return X.station_features(hours_of(spark, path))


def rounded(df, names, digits=6, keep=()):
    return df.select(*keep, *[F.round(n, digits).alias(n) for n in names])


def _full(func: str, source: str, rows: int) -> str:
    w = f"(PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({source}) OVER {w} = {rows} THEN {func}({source}) OVER {w} END"


def feature_sql() -> dict[str, str]:
    """The 73 feature formulas on the gap-free calendar, where row steps are clock steps."""
    turn = "2 * pi()"
    out = {c: c for c in X.CURRENT + X.LOCATION}
    out |= {
        "hour_sin": f"sin({turn} * hour(timestamp_utc) / 24)",
        "hour_cos": f"cos({turn} * hour(timestamp_utc) / 24)",
        "month_sin": f"sin({turn} * (month(timestamp_utc) - 1) / 12)",
        "month_cos": f"cos({turn} * (month(timestamp_utc) - 1) / 12)",
        "wind_direction_sin": "sin(radians(wind_direction_10m))",
        "wind_direction_cos": "cos(radians(wind_direction_10m))",
        "wind_u_10m": "-wind_speed_10m * sin(radians(wind_direction_10m))",
        "wind_v_10m": "-wind_speed_10m * cos(radians(wind_direction_10m))",
    }
    lag = "lag({0}, {1}) OVER (PARTITION BY station_id ORDER BY timestamp_utc)"
    for stem, source in X.SOURCES.items():
        for h in X.LAG_HOURS:
            out[f"{stem}_lag_{h}h"] = lag.format(source, h)
        for h in X.CHANGE_HOURS:
            out[f"{stem}_change_{h}h"] = f"{source} - {lag.format(source, h)}"
    for h in X.SUM_HOURS:
        out[f"precipitation_roll_sum_{h}h"] = _full("sum", "precipitation", h)
    for stem in X.MEAN_STEMS:
        for h in X.MEAN_HOURS:
            out[f"{stem}_roll_mean_{h}h"] = _full("avg", X.SOURCES[stem], h)
    return out


_SQL = feature_sql()
_BASE = "SELECT * FROM atmos JOIN stations USING (station_id)"


# Copies and single differences are exact in any engine; sums, means and angles are compared after rounding.
EXACT = {*X.CURRENT, *X.LOCATION, *X.LAGS, *X.CHANGES}


def feature_list(names) -> str:
    return ", ".join(f"{_SQL[n]} AS {n}" if n in EXACT else f"round({_SQL[n]}, 6) AS {n}" for n in names)


def rounded_features(df, names):
    return rounded(df, [n for n in names if n not in EXACT], keep=[*KEY, *[n for n in names if n in EXACT]])


@query("station_features", f"SELECT station_id, timestamp_utc, {feature_list(X.FEATURES)} FROM ({_BASE})")
def station_features(spark, path):
    return rounded_features(features_of(spark, path), X.FEATURES)


@query("compact_features", f"SELECT station_id, timestamp_utc, {feature_list(X.COMPACT_FEATURES)} FROM ({_BASE})")
def compact_features(spark, path):
    return rounded_features(X.compact_features(hours_of(spark, path)), X.COMPACT_FEATURES)


def _prior(func: str, source: str, rows: int) -> str:
    w = f"(PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({source}) OVER {w} = {rows} THEN {func}({source}) OVER {w} END"


_PRIOR_SQL = dict(_SQL)
for _stem in ("temperature", "humidity", "pressure", "wind_speed"):
    for _h in X.CHANGE_HOURS:
        _PRIOR_SQL[f"{X.SOURCES[_stem]}_change_{_h}h"] = _SQL[f"{_stem}_change_{_h}h"]
_PRIOR_SQL |= {
    "precip_roll_3h": _prior("sum", "precipitation", 3),
    "precip_roll_6h": _prior("sum", "precipitation", 6),
    "humidity_roll_3h": _prior("avg", "relative_humidity_2m", 3),
    "pressure_roll_3h": _prior("avg", "surface_pressure", 3),
}
_PRIOR_LIST = ", ".join(f"round({_PRIOR_SQL[n]}, 6) AS {n}" for n in X.PRIOR_FEATURES)


@query("prior_features", f"SELECT station_id, timestamp_utc, {_PRIOR_LIST} FROM ({_BASE})")
def prior_features(spark, path):
    return rounded(X.prior_features(hours_of(spark, path)), X.PRIOR_FEATURES, keep=KEY)


@query(
    "warm_up_dropped",
    f"""SELECT station_id, count(*) AS usable_rows, min(timestamp_utc) AS first_usable, max(timestamp_utc) AS last_usable FROM
      (SELECT station_id, timestamp_utc, {feature_list(X.HISTORY_FEATURES)} FROM ({_BASE}))
    WHERE {' AND '.join(f'{n} IS NOT NULL' for n in X.HISTORY_FEATURES)} GROUP BY station_id""",
)
def warm_up_dropped(spark, path):
    return (
        X.drop_warm_up(features_of(spark, path))
        .groupBy("station_id")
        .agg(
            F.count("*").alias("usable_rows"), F.min("timestamp_utc").alias("first_usable"), F.max("timestamp_utc").alias("last_usable")
        )
    )


@query(
    "short_history_rows",
    f"""SELECT * FROM (SELECT station_id, timestamp_utc, {feature_list(SHORT_HISTORY)} FROM ({_BASE}))
    WHERE {' AND '.join(f'{n} IS NOT NULL' for n in SHORT_HISTORY)}""",
)
def short_history_rows(spark, path):
    return rounded_features(X.drop_warm_up(features_of(spark, path), SHORT_HISTORY), SHORT_HISTORY)


@query(
    "row_accounting",
    f"""SELECT station_id, count(*) AS total_rows, count(*) FILTER (future IS NULL) AS future_missing,
      count(*) FILTER (future IS NOT NULL AND NOT usable) AS history_missing, count(*) FILTER (future IS NOT NULL AND usable) AS usable_rows,
      min(CASE WHEN future IS NOT NULL AND usable THEN timestamp_utc END) AS first_usable,
      max(CASE WHEN future IS NOT NULL AND usable THEN timestamp_utc END) AS last_usable FROM (
        SELECT *, temperature_2m_change_1h IS NOT NULL AND precip_roll_3h IS NOT NULL AND temperature_2m IS NOT NULL AS usable FROM (
          SELECT station_id, timestamp_utc, temperature_2m, {_PRIOR_SQL['temperature_2m_change_1h']} AS temperature_2m_change_1h,
          {_PRIOR_SQL['precip_roll_3h']} AS precip_roll_3h, CASE WHEN count(precipitation) OVER w = 3 THEN sum(precipitation) OVER w END AS future
          FROM atmos WINDOW w AS (PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)))
    GROUP BY station_id""",
)
def row_accounting(spark, path):
    """Rows lost to a missing future window and to missing history."""
    hours = hours_of(spark, path)
    future = X.future_total(hours.select(*KEY, "precipitation"), "precipitation", 3, S.STEP_HOUR, "future").drop("precipitation")
    rows = X.prior_features(hours).join(future, KEY)
    usable = F.col("temperature_2m_change_1h").isNotNull() & F.col("precip_roll_3h").isNotNull() & F.col("temperature_2m").isNotNull()
    has_future = F.col("future").isNotNull()
    keep = has_future & usable
    return rows.groupBy("station_id").agg(
        F.count("*").alias("total_rows"),
        F.count_if(~has_future).alias("future_missing"),
        F.count_if(has_future & ~usable).alias("history_missing"),
        F.count_if(keep).alias("usable_rows"),
        F.min(F.when(keep, F.col("timestamp_utc"))).alias("first_usable"),
        F.max(F.when(keep, F.col("timestamp_utc"))).alias("last_usable"),
    )


@query(
    "full_history",
    """SELECT station_id, timestamp_utc, n AS history_rows, n = 25 AS history_ok FROM (SELECT *, count(temperature_2m) OVER
      (PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS n FROM atmos)""",
)
def full_history(spark, path):
    hours = V.atmos(spark, path).select(*KEY, "temperature_2m")
    return X.full_history(hours, F.col("temperature_2m").isNotNull()).drop("temperature_2m")


@query(
    "daily_future_total",
    """SELECT a.station_id, a.timestamp_utc, a.cents, CASE WHEN count(b.cents) = 3 THEN sum(b.cents)::BIGINT END AS next_three_days FROM series_day a
      LEFT JOIN series_day b ON b.station_id = a.station_id AND b.timestamp_utc > a.timestamp_utc AND b.timestamp_utc <= a.timestamp_utc + INTERVAL 3 DAY
      GROUP BY ALL""",
)
def daily_future_total(spark, path):
    daily = V.series_day(spark, path).select(*KEY, "cents")
    return X.future_total(daily, "cents", 3, S.STEP_DAY, "next_three_days")


@query(
    "daily_windows",
    """SELECT a.station_id, a.timestamp_utc, max(CASE WHEN b.timestamp_utc = a.timestamp_utc - INTERVAL 1 DAY THEN b.cents END) AS lag_1d,
      a.cents - max(CASE WHEN b.timestamp_utc = a.timestamp_utc - INTERVAL 3 DAY THEN b.cents END) AS change_3d,
      CASE WHEN count(b.cents) FILTER (b.timestamp_utc > a.timestamp_utc - INTERVAL 3 DAY) = 3 THEN
        (sum(b.cents) FILTER (b.timestamp_utc > a.timestamp_utc - INTERVAL 3 DAY))::BIGINT END AS roll_sum_3d,
      CASE WHEN count(b.cents) FILTER (b.timestamp_utc < a.timestamp_utc AND b.timestamp_utc >= a.timestamp_utc - INTERVAL 3 DAY) = 3 THEN
        (sum(b.cents) FILTER (b.timestamp_utc < a.timestamp_utc AND b.timestamp_utc >= a.timestamp_utc - INTERVAL 3 DAY))::BIGINT END AS prior_sum_3d
      FROM series_day a JOIN series_day b ON b.station_id = a.station_id AND b.timestamp_utc <= a.timestamp_utc
        AND b.timestamp_utc > a.timestamp_utc - INTERVAL 6 DAY GROUP BY a.station_id, a.timestamp_utc, a.cents""",
)
def daily_windows(spark, path):
    """Clock windows on a series with real gaps."""
    daily = V.series_day(spark, path).select(*KEY, "cents")
    series = S.Chunked(daily, ["station_id"], "timestamp_utc", back=6, step=S.STEP_DAY)
    cents = F.col("cents")
    return series.select(
        *KEY,
        series.at(cents, -1).alias("lag_1d"),
        (cents - series.at(cents, -3)).alias("change_3d"),
        series.full_sum(cents, -2, 0).alias("roll_sum_3d"),
        series.full_sum(cents, -3, -1).alias("prior_sum_3d"),
    )


@query(
    "clock_encodings",
    """SELECT hour(valid_ts) AS hour, month(valid_ts) AS month, year(valid_ts) AS year, round(sin(2 * pi() * hour(valid_ts) / 24), 9) AS hour_sin,
      round(cos(2 * pi() * (month(valid_ts) - 1) / 12), 9) AS month_cos, 'winter' AS season, count(*) AS n FROM reports GROUP BY ALL""",
)
def clock_encodings(spark, path):
    ts = F.col("valid_ts")
    parts = clock.cyclic(ts)
    return (
        V.reports(spark, path)
        .groupBy(
            F.hour(ts).alias("hour"),
            F.month(ts).alias("month"),
            F.year(ts).alias("year"),
            F.round(parts["hour_sin"], 9).alias("hour_sin"),
            F.round(parts["month_cos"], 9).alias("month_cos"),
            clock.season(ts).alias("season"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(
    "order_seasons",
    """SELECT year(o_orderdate) AS year, CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'pre_monsoon' WHEN month(o_orderdate) BETWEEN 6 AND 9
      THEN 'monsoon' WHEN month(o_orderdate) >= 10 THEN 'post_monsoon' ELSE 'winter' END AS season, count(*) AS n FROM orders GROUP BY ALL""",
)
def order_seasons(spark, path):
    day = F.col("o_orderdate").cast("timestamp")
    return V.table(spark, path, "orders").groupBy(F.year(day).alias("year"), clock.season(day).alias("season")).agg(F.count("*").alias("n"))


@query(
    "wind_encodings",
    """SELECT station_id, timestamp_utc, round(sin(radians(wind_direction_10m)), 9) AS s, round(cos(radians(wind_direction_10m)), 9) AS c,
      round(-wind_speed_10m * sin(radians(wind_direction_10m)), 9) AS u, round(-wind_speed_10m * cos(radians(wind_direction_10m)), 9) AS v,
      wind_direction_10m AS back FROM atmos""",
)
def wind_encodings(spark, path):
    sine, cosine = wind.direction_parts(F.col("wind_direction_10m"))
    u, v = wind.uv(F.col("wind_speed_10m"), F.col("wind_direction_10m"))
    back = F.round(wind.direction_from_parts(sine, cosine), 6)
    return V.atmos(spark, path).select(
        *KEY,
        F.round(sine, 9).alias("s"),
        F.round(cosine, 9).alias("c"),
        F.round(u, 9).alias("u"),
        F.round(v, 9).alias("v"),
        F.when(back == 360.0, 0.0).otherwise(back).alias("back"),
    )


_PROBED = [n for n in X.FEATURES if n not in X.LOCATION]
_AT = f"CAST(epoch(timestamp_utc) AS BIGINT) // 3600 % {PROBE_EVERY} = 0"
_PROBE_CHECK = f"""SELECT unnest([{', '.join(f"'{n}'" for n in _PROBED)}]) AS "column", (SELECT count(*) FROM atmos WHERE {_AT}) AS compared, 0::BIGINT AS mismatches, 0.0::DOUBLE AS max_abs_difference"""


def _probe(spark, path, change, build=X.station_features, columns=_PROBED, back=X.HISTORY_HOURS):
    hours = hours_of(spark, path)
    hour = F.expr(f"unix_seconds(timestamp_utc) DIV 3600 % {PROBE_EVERY} = 0")
    out = Q.probe(hours, build, columns, change, V.spine(spark, path).filter(hour), back)
    return out.withColumn("max_abs_difference", F.round("max_abs_difference", 6))


@query("truncation_probe", _PROBE_CHECK)
def truncation_probe(spark, path):
    """Features rebuilt from rows up to T equal the shipped row at T, at every seventh hour."""
    return _probe(spark, path, Q.truncated(), back=2 * X.HISTORY_HOURS)


@query("future_perturbation_probe", _PROBE_CHECK)
def future_perturbation_probe(spark, path):
    """Changed values after T leave the row at T as it is, at every seventh hour."""
    return _probe(spark, path, Q.perturbed(V.ATMOSPHERE))


@query("history_length_probe", _PROBE_CHECK)
def history_length_probe(spark, path):
    """The last 25 hours are all that the row at T needs, at every seventh hour."""
    return _probe(spark, path, Q.recent_only(X.HISTORY_HOURS), back=2 * X.HISTORY_HOURS)


def leaky(hours):
    """Features with two planted faults: the next hour's humidity, and a mean over 31 hours."""
    series = S.Chunked(hours, ["station_id"], "timestamp_utc", back=30, ahead=1)
    humidity = F.col("relative_humidity_2m")
    return series.select(
        *hours.columns,
        series.at(humidity, 1).alias("leaked_humidity"),
        series.full_sum(humidity, -30, 0).alias("long_humidity_sum"),
        series.at(humidity, -1).alias("honest_humidity"),
    )


_PLANTED = f"""SELECT "column", count(*) AS compared, count(*) FILTER (broken) AS mismatches FROM (
  SELECT unnest([{{'column': 'leaked_humidity', 'broken': ahead IS NOT NULL}}, {{'column': 'long_humidity_sum', 'broken': k = 31}}, {{'column': 'honest_humidity', 'broken': false}}], recursive := true)
  FROM (SELECT timestamp_utc, lead(relative_humidity_2m) OVER w AS ahead, count(relative_humidity_2m) OVER (w ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS k FROM atmos WINDOW w AS (PARTITION BY station_id ORDER BY timestamp_utc)) WHERE {_AT}) GROUP BY ALL"""


@query("planted_leak_probe", _PLANTED)
def planted_leak_probe(spark, path):
    """The probe of history and future names each planted fault and counts the rows that it breaks."""
    out = _probe(spark, path, Q.recent_only(X.HISTORY_HOURS), leaky, ["leaked_humidity", "long_humidity_sum", "honest_humidity"], 40)
    return out.select("column", "compared", "mismatches")


@query(
    "feature_target_correlation",
    f"""SELECT variable, count(*) AS n, round(coalesce(corr(value, target), 0), 6) AS r FROM (UNPIVOT (SELECT a.*, l.target FROM atmos a
      JOIN labels l USING (station_id, timestamp_utc)) ON {', '.join(V.ATMOSPHERE)} INTO NAME variable VALUE value)
      WHERE target IS NOT NULL GROUP BY variable""",
)
def feature_target_correlation(spark, path):
    joined = V.atmos(spark, path).join(labels_of(spark, path).select(*KEY, "target"), KEY)
    return correlations(joined, V.ATMOSPHERE, "target").withColumn("r", F.round("r", 6))
