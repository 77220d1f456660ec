"""Queries that run as Structured Streaming jobs over a feed in several micro-batches, then give the table they wrote."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tempora.catalog import feed as D
from tempora.catalog.features import _SQL, hours_of, rounded
from tempora.catalog.labels import labels_of
from tempora.catalog.registry import query
from tempora.operators import features as X
from tempora.operators import labels as L
from tempora.operators import status as U
from tempora.session import scratch_path
from tempora.sources import views as V
from tempora.streaming import live as S
from tempora.streaming import state as K

KEY = ["station_id", "timestamp_utc"]
NOW = datetime(2024, 1, 29, 12)
FEED_PARTS = 4


def hours_between(spark, path):
    """First and last hour of the calendar, as values; those of the test tables where there are no events."""
    ends = spark.range(1).select(*[h(spark, path).cast("string") for h in (V.first_hour, V.last_hour)]).first()
    return tuple(x and datetime.fromisoformat(x) or d for x, d in zip(ends, (V.WINDOW_START, V.WINDOW_END), strict=True))


def feed(spark, path, table, name, plan, parts=FEED_PARTS, **options):
    return D.run_feed(table, name, parts, *hours_between(spark, path), plan, **options)


def delayed(table, ts, hours):
    """When each row arrives: its time, or for every fifth hour that many hours later."""
    late = F.expr(f"unix_seconds({ts}) div 3600 % 5 = 0")
    return table.withColumn("arrival", F.when(late, F.col(ts) + F.make_interval(hours=F.lit(hours))).otherwise(F.col(ts)))


def flagged(spark, path):
    return L.with_flags(V.reports(spark, path))


@query(
    "stream_hourly_counts",
    """SELECT station_id, date_trunc('hour', valid_ts) AS timestamp_utc, count(*) AS n_reports, count(*) FILTER (decodable) AS n_reports_with_wx,
      count(*) FILTER (ts_station OR ts_vicinity) AS n_ts_reports FROM flags GROUP BY ALL""",
)
def stream_hourly_counts(spark, path):
    written = feed(spark, path, flagged(spark, path), "hourly-counts", lambda r: S.hourly_counts(r, "valid_ts", "2 hours"), mode="update", ts="valid_ts")
    return S.latest_per_key(written, KEY)


@query("stream_deduplicated", "SELECT station_id, count(*) AS n_minutes FROM kept GROUP BY station_id")
def stream_deduplicated(spark, path):
    """One report per station and minute, whichever comes first."""
    plan = lambda r: S.first_seen(r, ["station_id", "valid_minute"], "valid_minute", "2 hours")
    unique = feed(spark, path, flagged(spark, path), "deduplicated", plan, ts="valid_ts")
    return unique.groupBy("station_id").agg(F.count("*").alias("n_minutes"))


@query(
    "stream_trailing_totals",
    """SELECT station_id, timestamp_utc, round(total, 6) AS total, round(mean, 6) AS mean FROM (SELECT station_id, timestamp_utc, CASE WHEN count(precipitation) OVER w = 6 THEN sum(precipitation) OVER w END AS total,
      CASE WHEN count(precipitation) OVER w = 6 THEN avg(precipitation) OVER w END AS mean FROM atmos
      WINDOW w AS (PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE timestamp_utc <= TIMESTAMP '2024-01-30 20:00:00'""",
)
def stream_trailing_totals(spark, path):
    """Six-hour sums; windows that end after the watermark are still open and do not come out."""
    written = feed(spark, path, V.atmos(spark, path), "trailing", lambda h: S.trailing_totals(h, "precipitation", 6, "2 hours"))
    first, last = hours_between(spark, path)
    # a window closes an hour after its own and the watermark's two
    closed = F.col("timestamp_utc").between(F.lit(first), F.lit(last - timedelta(hours=3)))
    return rounded(written.filter(closed), ["total", "mean"], keep=KEY)


@query(
    "stream_episodes",
    """SELECT station_id, event_start, event_end, n_hours FROM episodes WHERE event_end + INTERVAL 2 HOUR <= (SELECT max(timestamp_utc) FROM labels WHERE target = 1) - INTERVAL 3 HOUR""",
)
def stream_episodes(spark, path):
    positive = labels_of(spark, path).filter(F.col("target") == 1).select(*KEY)
    return feed(spark, path, positive, "episodes", lambda h: S.episode_sessions(h, 2, "3 hours")).drop("batch_id")


@query(
    "stream_history_ring",
    """SELECT station_id, timestamp_utc, n25 AS history_rows, n25 = 25 AS ready, CASE WHEN n24 = 24 THEN round(s24, 6) END AS sum_24h, round(lag24, 6) AS lag_24h FROM
      (SELECT station_id, timestamp_utc, precipitation, count(precipitation) OVER a AS n25, count(precipitation) OVER b AS n24, sum(precipitation) OVER b AS s24,
         lag(precipitation, 24) OVER (PARTITION BY station_id ORDER BY timestamp_utc) AS lag24 FROM atmos
       WINDOW a AS (PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), b AS (PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
      WHERE precipitation IS NOT NULL""",
)
def stream_history_ring(spark, path):
    """Eight deliveries, a fifth of the hours up to four days late; the last result of every hour is the one of a batch run."""
    hours = delayed(V.atmos(spark, path).select(*KEY, "precipitation"), "timestamp_utc", 96)
    plan = lambda h: K.history(h, "precipitation", late=240)
    written = S.latest_per_key(feed(spark, path, hours, "ring", plan, parts=8, mode="update", ts="arrival"), KEY)
    return rounded(written, ["sum_24h", "lag_24h"], keep=[*KEY, "history_rows", "ready"])


_STREAMED = ["temperature_2m", "precipitation_lag_3h", "humidity_change_1h", "precipitation_roll_sum_6h", "pressure_roll_mean_3h", "wind_u_10m", "hour_sin"]


@query(
    "stream_features",
    f"SELECT station_id, timestamp_utc, {', '.join(f'round({_SQL[n]}, 6) AS {n}' for n in _STREAMED)} FROM (SELECT * FROM atmos JOIN stations USING (station_id))",
)
def stream_features(spark, path):
    """The batch feature function on micro-batches with 24 hours of look-back."""
    hours = hours_of(spark, path)
    store = S.HourStore(spark, hours.schema, "feature-hours")
    each = S.feature_step(store, X.station_features, X.HISTORY_HOURS)
    written = feed(spark, path, hours, "features", lambda h: h, each=each)
    return rounded(written, _STREAMED, keep=KEY)


_LIVE = """SELECT s.station_id, o.observed, round(date_diff('second', o.observed, TIMESTAMP '2024-01-29 12:00:00') / 60, 3) AS data_age_minutes,
  CASE WHEN o.observed IS NULL THEN 'no_complete_hour' WHEN date_diff('second', o.observed, TIMESTAMP '2024-01-29 12:00:00') > 180 * 60 THEN 'stale_observation' WHEN
    (SELECT count(*) FROM nwp n WHERE n.station_id = s.station_id AND n.timestamp_utc > o.observed AND n.timestamp_utc <= o.observed + INTERVAL 3 HOUR) < 3 THEN 'forecast_horizon_unavailable' END AS reason
  FROM stations s LEFT JOIN (SELECT station_id, max(timestamp_utc) AS observed FROM atmos WHERE temperature_2m IS NOT NULL AND timestamp_utc <= TIMESTAMP '2024-01-29 12:00:00' GROUP BY ALL) o USING (station_id)"""


def live_of(spark, path):
    """Status after the last micro-batch of the feed; the forecast table is the static side."""
    hours, model = V.atmos(spark, path), V.nwp(spark, path)
    store = S.LatestStore(spark, "live-newest", "station_id")

    def each(batch, batch_id):
        newest = store.add(S.newest_complete(batch, ["temperature_2m"], F.lit(NOW)), batch_id)
        return S.judge_newest(newest, model, F.lit(NOW))

    return S.latest_per_key(feed(spark, path, hours, "live", lambda h: h, each=each), ["station_id"])


@query(
    "stream_live_status",
    f"SELECT *, CASE WHEN reason IS NULL THEN 'LIVE' ELSE 'UNAVAILABLE' END AS status FROM ({_LIVE})",
)
def stream_live_status(spark, path):
    return live_of(spark, path).withColumn("data_age_minutes", F.round("data_age_minutes", 3))


@query(
    "stream_batch_status",
    f"""SELECT n_stations, n_live, CASE WHEN n_live = n_stations THEN 'LIVE' WHEN n_live > 0 THEN 'LIVE_PARTIAL' ELSE 'UNAVAILABLE' END AS batch_status FROM
      (SELECT count(*) AS n_stations, count(*) FILTER (reason IS NULL) AS n_live FROM ({_LIVE}))""",
)
def stream_batch_status(spark, path):
    return U.batch_status(live_of(spark, path))


_SPOKEN = """spoken AS (SELECT DISTINCT station_id, valid_ts FROM flags WHERE decodable),
  passed AS (SELECT date_trunc('milliseconds', max(valid_ts)) - INTERVAL 1 HOUR AS w FROM spoken),
  around AS (SELECT station_id, valid_ts, lag(valid_ts) OVER s AS before, lead(valid_ts) OVER s AS after FROM spoken WINDOW s AS (PARTITION BY station_id ORDER BY valid_ts))"""


@query(
    "stream_silence",
    f"""WITH {_SPOKEN} SELECT station_id, valid_ts AS since, 'LIVE' AS status FROM around, passed
      WHERE valid_ts <= w AND (before IS NULL OR valid_ts - before > INTERVAL 180 MINUTE)
    UNION ALL SELECT station_id, valid_ts + INTERVAL 180 MINUTE, 'UNAVAILABLE' FROM around, passed
      WHERE (after IS NULL OR after - valid_ts > INTERVAL 180 MINUTE) AND valid_ts + INTERVAL 180 MINUTE < w""",
)
def stream_silence(spark, path):
    """Stations that give no decodable report for 180 minutes, told by timers; changes up to the last watermark."""
    said = flagged(spark, path).filter("decodable").select("station_id", "valid_ts")
    return feed(spark, path, said, "silence", lambda r: K.silences(r, "valid_ts", "1 hour"), ts="valid_ts").drop("batch_id")


@query(
    "stream_forecast_cover",
    """SELECT h.station_id, h.timestamp_utc, count(n.timestamp_utc) AS covered, min(n.timestamp_utc) AS first_valid, max(n.timestamp_utc) AS last_valid
      FROM (SELECT station_id, timestamp_utc FROM atmos WHERE temperature_2m IS NOT NULL) h LEFT JOIN nwp n
      ON n.station_id = h.station_id AND n.timestamp_utc > h.timestamp_utc AND n.timestamp_utc <= h.timestamp_utc + INTERVAL 3 HOUR GROUP BY ALL""",
)
def stream_forecast_cover(spark, path):
    """Observed hours joined with the forecasts of the next three hours as two feeds; a fifth of the forecasts come six days late."""
    hours = V.atmos(spark, path).filter("temperature_2m is not null").select(*KEY)
    model = delayed(V.nwp(spark, path).select(*KEY), "timestamp_utc", 144)
    ends = hours_between(spark, path)
    sides = []
    for table, name, ts in ((hours, "cover-hours", "timestamp_utc"), (model, "cover-model", "arrival")):
        source = D.deliver(table, name, D.ranges(6, *ends, ts))
        sides.append(S.read_files(spark, source, table.schema, files=1))
    pairs = S.run_to_table(K.forecast_pairs(*sides, 3, "15 days"), "cover")
    found = pairs.groupBy(*KEY).agg(F.count("*").alias("covered"), F.min("valid").alias("first_valid"), F.max("valid").alias("last_valid"))
    joined = hours.join(found, KEY, "left")
    return joined.select(*KEY, F.coalesce("covered", F.lit(0)).alias("covered"), "first_valid", "last_valid")


BACKFILL_PARTS, BACKFILL_DELAY = 5, "2 HOURS"


def backfilled(spark, path):
    """The hourly table and the counts of every micro-batch when a fifth of the reports come three days late."""
    reports = delayed(flagged(spark, path), "valid_ts", 72)
    archive, table, metrics = (scratch_path(spark, f"backfill-{x}") for x in ("archive", "table", "metrics"))
    each = S.hourly_backfill(lambda r: L.hourly_counts(L.first_reports(r)), archive, table, metrics, BACKFILL_DELAY)
    done = feed(spark, path, reports, "backfill", lambda r: r, parts=BACKFILL_PARTS, each=each, ts="arrival")
    return spark.read.parquet(table).drop("station", "day"), done


@query("stream_backfill", "SELECT station_id, timestamp_utc, n_reports, n_reports_with_wx, n_ts_reports FROM hour_counts")
def stream_backfill(spark, path):
    """Late reports rewrite the station's days that they touch; the table equals a run over all reports at once."""
    return backfilled(spark, path)[0].select(*KEY, "n_reports", "n_reports_with_wx", "n_ts_reports")


@query(
    "stream_late_rows",
    f"""WITH ends AS (SELECT epoch_us(date_trunc('hour', min(ts))) AS f, epoch_us(date_trunc('hour', max(ts))) AS l FROM ev),
      arrived AS (SELECT *, epoch_us(valid_ts) + CASE WHEN epoch_us(valid_ts) // 3600000000 % 5 = 0 THEN 72 * 3600000000 ELSE 0 END AS arrival FROM flags),
      dealt AS (SELECT station_id, valid_ts, least({BACKFILL_PARTS - 1}, greatest(0, (arrival - f) * {BACKFILL_PARTS} // (l - f))) AS batch_no FROM arrived, ends),
      newest AS (SELECT batch_no, max(max(valid_ts)) OVER (ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM dealt GROUP BY batch_no)
    SELECT batch_no, count(*) AS n_rows, count(*) FILTER (valid_ts < before - INTERVAL {BACKFILL_DELAY}) AS n_late,
      count(DISTINCT (station_id, valid_ts::DATE)) AS n_parts FROM dealt JOIN newest USING (batch_no) GROUP BY batch_no""",
)
def stream_late_rows(spark, path):
    """Rows, late rows and touched parts of every micro-batch, as observed while it was written."""
    return backfilled(spark, path)[1].select("batch_no", "n_rows", "n_late", "n_parts")
