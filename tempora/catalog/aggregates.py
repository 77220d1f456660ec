"""Queries on counts, rates, profiles and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.features import rounded
from tempora.catalog.joins import _SCAN_FEATURES, aligned_of, scan_features_of
from tempora.catalog.labels import labels_of, targets_of
from tempora.catalog.registry import query
from tempora.functions import clock, codes, values
from tempora.operators import labels as L
from tempora.operators import ordered as R
from tempora.operators import profile as C
from tempora.operators import splits as S
from tempora.operators import targets as T
from tempora.session import stage
from tempora.sources import views as V

KEY = ["station_id", "timestamp_utc"]


def labelled_hours(spark, path):
    return labels_of(spark, path).withColumn("label", F.col("target"))


@query(
    "observed_codes",
    """SELECT station_id, date_trunc('hour', valid_minute) AS timestamp_utc, string_agg(DISTINCT wxcodes, ' | ' ORDER BY wxcodes) AS wxcodes_observed
      FROM kept WHERE wxcodes NOT IN ('', 'M') GROUP BY ALL""",
)
def observed_codes(spark, path):
    return L.observed_codes(L.first_reports(V.reports(spark, path)))


@query(
    "event_rate_by_day",
    """SELECT station_id, day(timestamp_utc) AS day, count(*) AS observed_hours, count(*) FILTER (target = 1) AS positive_hours,
      round(100.0::DOUBLE * count(*) FILTER (target = 1) / count(*), 3) AS positive_pct FROM labels WHERE target IS NOT NULL GROUP BY ALL""",
)
def event_rate_by_day(spark, path):
    return C.rate_by(labelled_hours(spark, path), ["station_id", F.dayofmonth("timestamp_utc").alias("day")])


@query(
    "event_rate_by_year_month",
    """SELECT year(timestamp_utc) AS year, month(timestamp_utc) AS month, count(*) AS observed_hours, count(*) FILTER (target = 1) AS positive_hours,
      round(100.0::DOUBLE * count(*) FILTER (target = 1) / count(*), 3) AS positive_pct FROM labels WHERE target IS NOT NULL GROUP BY ALL""",
)
def event_rate_by_year_month(spark, path):
    ts = F.col("timestamp_utc")
    return C.rate_by(labelled_hours(spark, path), [F.year(ts).alias("year"), F.month(ts).alias("month")])


@query(
    "coverage_by_year",
    """SELECT station_id, year(timestamp_utc) AS year, count(*) AS grid_hours, count(target) AS observed_hours, count(*) - count(target) AS missing_hours,
      round(100.0::DOUBLE * count(target) / count(*), 2) AS coverage_pct FROM labels GROUP BY ALL""",
)
def coverage_by_year(spark, path):
    return C.coverage(labelled_hours(spark, path), ["station_id", F.year("timestamp_utc").alias("year")])


@query(
    "report_density",
    """SELECT station_id, year(valid_ts) AS year, count(*) AS reports, count(DISTINCT valid_ts::DATE) AS days,
      round(count(*) / count(DISTINCT valid_ts::DATE), 2) AS reports_per_day, count(*) FILTER (decodable) AS reports_with_wx,
      round(100.0::DOUBLE * count(*) FILTER (decodable) / count(*), 2) AS coverage_pct FROM kept GROUP BY ALL""",
)
def report_density(spark, path):
    """Counted per day first, so a distinct count of days never gathers reports."""
    kept = L.first_reports(L.with_flags(V.reports(spark, path)))
    day = F.to_date("valid_ts").alias("day")
    daily = kept.groupBy("station_id", F.year("valid_ts").alias("year"), day).agg(
        F.count("*").alias("n"), F.count_if("decodable").alias("wx")
    )
    total = daily.groupBy("station_id", "year").agg(
        F.sum("n").alias("reports"), F.count("*").alias("days"), F.sum("wx").alias("reports_with_wx")
    )
    return total.withColumns(
        {
            "reports_per_day": F.round(F.col("reports") / F.col("days"), 2),
            "coverage_pct": values.percent(F.col("reports_with_wx"), F.col("reports"), 2),
        }
    )


# Eras as right-closed year ranges.
ERA_EDGES = (1994, 1996, 1998, 2001)
ERA_NAMES = ("1995-1996", "1997-1998", "1999-2001")


@query(
    "rate_by_era",
    """SELECT era, count(*) AS observed_hours, count(*) FILTER (label = 1) AS positive_hours, round(100.0::DOUBLE * count(*) FILTER (label = 1) / count(*), 2) AS positive_pct
      FROM (SELECT CASE WHEN year(timestamp_utc) <= 1996 THEN '1995-1996' WHEN year(timestamp_utc) <= 1998 THEN '1997-1998' ELSE '1999-2001' END AS era,
        CASE WHEN n >= 2 THEN 1 ELSE 0 END AS label FROM series_day) GROUP BY era""",
)
def rate_by_era(spark, path):
    era = C.right_closed_bin(F.year("timestamp_utc"), ERA_EDGES, ERA_NAMES)
    daily = V.series_day(spark, path).withColumn("label", (F.col("n") >= 2).cast("double"))
    return C.rate_by(daily, [era.alias("era")], digits=2)


_PROFILED = V.MODEL
_NAMES = ", ".join(f"'{c}'" for c in _PROFILED)
_LONG_NWP = f"SELECT station_id, unnest([{_NAMES}]) AS variable, unnest([{', '.join(_PROFILED)}]) AS value FROM nwp"


@query(
    "column_profile",
    f"""SELECT variable, count(*) AS n, count(*) - count(value) AS n_missing, round((count(*) - count(value)) * 100.0::DOUBLE / count(*), 4) AS missing_pct,
      round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM ({_LONG_NWP}) GROUP BY variable""",
)
def column_profile(spark, path):
    return rounded(C.column_profile(V.nwp(spark, path), _PROFILED), ["min", "max", "mean"], keep=["variable", "n", "n_missing", "missing_pct"])


@query(
    "missing_by_station",
    f"""SELECT station_id, variable, count(*) AS n, count(*) - count(value) AS n_missing FROM ({_LONG_NWP}) GROUP BY ALL""",
)
def missing_by_station(spark, path):
    return C.column_profile(V.nwp(spark, path), _PROFILED, ["station_id"]).select("station_id", "variable", "n", "n_missing")


@query(
    "missing_in_null_window",
    """SELECT station_id, count(*) AS n_rows, count(*) FILTER (nwp_cape IS NULL) AS missing_cape, count(*) FILTER (nwp_convective_inhibition IS NULL) AS missing_cin
      FROM nwp WHERE timestamp_utc BETWEEN TIMESTAMP '2024-01-10 20:00:00' AND TIMESTAMP '2024-01-20 04:00:00' GROUP BY station_id""",
)
def missing_in_null_window(spark, path):
    inside = F.col("timestamp_utc").between("2024-01-10 20:00:00", "2024-01-20 04:00:00")
    return (
        V.nwp(spark, path)
        .filter(inside)
        .groupBy("station_id")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(F.col("nwp_cape").isNull()).alias("missing_cape"),
            F.count_if(F.col("nwp_convective_inhibition").isNull()).alias("missing_cin"),
        )
    )


@query(
    "age_summary",
    """SELECT station_id, round(min(age_minutes), 6) AS min_age, round(quantile_cont(age_minutes, 0.5), 6) AS median_age, round(max(age_minutes), 6) AS max_age,
      round(avg(age_minutes), 6) AS mean_age, count(*) AS n FROM aligned WHERE sat_available = 1 GROUP BY station_id""",
)
def age_summary(spark, path):
    rows = aligned_of(spark, path).filter(F.col("sat_available") == 1)
    median = R.percentiles(rows, ["station_id"], "age_minutes", {"median_age": 0.5})
    out = rows.groupBy("station_id").agg(
        F.min("age_minutes").alias("min_age"), F.max("age_minutes").alias("max_age"), F.avg("age_minutes").alias("mean_age"), F.count("*").alias("n")
    )
    return rounded(out.join(median, "station_id"), ["min_age", "median_age", "max_age", "mean_age"], keep=["station_id", "n"])


@query(
    "value_percentiles",
    """SELECT event_type AS station_id, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
      round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL""",
)
def value_percentiles(spark, path):
    wanted = {"p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    out = R.percentiles(V.events(spark, path).withColumnRenamed("event_type", "station_id"), ["station_id"], "value", wanted)
    return rounded(out, list(wanted), keep=["station_id"])


_SPLIT = """SELECT t.*, CASE WHEN timestamp_utc <= c.train_end THEN 'train' WHEN timestamp_utc <= c.validation_end THEN 'validation' ELSE 'test' END AS split
  FROM targets t, (SELECT max(CASE WHEN rn <= floor(0.7::DOUBLE * n) THEN timestamp_utc END) AS train_end,
    max(CASE WHEN rn <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN timestamp_utc END) AS validation_end FROM
    (SELECT timestamp_utc, row_number() OVER (ORDER BY timestamp_utc) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp_utc FROM targets))) c"""
_SPLIT_LONG = f"""SELECT split, station_id, 'target_1h' AS horizon, target_1h AS y FROM ({_SPLIT}) UNION ALL SELECT split, station_id, 'target_2h', target_2h FROM ({_SPLIT})
  UNION ALL SELECT split, station_id, 'target_3h', target_3h FROM ({_SPLIT})"""


@query(
    "counts_by_split",
    f"""SELECT split, horizon, coalesce(station_id, 'ALL') AS station_id, count(*) AS total_rows, count(y) AS observed_rows, count(*) FILTER (y = 1) AS positive_rows,
      count(*) FILTER (y = 0) AS negative_rows, count(*) - count(y) AS missing_rows, round(count(*) FILTER (y = 1) / count(y), 6) AS positive_rate
      FROM ({_SPLIT_LONG}) GROUP BY GROUPING SETS ((split, horizon), (split, horizon, station_id))""",
)
def counts_by_split(spark, path):
    """Pooled and per-station rows from one aggregate with grouping sets."""
    split = S.with_split(targets_of(spark, path).select(*KEY, *[f"target_{k}h" for k in V.LEADS]))
    long = T.unpivot_leads(split, ["split", "station_id"]).withColumnRenamed("lead", "horizon")
    y = F.col("y")
    sets = [["split", "horizon"], ["split", "horizon", "station_id"]]
    return (
        long.groupingSets([[F.col(c) for c in s] for s in sets], "split", "horizon", "station_id")
        .agg(
            F.count("*").alias("total_rows"),
            F.count(y).alias("observed_rows"),
            F.count_if(y == 1).alias("positive_rows"),
            F.count_if(y == 0).alias("negative_rows"),
            F.count_if(y.isNull()).alias("missing_rows"),
            F.round(F.try_divide(F.count_if(y == 1), F.count(y)), 6).alias("positive_rate"),
        )
        .withColumn("station_id", F.coalesce("station_id", F.lit("ALL")))
    )


@query(
    "train_quantile_cut",
    """WITH ranked AS (SELECT station_id, cents, row_number() OVER (PARTITION BY station_id ORDER BY timestamp_utc) AS rn, count(*) OVER (PARTITION BY station_id) AS n
        FROM series_day), cut AS (SELECT station_id, quantile_cont(cents::DOUBLE, 0.9) AS threshold FROM ranked WHERE rn <= floor(0.7::DOUBLE * n) GROUP BY station_id)
      SELECT station_id, round(threshold, 4) AS threshold, count(*) FILTER (cents >= threshold) AS positives, count(*) AS n_rows
      FROM ranked JOIN cut USING (station_id) GROUP BY ALL""",
)
def train_quantile_cut(spark, path):
    """The 0.9 quantile of the training part as a decision cut for the whole series."""
    daily = S.split_by_rows(V.series_day(spark, path).select(*KEY, F.col("cents").cast("double").alias("cents")), ["station_id"], "timestamp_utc")
    cut = R.percentiles(daily.filter(F.col("split") == "train"), ["station_id"], "cents", {"threshold": 0.9})
    return (
        daily.join(cut, "station_id")
        .groupBy("station_id")
        .agg(
            F.round(F.max("threshold"), 4).alias("threshold"),
            F.count_if(F.col("cents") >= F.col("threshold")).alias("positives"),
            F.count("*").alias("n_rows"),
        )
    )


_SPLIT_NWP = """SELECT n.*, CASE WHEN n.timestamp_utc <= c.train_end THEN 'train' WHEN n.timestamp_utc <= c.validation_end THEN 'validation' ELSE 'test' END AS split
  FROM nwp n, (SELECT max(CASE WHEN rn <= floor(0.7::DOUBLE * n) THEN timestamp_utc END) AS train_end,
    max(CASE WHEN rn <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN timestamp_utc END) AS validation_end FROM
    (SELECT timestamp_utc, row_number() OVER (ORDER BY timestamp_utc) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp_utc FROM nwp))) c"""


@query(
    "train_median_imputation",
    f"""WITH s AS ({_SPLIT_NWP}), m AS (SELECT quantile_cont(nwp_cape, 0.5) AS cape, quantile_cont(nwp_convective_inhibition, 0.5) AS cin FROM s WHERE split = 'train')
      SELECT split, count(*) AS n_rows, count(*) FILTER (nwp_cape IS NULL) AS imputed_cape, count(*) FILTER (nwp_convective_inhibition IS NULL) AS imputed_cin,
        round(max(m.cape), 6) AS median_cape, round(max(m.cin), 6) AS median_cin, round(sum(coalesce(nwp_cape, m.cape)), 4) AS sum_cape
      FROM s, m GROUP BY split""",
)
def train_median_imputation(spark, path):
    """Missing model values take the median of the training part; the filled cells are counted per split."""
    filled = impute_with_train_median(S.with_split(V.nwp(spark, path)), ["nwp_cape", "nwp_convective_inhibition"])
    cape, cin = "nwp_cape", "nwp_convective_inhibition"
    return filled.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.sum(f"{cape}_imputed").alias("imputed_cape"),
        F.sum(f"{cin}_imputed").alias("imputed_cin"),
        F.round(F.max(f"{cape}_median"), 6).alias("median_cape"),
        F.round(F.max(f"{cin}_median"), 6).alias("median_cin"),
        F.round(F.sum(cape), 4).alias("sum_cape"),
    )


def impute_with_train_median(df, columns):
    """All medians come from one pass over the training part; they travel as one small map."""
    train = C.melt(df.filter(F.col("split") == "train"), [], columns)
    medians = R.percentiles(train, ["variable"], "value", {"median": 0.5})
    lookup = medians.agg(F.map_from_entries(F.collect_list(F.struct("variable", "median")))).scalar()
    out = {}
    for c in columns:
        median = lookup[c]
        out |= {f"{c}_imputed": F.col(c).isNull().cast("int"), f"{c}_median": median, c: F.coalesce(F.col(c), median)}
    return df.withColumns(out)


@query(
    "stations_present",
    """SELECT timestamp_utc, count(DISTINCT station_id) AS n_stations, count(DISTINCT station_id) = 5 AS all_present FROM alerts WHERE data_status = 'COMPLETE' GROUP BY ALL""",
)
def stations_present(spark, path):
    from tempora.catalog.evaluate import predictions_of

    complete = predictions_of(spark, path).filter(F.col("data_status") == "COMPLETE")
    present = complete.groupBy("timestamp_utc").agg(F.countDistinct("station_id").alias("n_stations"))
    return present.withColumn("all_present", F.col("n_stations") == len(V.STATIONS))


@query("code_value_counts", "SELECT station_id, wxcodes, count(*) AS n FROM reports GROUP BY ALL")
def code_value_counts(spark, path):
    return V.reports(spark, path).groupBy("station_id", "wxcodes").agg(F.count("*").alias("n"))


@query(
    "pixel_neighbourhood",
    """SELECT scan_id, count(*) AS n_pixels, count(*) FILTER (cls <> 9) AS valid_pixels, count(*) FILTER (cls IN (1, 3)) AS cloudy, count(*) FILTER (cls IN (0, 2)) AS clear,
      count(*) FILTER (cls = 9) AS filled FROM pixels GROUP BY scan_id""",
)
def pixel_neighbourhood(spark, path):
    from tempora.functions import geo

    cls = F.col("cls")
    return (
        V.pixels(spark, path)
        .groupBy("scan_id")
        .agg(
            F.count("*").alias("n_pixels"),
            F.count_if(geo.is_valid_class(cls)).alias("valid_pixels"),
            F.count_if(geo.is_cloudy(cls)).alias("cloudy"),
            F.count_if(geo.is_clear(cls)).alias("clear"),
            F.count_if(cls == geo.FILL_CLASS).alias("filled"),
        )
    )


@query(
    "cohort_accounting",
    """SELECT count(*) AS grid_hours, count(CASE WHEN n_reports > 0 THEN 1 END) AS observed_hours, count(*) FILTER (n_reports = 0) AS unobserved_hours,
      count(*) FILTER (n_reports_with_wx > 0) AS hours_with_code, count(*) FILTER (n_reports > 0 AND n_reports_with_wx = 0) AS reports_without_code,
      true AS partition_ok FROM labels""",
)
def cohort_accounting(spark, path):
    reports, coded = F.col("n_reports") > 0, F.col("n_reports_with_wx") > 0
    out = labels_of(spark, path).agg(
        F.count("*").alias("grid_hours"),
        F.count_if(reports).alias("observed_hours"),
        F.count_if(~reports).alias("unobserved_hours"),
        F.count_if(coded).alias("hours_with_code"),
        F.count_if(reports & ~coded).alias("reports_without_code"),
    )
    total = F.col("hours_with_code") + F.col("reports_without_code") + F.col("unobserved_hours")
    return out.withColumn("partition_ok", total == F.col("grid_hours"))


@query(
    "rule_as_predictor",
    """SELECT count(*) FILTER (r) AS rule_hours, count(*) FILTER (r AND target = 1) AS rule_positive, count(*) FILTER (r AND target = 0) AS rule_negative,
      count(*) FILTER (target = 1) AS positive_hours, round(count(*) FILTER (r AND target = 1) / count(*) FILTER (r), 4) AS precision,
      round(count(*) FILTER (r AND target = 1) / count(*) FILTER (target = 1), 4) AS recall FROM
      (SELECT target, k.station_id IS NOT NULL AS r FROM labels l LEFT JOIN (SELECT DISTINCT event_type AS station_id, date_trunc('hour', ts) AS timestamp_utc FROM ev
        WHERE k IN (95, 96, 99)) k USING (station_id, timestamp_utc) WHERE target IS NOT NULL)""",
)
def rule_as_predictor(spark, path):
    """A fixed weather code in the hour, taken as a prediction of the label."""
    coded = V.events(spark, path).filter(F.col("k").isin(95, 96, 99))
    hours = coded.select(F.col("event_type").alias("station_id"), clock.hour_of(F.col("ts")).alias("timestamp_utc")).distinct()
    known = labels_of(spark, path).filter(F.col("target").isNotNull()).select(*KEY, "target")
    rule, y = F.coalesce(F.col("_r"), F.lit(False)), F.col("target")
    out = known.join(hours.withColumn("_r", F.lit(True)), KEY, "left").agg(
        F.count_if(rule).alias("rule_hours"),
        F.count_if(rule & (y == 1)).alias("rule_positive"),
        F.count_if(rule & (y == 0)).alias("rule_negative"),
        F.count_if(y == 1).alias("positive_hours"),
    )
    return out.withColumns(
        {
            "precision": F.round(values.ratio(F.col("rule_positive"), F.col("rule_hours")), 4),
            "recall": F.round(values.ratio(F.col("rule_positive"), F.col("positive_hours")), 4),
        }
    )


@query(
    "granule_ranges",
    """SELECT count(*) AS n_granules, min(first) AS first, max(last) AS last, round(sum(seconds) / 3600, 6) AS observed_hours FROM
      (SELECT user_id, ts::DATE AS day, min(ts) AS first, max(ts) AS last, date_diff('microsecond', min(ts), max(ts)) / 1000000 AS seconds FROM events GROUP BY ALL)""",
)
def granule_ranges(spark, path):
    """Time range of every granule (one user and day) and the total time they cover."""
    granules = V.events(spark, path).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    micros = F.unix_micros("last") - F.unix_micros("first")
    return granules.agg(
        F.count("*").alias("n_granules"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.round(F.sum(micros) / F.lit(3_600_000_000.0), 6).alias("observed_hours"),
    )


@query(
    "catalogue_cadence",
    """SELECT station_id, count(DISTINCT strftime(acq_end, '%H%M')) AS n_slots, min(strftime(acq_end, '%H%M')) AS first_slot,
      max(strftime(acq_end, '%H%M')) AS last_slot FROM scans GROUP BY station_id""",
)
def catalogue_cadence(spark, path):
    slot = clock.clock_slot(F.concat(F.lit("SCAN_"), F.upper(F.date_format("acq_end", "ddMMMyyyy_HHmm")), F.lit("_L2B")))
    slots = V.scans(spark, path).select("station_id", slot.alias("slot")).distinct()
    return slots.groupBy("station_id").agg(
        F.count("slot").alias("n_slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )


@query(
    "coverage_in_windows",
    """SELECT w.window_name, count(*) AS grid_days, count(*) FILTER (n >= 1) AS observed_days, count(*) FILTER (n >= 2) AS positive_days,
      round(100.0::DOUBLE * count(*) FILTER (n >= 2) / count(*), 3) AS positive_pct FROM series_day s JOIN
      (VALUES ('full', 1995, 2001), ('early', 1995, 1997), ('late', 1997, 2001)) w(window_name, lo, hi) ON year(s.timestamp_utc) BETWEEN w.lo AND w.hi GROUP BY ALL""",
)
def coverage_in_windows(spark, path):
    """Named year windows may overlap: years are joined to windows after the daily series is reduced to years."""
    n = F.col("n")
    yearly = V.series_day(spark, path).groupBy(F.year("timestamp_utc").alias("year")).agg(
        F.count("*").alias("grid"), F.count_if(n >= 1).alias("seen"), F.count_if(n >= 2).alias("pos")
    )
    windows = spark.sql("SELECT * FROM VALUES ('full', 1995, 2001), ('early', 1995, 1997), ('late', 1997, 2001) AS t(window_name, lo, hi)")
    spread = windows.withColumn("year", F.explode(F.sequence("lo", "hi")))
    out = spread.join(yearly, "year").groupBy("window_name").agg(
        F.sum("grid").alias("grid_days"), F.sum("seen").alias("observed_days"), F.sum("pos").alias("positive_days")
    )
    return out.withColumn("positive_pct", values.percent(F.col("positive_days"), F.col("grid_days"), 3))


@query(
    "targets_by_evidence",
    """SELECT sat_available, horizon, count(y) AS n_available, count(*) FILTER (y = 1) AS n_positive, count(*) FILTER (y = 0) AS n_negative,
      count(DISTINCT station_id) AS n_stations FROM (SELECT a.sat_available, a.station_id, u.horizon, u.y FROM aligned a JOIN
        (SELECT station_id, timestamp_utc, 'target_1h' AS horizon, target_1h AS y FROM targets UNION ALL SELECT station_id, timestamp_utc, 'target_2h', target_2h FROM targets
         UNION ALL SELECT station_id, timestamp_utc, 'target_3h', target_3h FROM targets) u USING (station_id, timestamp_utc)) GROUP BY ALL""",
)
def targets_by_evidence(spark, path):
    long = T.unpivot_leads(targets_of(spark, path), KEY).withColumnRenamed("lead", "horizon")
    joined = long.join(aligned_of(spark, path).select(*KEY, "sat_available"), KEY)
    per_station = joined.groupBy("sat_available", "horizon", "station_id").agg(
        F.count("y").alias("a"), F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q")
    )
    return per_station.groupBy("sat_available", "horizon").agg(
        F.sum("a").alias("n_available"), F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"), F.count("*").alias("n_stations")
    )


@query(
    "scan_distance_summary",
    f"""SELECT station_id, round(min(distance_km), 6) AS min_km, round(quantile_cont(distance_km, 0.5), 6) AS median_km, round(max(distance_km), 6) AS max_km
      FROM ({_SCAN_FEATURES}) GROUP BY station_id""",
)
def scan_distance_summary(spark, path):
    """Smallest, median and largest nearest-pixel distance per station over all scans."""
    wanted = {"min_km": 0.0, "median_km": 0.5, "max_km": 1.0}
    return rounded(R.percentiles(stage(scan_features_of(spark, path), "scan_features"), ["station_id"], "distance_km", wanted), list(wanted), keep=["station_id"])


@query(
    "non_observation_filter",
    r"""SELECT station_id, count(*) AS reports, count(*) FILTER (regexp_matches(metar, '^\S+\s+\d{6}Z\s+\d{6}\s')) AS forecast_products,
      count(*) FILTER (NOT (regexp_matches(metar, '^\S+\s+\d{6}Z\s+\d{6}\s') AND NOT (regexp_matches(metar, '\bQ\d{4}\b') AND
      regexp_matches(metar, '\bM?\d{2}/M?\d{2}\b')))) AS kept FROM bodies GROUP BY station_id""",
)
def non_observation_filter(spark, path):
    body = F.col("metar")
    product = codes.forecast_product(body)
    return V.bodies(spark, path).groupBy("station_id").agg(
        F.count("*").alias("reports"),
        F.count_if(product).alias("forecast_products"),
        F.count_if(~(product & ~codes.full_decode(body))).alias("kept"),
    )
