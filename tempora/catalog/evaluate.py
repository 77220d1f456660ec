"""Queries on scores, thresholds, replay results and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.aggregates import _SPLIT
from tempora.catalog.features import rounded
from tempora.catalog.labels import targets_of
from tempora.catalog.registry import query
from tempora.functions import values
from tempora.operators import evaluate as E
from tempora.operators import ordered as R
from tempora.operators import sampling as G
from tempora.operators import splits as S
from tempora.operators import status as U
from tempora.sources import views as V

KEY = ["station_id", "timestamp_utc"]
TARGETS = ["target_1h", "target_2h", "target_3h"]


def scores_only(spark, path):
    """Probabilities and status of every station-hour, from whole-number sums; no target is read."""
    sums = V.hourly_sums(V.events(spark, path), a_=F.lit(True), b_=F.lit(True))
    joined = V.spine(spark, path, V.known_window(spark, path)).join(sums, KEY, "left")
    reason = values.first_failure([(F.col("a_s").isNull(), "insufficient_history"), (F.col("b_s").isNull(), "missing_required_nwp")])
    return joined.select(
        *KEY,
        F.when(reason.isNull(), "COMPLETE").otherwise("UNAVAILABLE").alias("data_status"),
        reason.alias("unavailable_reason"),
        ((F.col("a_s") * 13 + F.col("b_s") * 7) % 400 / 1000.0).alias("p_1h"),
        ((F.col("a_s") * 17 + F.col("b_sk") * 3) % 500 / 1000.0).alias("p_2h"),
        ((F.col("a_sk") * 29 + F.col("b_s") * 5) % 1000 / 1000.0).alias("p_3h"),
    )


def predictions_of(spark, path):
    """Scores first, targets joined afterwards, then the alert rule."""
    joined = scores_only(spark, path).join(targets_of(spark, path).select(*KEY, *TARGETS), KEY)
    return joined.withColumns({f"alert_{k}h": values.alert(F.col(f"p_{k}h"), E.THRESHOLD) for k in V.LEADS})


def scored_of(spark, path):
    return E.labelled(E.long_scores(predictions_of(spark, path)))


@query(
    "predictions",
    """SELECT station_id, timestamp_utc, data_status, unavailable_reason, p_1h, p_2h, p_3h, target_1h, target_2h, target_3h, alert_1h, alert_2h, alert_3h FROM alerts""",
)
def predictions(spark, path):
    return predictions_of(spark, path)


_VERDICTS = ", ".join(f"count(*) FILTER (verdict = '{v}') AS \"{v}\"" for v in ("TP", "FP", "FN", "TN"))


@query("confusion", f"SELECT lead, {_VERDICTS}, count(*) AS n FROM scored GROUP BY lead")
def confusion(spark, path):
    return scored_of(spark, path).groupBy("lead").agg(*E.verdict_counts(), F.count("*").alias("n"))


_COUNTED = """SELECT lead, coalesce(station_id, 'ALL') AS station_id, count(*) FILTER (verdict = 'TP') AS tp, count(*) FILTER (verdict = 'FP') AS fp,
  count(*) FILTER (verdict = 'FN') AS fn, count(*) FILTER (verdict = 'TN') AS tn FROM scored GROUP BY GROUPING SETS ((lead), (lead, station_id))"""
_RATES = """SELECT lead, station_id, tp AS "TP", fp AS "FP", fn AS "FN", tn AS "TN", tp + fp + fn + tn AS n, tp + fn AS positives, fp + tn AS negatives,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fp + fn > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp) ELSE 0 END AS fbeta,
  (tp + tn) / (tp + fp + fn + tn) AS accuracy, (tp + fp) / (tp + fp + fn + tn) AS alert_rate, (tp + fn) / (tp + fp + fn + tn) AS positive_rate,
  CASE WHEN tp > 0 THEN fp / tp END AS false_alarms_per_hit FROM counted"""
_FIGURES = ["precision", "recall", "f1", "fbeta", "accuracy", "alert_rate", "positive_rate", "false_alarms_per_hit"]
_SCOPED = """scoped AS (SELECT lead, station_id, p, y FROM scored UNION ALL SELECT lead, 'ALL', p, y FROM scored)"""
_RANKING = f"""SELECT lead, station_id, roc_auc, pr_auc FROM
  (SELECT lead, station_id, sum(CASE WHEN y = 1 THEN r END) AS ranks, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn,
     CASE WHEN count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0 THEN (sum(CASE WHEN y = 1 THEN r END) - np * (np + 1) / 2) / (np * nn) END AS roc_auc
   FROM (SELECT *, rank() OVER (PARTITION BY lead, station_id ORDER BY p) + (count(*) OVER (PARTITION BY lead, station_id, p) - 1) / 2 AS r FROM scoped) GROUP BY ALL)
  LEFT JOIN (SELECT lead, station_id, sum(d * tp / taken) / max(tp) AS pr_auc FROM
    (SELECT lead, station_id, p, sum(y) AS d, sum(sum(y)) OVER w AS tp, sum(count(*)) OVER w AS taken FROM scoped GROUP BY lead, station_id, p
     WINDOW w AS (PARTITION BY lead, station_id ORDER BY p DESC)) GROUP BY ALL HAVING max(tp) > 0 AND max(tp) < max(taken)) USING (lead, station_id)"""
_RATE_LIST = ", ".join(f"round({c}, 9) AS {c}" for c in _FIGURES)


@query(
    "metrics_pooled_and_station",
    f"""WITH counted AS ({_COUNTED}), {_SCOPED}, rates AS ({_RATES}), ranking AS ({_RANKING})
      SELECT lead, station_id, "TP", "FP", "FN", "TN", n, positives, negatives, {_RATE_LIST}, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc
      FROM rates JOIN ranking USING (lead, station_id)""",
)
def metrics_pooled_and_station(spark, path):
    out = E.metrics(scored_of(spark, path), ["lead"])
    keep = ["lead", "station_id", "TP", "FP", "FN", "TN", "n", "positives", "negatives"]
    return rounded(out, [*_FIGURES, "roc_auc", "pr_auc"], 9, keep)


@query(
    "ranking_skill",
    f"WITH {_SCOPED} SELECT lead, station_id, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM ({_RANKING})",
)
def ranking_skill(spark, path):
    groups = E.score_groups(scored_of(spark, path), ["lead"], "station_id")
    return rounded(E.ranking(groups, ["lead", "station_id"]), ["roc_auc", "pr_auc"], 9, ["lead", "station_id"])


_SWEEP = """(SELECT lead, p AS threshold, tp::BIGINT AS tp, (taken - tp)::BIGINT AS fp, tp / taken AS precision, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS recall, taken / n AS alert_rate,
    2 * tp / (taken + np) AS f1, 5 * tp / (taken + 4 * np) AS fbeta FROM
    (SELECT lead, p, sum(sum(y)) OVER w AS tp, sum(count(*)) OVER w AS taken, sum(sum(y)) OVER (PARTITION BY lead) AS np, sum(count(*)) OVER (PARTITION BY lead) AS n
     FROM scored GROUP BY lead, p WINDOW w AS (PARTITION BY lead ORDER BY p DESC)))"""


@query(
    "threshold_sweep",
    f"SELECT lead, threshold, tp, fp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(alert_rate, 9) AS alert_rate, round(f1, 9) AS f1, round(fbeta, 9) AS fbeta FROM ({_SWEEP})",
)
def threshold_sweep(spark, path):
    out = E.sweep(E.score_groups(scored_of(spark, path), ["lead"]), ["lead"])
    return rounded(out, ["precision", "recall", "alert_rate", "f1", "fbeta"], 9, ["lead", "threshold", "tp", "fp"])


@query(
    "threshold_choice",
    f"""WITH s AS ({_SWEEP}), b AS (SELECT lead, max(fbeta) FILTER (alert_rate <= 0.2::DOUBLE) AS best, count(*) AS candidates,
        count(*) FILTER (alert_rate <= 0.2::DOUBLE) AS candidates_inside, arg_max(alert_rate, fbeta) AS free_rate FROM (FROM s ORDER BY threshold DESC) GROUP BY lead)
      SELECT lead, candidates, candidates_inside, round(min(threshold), 6) AS threshold, round(arg_min(fbeta, threshold), 9) AS fbeta,
        round(arg_min(alert_rate, threshold), 9) AS alert_rate, bool_or(free_rate > 0.2::DOUBLE) AS guardrail_binding
      FROM s JOIN b USING (lead) WHERE alert_rate <= 0.2::DOUBLE AND abs(fbeta - best) <= 1e-8 + 1e-5 * abs(best) GROUP BY ALL""",
)
def threshold_choice(spark, path):
    out = E.choose_threshold(E.sweep(E.score_groups(scored_of(spark, path), ["lead"]), ["lead"]), ["lead"])
    return rounded(out, ["threshold"], 6, ["lead", "candidates", "candidates_inside", "fbeta", "alert_rate", "guardrail_binding"]).withColumns(
        {"fbeta": F.round("fbeta", 9), "alert_rate": F.round("alert_rate", 9)}
    )


@query(
    "probability_bins",
    """SELECT d.lead, b.bin_no, b.bin, count(s.p) AS n, coalesce(sum(y), 0)::BIGINT AS positive_count, coalesce(sum(alert), 0)::BIGINT AS alert_count,
      CASE WHEN count(s.p) > 0 THEN coalesce(sum(y), 0) / count(s.p) END AS positive_rate FROM (SELECT unnest(['1h', '2h', '3h']) AS lead) d CROSS JOIN
      (VALUES (1, '[0.000, 0.025)', 0.0, 0.025), (2, '[0.025, 0.050)', 0.025, 0.05), (3, '[0.050, 0.065)', 0.05, 0.065), (4, '[0.065, 0.100)', 0.065, 0.1),
        (5, '[0.100, 0.200)', 0.1, 0.2), (6, '[0.200, 0.500)', 0.2, 0.5), (7, '[0.500, 1.000]', 0.5, 1.0000001)) b(bin_no, bin, lo, hi)
      LEFT JOIN scored s ON s.lead = d.lead AND s.p >= b.lo::DOUBLE AND s.p < b.hi::DOUBLE GROUP BY ALL""",
)
def probability_bins(spark, path):
    return E.bin_table(scored_of(spark, path))


def _error_sql(kind: str) -> str:
    stations = ", ".join(f"count(*) FILTER (station_id = '{s[0]}') AS n_{s[0]}" for s in V.STATIONS)
    months = ", ".join(f"count(*) FILTER (month(timestamp_utc) = {m}) AS n_month_{m:02d}" for m in range(1, 13))
    return f"""SELECT lead, verdict, count(*) AS n, round(min(p), 6) AS prob_min, round(quantile_cont(p, 0.5), 6) AS prob_median, round(avg(p), 6) AS prob_mean,
      round(max(p), 6) AS prob_max, round(abs(quantile_cont(p, 0.5) - 0.065::DOUBLE), 6) AS median_distance, round(abs(avg(p) - 0.065::DOUBLE), 6) AS mean_distance,
      count(*) FILTER (abs(p - 0.065::DOUBLE) <= 0.02::DOUBLE) AS near_threshold, {stations}, {months} FROM scored WHERE verdict IN ({kind}) GROUP BY ALL"""


@query("error_summary", _error_sql("'FP', 'FN'"))
def error_summary(spark, path):
    """False alarms and misses by lead: probabilities, distance to the threshold, stations and months."""
    errors = scored_of(spark, path).filter(F.col("verdict").isin("FP", "FN"))
    p, limit = F.col("p"), F.lit(E.THRESHOLD)
    flags = [F.count_if(F.col("station_id") == s[0]).alias(f"n_{s[0]}") for s in V.STATIONS]
    flags += [F.count_if(F.month("timestamp_utc") == m).alias(f"n_month_{m:02d}") for m in range(1, 13)]
    base = errors.groupBy("lead", "verdict").agg(
        F.count("*").alias("n"),
        F.round(F.min(p), 6).alias("prob_min"),
        F.round(F.avg(p), 6).alias("prob_mean"),
        F.round(F.max(p), 6).alias("prob_max"),
        F.round(F.abs(F.avg(p) - limit), 6).alias("mean_distance"),
        F.count_if(F.abs(p - limit) <= E.NEAR_BAND).alias("near_threshold"),
        *flags,
    )
    median = R.percentiles(errors, ["lead", "verdict"], "p", {"m": 0.5})
    return (
        base.join(median, ["lead", "verdict"])
        .withColumns({"prob_median": F.round("m", 6), "median_distance": F.round(F.abs(F.col("m") - limit), 6)})
        .drop("m")
    )


@query(
    "error_years",
    """SELECT lead, verdict, year(timestamp_utc)::INT AS year, month(timestamp_utc)::INT AS month, count(*) AS n, round(avg(p), 6) AS prob_mean
      FROM scored WHERE verdict IN ('FP', 'FN') GROUP BY ALL""",
)
def error_years(spark, path):
    """Errors of every year and month that has any."""
    return E.errors_by_month(scored_of(spark, path))


@query(
    "error_calendar",
    """SELECT lead, verdict, day(timestamp_utc) AS day, count(*) FILTER (station_id = 'view') AS "view", count(*) FILTER (station_id = 'purchase') AS purchase,
      count(*) FILTER (station_id = 'click') AS click, count(*) FILTER (station_id = 'signup') AS signup, count(*) FILTER (station_id = 'error') AS "error"
      FROM scored WHERE verdict IN ('FP', 'FN') GROUP BY ALL""",
)
def error_calendar(spark, path):
    """Errors pivoted by station with fixed columns."""
    names = [s[0] for s in V.STATIONS]
    errors = scored_of(spark, path).filter(F.col("verdict").isin("FP", "FN"))
    out = errors.groupBy("lead", "verdict", F.dayofmonth("timestamp_utc").alias("day")).pivot("station_id", names).agg(F.count(F.lit(1)))
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


_READY = "(SELECT *, alert_1h::VARCHAR || alert_2h::VARCHAR || alert_3h::VARCHAR AS code FROM alerts WHERE alert_1h IS NOT NULL AND alert_2h IS NOT NULL AND alert_3h IS NOT NULL)"
_PATTERN_RULES = (
    [(f"{i:03b}", f"code = '{i:03b}'") for i in range(8)]
    + [("N_comparable", "true")]
    + [(f"alert_freq_{k}h", f"alert_{k}h = 1") for k in (1, 2, 3)]
    + [("transition_1h_ne_2h", "alert_1h <> alert_2h"), ("transition_2h_ne_3h", "alert_2h <> alert_3h")]
)


@query(
    "alert_patterns",
    " UNION ALL ".join(
        f"SELECT '{name}' AS pattern, count(*) FILTER ({rule}) AS count, count(*) FILTER ({rule}) * 100.0::DOUBLE / count(*) AS percentage FROM {_READY}"
        for name, rule in _PATTERN_RULES
    ),
)
def alert_patterns(spark, path):
    return E.alert_patterns(predictions_of(spark, path))


@query(
    "monthly_two_grains",
    f"""SELECT lead, CASE WHEN m IS NOT NULL THEN 'month_of_year' ELSE 'year_month' END AS grain, coalesce(m, ym) AS period, count(*) AS valid_cases,
      sum(y)::BIGINT AS positive_cases, sum(alert)::BIGINT AS alerts, sum(y) / count(*) AS positive_rate, sum(alert) / count(*) AS alert_rate, {_VERDICTS}
      FROM (SELECT *, strftime(timestamp_utc, '%m') AS m, strftime(timestamp_utc, '%Y-%m') AS ym FROM scored) GROUP BY GROUPING SETS ((lead, m), (lead, ym))""",
)
def monthly_two_grains(spark, path):
    ts = F.col("timestamp_utc")
    rows = scored_of(spark, path).withColumns({"m": F.date_format(ts, "MM"), "ym": F.date_format(ts, "yyyy-MM")})
    sets = [[F.col("lead"), F.col("m")], [F.col("lead"), F.col("ym")]]
    out = rows.groupingSets(sets, "lead", "m", "ym").agg(
        F.count("*").alias("valid_cases"), F.sum("y").alias("positive_cases"), F.sum("alert").alias("alerts"), *E.verdict_counts()
    )
    n = F.col("valid_cases")
    return out.select(
        "lead",
        F.when(F.col("m").isNotNull(), "month_of_year").otherwise("year_month").alias("grain"),
        F.coalesce("m", "ym").alias("period"),
        "valid_cases",
        "positive_cases",
        "alerts",
        (F.col("positive_cases") / n).alias("positive_rate"),
        (F.col("alerts") / n).alias("alert_rate"),
        "TP",
        "FP",
        "FN",
        "TN",
    )


@query(
    "station_year_errors",
    f"SELECT station_id, year(timestamp_utc) AS year, lead, count(*) AS n, sum(y)::BIGINT AS positives, {_VERDICTS} FROM scored GROUP BY ALL",
)
def station_year_errors(spark, path):
    return (
        scored_of(spark, path)
        .groupBy("station_id", F.year("timestamp_utc").alias("year"), "lead")
        .agg(F.count("*").alias("n"), F.sum("y").alias("positives"), *E.verdict_counts())
    )


@query(
    "near_threshold_band",
    f"SELECT lead, count(*) AS n, sum(y)::BIGINT AS positives, {_VERDICTS} FROM scored WHERE abs(p - 0.065::DOUBLE) <= 0.02::DOUBLE GROUP BY lead",
)
def near_threshold_band(spark, path):
    near = F.abs(F.col("p") - E.THRESHOLD) <= E.NEAR_BAND
    return scored_of(spark, path).filter(near).groupBy("lead").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), *E.verdict_counts())


@query(
    "representative_cases",
    """SELECT d.lead, v.verdict, station_id, timestamp_utc, p, CASE WHEN v.verdict IN ('FP', 'FN') THEN p - 0.065::DOUBLE END AS distance,
      CASE WHEN p IS NULL THEN 'unavailable' ELSE 'ok' END AS status FROM (SELECT unnest(['1h', '2h', '3h']) AS lead) d CROSS JOIN
      (SELECT unnest(['TP', 'FP', 'FN', 'TN']) AS verdict) v LEFT JOIN (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lead, verdict ORDER BY
        CASE WHEN verdict IN ('FP', 'FN') THEN abs(p - 0.065::DOUBLE) ELSE 0 END, station_id, timestamp_utc) = 1) s ON s.lead = d.lead AND s.verdict = v.verdict""",
)
def representative_cases(spark, path):
    return G.representative_cases(scored_of(spark, path), E.THRESHOLD)


@query(
    "metric_deltas",
    f"""WITH counted AS ({_COUNTED}), {_SCOPED}, rates AS ({_RATES}), ranking AS ({_RANKING}), m AS (SELECT * FROM rates JOIN ranking USING (lead, station_id))
      SELECT a.station_id, round(b.pr_auc - a.pr_auc, 9) AS delta_pr_auc, round(b.recall - a.recall, 9) AS delta_recall FROM m a JOIN m b USING (station_id)
      WHERE a.lead = '1h' AND b.lead = '2h'""",
)
def metric_deltas(spark, path):
    """Differences of two metric tables on the same keys."""
    table = E.metrics(scored_of(spark, path), ["lead"])
    one, two = (table.filter(F.col("lead") == k).drop("lead") for k in ("1h", "2h"))
    return rounded(E.compare_metrics(one, two, ["station_id"], ["pr_auc", "recall"]), ["delta_pr_auc", "delta_recall"], 9, ["station_id"])


@query("availability", "SELECT station_id, CASE data_status WHEN 'COMPLETE' THEN 'complete' ELSE CASE unavailable_reason WHEN 'insufficient_history' THEN 'missing_history' ELSE 'missing_nwp' END END AS reason_group, count(*) AS n FROM alerts GROUP BY ALL")
def availability(spark, path):
    return U.availability(predictions_of(spark, path))


@query(
    "lead_ranking",
    f"""WITH counted AS ({_COUNTED}), rates AS ({_RATES}) SELECT lead, round(fbeta, 9) AS fbeta, rank() OVER (ORDER BY fbeta DESC, lead) AS place FROM rates WHERE station_id = 'ALL'""",
)
def lead_ranking(spark, path):
    """Leads by F2, the shorter lead first on ties: three rows are ordered."""
    from pyspark.sql import Window

    groups = E.score_groups(scored_of(spark, path), ["lead"])
    table = E.rates(E.confusion(groups, ["lead"]))
    place = F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("fbeta"), "lead")).cast("bigint")
    return table.select("lead", F.round("fbeta", 9).alias("fbeta"), place.alias("place"))


@query(
    "station_ranking",
    """SELECT timestamp_utc, station_id, p_1h, place, (place = 1 AND p_1h IS NOT NULL)::INT AS is_focus FROM (SELECT *, row_number() OVER (PARTITION BY timestamp_utc
      ORDER BY p_1h DESC NULLS LAST, ord) AS place FROM alerts JOIN stations USING (station_id))""",
)
def station_ranking(spark, path):
    out = G.rank_stations(predictions_of(spark, path), V.stations(spark))
    return out.select("timestamp_utc", "station_id", "p_1h", F.col("place").cast("bigint").alias("place"), "is_focus")


@query(
    "hour_cutoffs",
    f"""WITH s AS ({_SPLIT}) SELECT max(timestamp_utc) FILTER (split = 'train') AS train_end, max(timestamp_utc) FILTER (split = 'validation') AS validation_end,
      count(DISTINCT timestamp_utc) FILTER (split = 'train') AS train_hours, count(DISTINCT timestamp_utc) FILTER (split = 'validation') AS validation_hours,
      count(DISTINCT timestamp_utc) FILTER (split = 'test') AS test_hours FROM s""",
)
def hour_cutoffs(spark, path):
    return S.hour_cutoffs(targets_of(spark, path))


@query("split_bounds", f"SELECT split, count(*) AS n_rows, min(timestamp_utc) AS first, max(timestamp_utc) AS last FROM ({_SPLIT}) GROUP BY split")
def split_bounds(spark, path):
    return S.split_bounds(S.with_split(targets_of(spark, path)))


@query(
    "split_by_rows",
    """SELECT station_id, timestamp_utc, CASE WHEN rn <= floor(0.7::DOUBLE * n) THEN 'train' WHEN rn <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split
      FROM (SELECT station_id, timestamp_utc, row_number() OVER (PARTITION BY station_id ORDER BY timestamp_utc) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM series_day)""",
)
def split_by_rows(spark, path):
    return S.split_by_rows(V.series_day(spark, path).select(*KEY), ["station_id"], "timestamp_utc")


@query(
    "boundary_overlap",
    f"""WITH s AS ({_SPLIT}), b AS (SELECT split, min(timestamp_utc) AS first FROM s GROUP BY split), l AS (SELECT unnest([1, 2, 3]) AS lead)
      SELECT s.split, lead, count(*) FILTER (s.timestamp_utc + to_hours(lead) >= b.first) AS rows_reaching_next FROM s JOIN b ON
        (s.split = 'train' AND b.split = 'validation') OR (s.split = 'validation' AND b.split = 'test') CROSS JOIN l GROUP BY ALL""",
)
def boundary_overlap(spark, path):
    return S.boundary_overlap(S.with_split(targets_of(spark, path)))


@query(
    "surrogate_target",
    """WITH f AS (SELECT a.station_id, a.timestamp_utc, CASE WHEN count(b.cents) = 3 THEN sum(b.cents)::DOUBLE END AS future FROM series_day a LEFT JOIN series_day b
        ON b.station_id = a.station_id AND b.timestamp_utc > a.timestamp_utc AND b.timestamp_utc <= a.timestamp_utc + INTERVAL 3 DAY GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp_utc) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM f WHERE future IS NOT NULL),
      c AS (SELECT station_id, quantile_cont(future, 0.9) AS cut FROM r WHERE rn <= floor(0.7::DOUBLE * n) GROUP BY station_id)
      SELECT r.station_id, round(cut, 4) AS cut, count(*) AS n, count(*) FILTER (future >= cut) AS positives FROM r JOIN c USING (station_id) GROUP BY ALL""",
)
def surrogate_target(spark, path):
    """Target from the next three steps: at or above the 0.9 quantile of the training part."""
    from tempora.operators.features import future_total
    from tempora.operators.series import STEP_DAY

    daily = V.series_day(spark, path).select(*KEY, F.col("cents").cast("double").alias("cents"))
    known = future_total(daily, "cents", 3, STEP_DAY, "future").filter(F.col("future").isNotNull())
    split = S.split_by_rows(known, ["station_id"], "timestamp_utc")
    cut = R.percentiles(split.filter(F.col("split") == "train"), ["station_id"], "future", {"cut": 0.9})
    return (
        split.join(cut, "station_id")
        .groupBy("station_id")
        .agg(F.round(F.max("cut"), 4).alias("cut"), F.count("*").alias("n"), F.count_if(F.col("future") >= F.col("cut")).alias("positives"))
    )
