"""Queries on replay and model experiments. Forest results have no SQL form; the metrics they use have."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.aggregates import impute_with_train_median
from tempora.catalog.evaluate import scores_only
from tempora.catalog.labels import targets_of
from tempora.catalog.registry import query
from tempora.functions import clock, wind
from tempora.operators import features as X
from tempora.operators import joins as J
from tempora.operators import splits as S
from tempora.operators import status as U
from tempora.operators.sampling import ranked
from tempora.plans import experiments as P
from tempora.plans import replay as R
from tempora.session import scratch_path, stage
from tempora.sources import views as V

KEY = ["station_id", "timestamp_utc"]
TARGETS = ["target_1h", "target_2h", "target_3h"]
#: Forests of the registered queries; the library's defaults are 200 trees as deep as they grow.
TREES = 50
DEPTH = 8


def model_table(spark, path):
    """The 73 features, forecast-model columns, climatology and targets on the common keys, staged once."""
    from tempora.catalog.features import features_of
    from tempora.catalog.joins import climatology_of

    features = features_of(spark, path).select(*KEY, *X.FEATURES)
    table = J.overlap(features, targets_of(spark, path).select(*KEY, *TARGETS), V.nwp(spark, path).select(*KEY, *V.MODEL))
    return stage(table.join(climatology_of(spark, path).select("station_id", "annual_hours"), "station_id"), "model_table")


def judged_of(spark, path):
    wanted = R.candidates(V.spine(spark, path), 6, V.replay_start(spark, path), V.last_hour(spark, path))
    return R.judge_candidates(wanted, V.atmos(spark, path), V.nwp(spark, path), V.ATMOSPHERE, V.MODEL, X.HISTORY_HOURS)


_JUDGED = f"""SELECT a.station_id, a.timestamp_utc, CASE WHEN a.k < 25 THEN 'insufficient_history' WHEN n.nwp_cape IS NULL OR n.nwp_convective_inhibition IS NULL THEN 'missing_required_nwp' END AS reason
  FROM (SELECT *, count(temperature_2m) OVER (PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS k FROM atmos) a
  LEFT JOIN nwp n ON n.station_id = a.station_id AND n.timestamp_utc = a.timestamp_utc WHERE a.timestamp_utc >= {V.REPLAY_START_SQL} AND hour(a.timestamp_utc) % 6 = 0"""


@query("replay_candidates", f"SELECT station_id, timestamp_utc, reason AS unavailable_reason, CASE WHEN reason IS NULL THEN 'COMPLETE' ELSE 'UNAVAILABLE' END AS data_status FROM ({_JUDGED})")
def replay_candidates(spark, path):
    return judged_of(spark, path).select(*KEY, "unavailable_reason", "data_status")


def formula_scores(spark, path):
    """A scoring function for judged rows: the formula scores where the status allows one."""
    source = scores_only(spark, path).select(*KEY, *[F.col(f"p_{k}h").alias(f"_p{k}") for k in V.LEADS])

    def score(judged):
        complete = F.col("data_status") == "COMPLETE"
        joined = judged.join(source, KEY, "left")
        return joined.withColumns({f"p_{k}h": F.when(complete, F.col(f"_p{k}")) for k in V.LEADS})

    return score


@query(
    "replay_predictions",
    f"""SELECT j.station_id, j.timestamp_utc, CASE WHEN reason IS NULL THEN 'COMPLETE' ELSE 'UNAVAILABLE' END AS data_status, reason AS unavailable_reason, {', '.join(
        f"CASE WHEN reason IS NULL THEN p_{k}h END AS p_{k}h, target_{k}h, CASE WHEN reason IS NULL THEN alert_{k}h END AS alert_{k}h" for k in V.LEADS)}
      FROM ({_JUDGED}) j JOIN alerts a ON a.station_id = j.station_id AND a.timestamp_utc = j.timestamp_utc""",
)
def replay_predictions(spark, path):
    return R.replay(judged_of(spark, path), formula_scores(spark, path), targets_of(spark, path))


_REPLAY_LONG = " UNION ALL ".join(
    f"SELECT '{k}h' AS lead, station_id, alert_{k}h AS a, target_{k}h AS y FROM alerts JOIN ({_JUDGED}) j USING (station_id, timestamp_utc) WHERE j.reason IS NULL AND p_{k}h IS NOT NULL AND target_{k}h IS NOT NULL"
    for k in V.LEADS
)


@query(
    "replay_evaluation",
    f"""SELECT lead, coalesce(station_id, 'ALL') AS station_id, count(*) FILTER (a = 1 AND y = 1) AS "TP", count(*) FILTER (a = 1 AND y = 0) AS "FP", count(*) FILTER (a = 0 AND y = 1) AS "FN",
      count(*) FILTER (a = 0 AND y = 0) AS "TN", count(*) AS n FROM ({_REPLAY_LONG}) GROUP BY GROUPING SETS ((lead), (lead, station_id))""",
)
def replay_evaluation(spark, path):
    out = R.evaluate(R.replay(judged_of(spark, path), formula_scores(spark, path), targets_of(spark, path)))
    return out.select("lead", "station_id", "TP", "FP", "FN", "TN", "n")


@query(
    "replay_availability",
    f"""SELECT station_id, CASE WHEN reason IS NULL THEN 'complete' WHEN reason = 'insufficient_history' THEN 'missing_history' ELSE 'missing_nwp' END AS reason_group, count(*) AS n FROM ({_JUDGED}) GROUP BY ALL""",
)
def replay_availability(spark, path):
    return U.availability(judged_of(spark, path))


@query(
    "class_weights",
    """SELECT y, count(*) AS n, round(max(total / (2.0::DOUBLE * k)), 9) AS weight FROM (SELECT target_1h::INT AS y, count(*) OVER () AS total, count(*) OVER (PARTITION BY target_1h) AS k
      FROM targets WHERE target_1h IS NOT NULL) GROUP BY y""",
)
def class_weights(spark, path):
    weighted = P.balanced(P.labelled(targets_of(spark, path), "target_1h"))
    return weighted.groupBy("y").agg(F.count("*").alias("n"), F.round(F.max("weight"), 9).alias("weight"))


_FIGURES = ["experiment", "lead", "split", "limit", "n", "positives", "precision", "recall", "f1", "fbeta", "alert_rate", "roc_auc", "pr_auc"]


@query("forest_feature_sets", None)
def forest_feature_sets(spark, path):
    """73 features, 83 with the forecast model, 84 with the climatology: same rows and splits, three leads, all parts."""
    sets = {"A": X.FEATURES, "B": X.FEATURES + V.MODEL, "C": X.FEATURES + V.MODEL + ["annual_hours"]}
    return P.compare_feature_sets(model_table(spark, path), sets, TARGETS, trees=TREES, depth=DEPTH).select(*_FIGURES)


@query("forest_leave_one_station_out", None)
def forest_leave_one_station_out(spark, path):
    """Every station held out once, for each lead."""
    return P.leave_one_station_out(model_table(spark, path), X.FEATURES + V.MODEL, TARGETS, trees=TREES, depth=DEPTH).select(*_FIGURES)


@query("forest_with_imputed_model", None)
def forest_with_imputed_model(spark, path):
    """Missing model values filled with train medians, then the same experiment."""
    filled = impute_with_train_median(S.with_split(model_table(spark, path)), V.MODEL).drop("split")
    return P.compare_feature_sets(filled, {"B_imputed": X.FEATURES + V.MODEL}, TARGETS, trees=TREES, depth=DEPTH).select(*_FIGURES)


@query("forest_importance", None)
def forest_importance(spark, path):
    """Impurity and permutation importance of every feature with min-method ranks, five permutations each."""
    names = X.FEATURES + V.MODEL
    rows = P.labelled(P.vectors(model_table(spark, path), names, ["target_1h"]), "target_1h").withColumn("features", P.sliced(names, names))
    train = P.balanced(rows.filter(F.col("split") == "train")).select("features", F.col("y").cast("double").alias("y"), "weight")
    if train.isEmpty():  # no complete hour, no model
        return spark.createDataFrame([], "feature string, importance double, importance_mean double, importance_std double, impurity_rank int, permutation_rank int")
    model = P.estimator(trees=TREES, depth=DEPTH).fit(train)
    permuted = P.permutation_importance(model, rows.filter(F.col("split") == "validation"), names)
    both = P.impurity_importance(model, names).join(permuted, "feature").withColumn("_g", F.lit(1))
    out = ranked(ranked(both, "importance", "impurity_rank", ["_g"]), "importance_mean", "permutation_rank", ["_g"])
    return out.drop("_g")


@query("forest_replay", None)
def forest_replay(spark, path):
    """Replay with fitted forests: only complete candidates are scored, targets come last."""
    names = [*X.CURRENT, *V.MODEL]
    rows = P.complete_cases(model_table(spark, path), names, TARGETS)
    models = {k: P.fit(P.labelled(rows.filter(F.col("split") == "train"), f"target_{k}h"), names, trees=TREES, depth=DEPTH) for k in V.LEADS}
    out = R.replay(judged_of(spark, path), lambda judged: P.score_leads(models, judged, names), targets_of(spark, path))
    return out.select(*KEY, "data_status", "unavailable_reason", "p_1h", "p_2h", "p_3h", "alert_1h", "target_1h")


@query("forest_save_and_load", "SELECT 'same_scores' AS \"check\", true AS passed, 0::BIGINT AS detail")
def forest_save_and_load(spark, path):
    """A saved and loaded forest gives the same scores."""
    from tempora.functions.values import close
    from tempora.operators.quality import check_rows

    names = [*X.CURRENT]
    rows = P.labelled(P.complete_cases(model_table(spark, path), names, ["target_1h"]), "target_1h")
    model = P.fit(rows.filter(F.col("split") == "train"), names, trees=20, depth=6)
    again = P.round_trip(model, scratch_path(spark, "forest"))
    a = P.score(model, rows).select(*KEY, F.col("p").alias("a"))
    b = P.score(again, rows).select(*KEY, F.col("p").alias("b"))
    return check_rows(a.join(b, KEY).agg(F.count_if(~close(F.col("a"), F.col("b"), 1e-12)).alias("n")), {"same_scores": "n"})
