"""Checks on tables with planted faults: each rule must name as many violations as SQL counts in the given tables.

A fault is planted at one hour of the day, so the faults of one table do not hide each other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog.aggregates import _SPLIT
from tempora.catalog.checks import all_pairs_there, bins_cover
from tempora.catalog.evaluate import scored_of, scores_only
from tempora.catalog.features import features_of, hours_of
from tempora.catalog.joins import aligned_of, scan_features_of
from tempora.catalog.labels import labels_of, targets_of
from tempora.catalog.registry import CHECKS, query
from tempora.functions import geo
from tempora.operators import evaluate as E
from tempora.operators import joins as J
from tempora.operators import labels as L
from tempora.operators import quality as Q
from tempora.operators import splits as S
from tempora.session import stage
from tempora.sources import views as V

KEY = ["station_id", "timestamp_utc"]


def _counts(source: str, **violations: str) -> str:
    """SQL rows of a check from the conditions, or whole aggregates, that count each rule's violations."""
    parts = []
    for name, rule in violations.items():
        n = rule[1:] if rule.startswith("=") else f"count(*) FILTER ({rule})"
        parts.append(f"SELECT '{name}' AS \"check\", coalesce({n}, 0)::BIGINT AS detail FROM t")
    return f"WITH t AS ({source}) SELECT \"check\", detail = 0 AS passed, detail FROM ({' UNION ALL '.join(parts)})"


def _at(hour: int):
    return F.hour("timestamp_utc") == hour


def _plant(df, faults):
    """``{column: [(condition, value), ...]}``: the value stands where the condition holds, else the column's own."""
    out = {}
    for column, cases in faults.items():
        value = F.col(column)
        for condition, planted in cases:
            value = F.when(condition, planted).otherwise(value)
        out[column] = value
    return df.withColumns(out)


_AT = "hour(timestamp_utc) = {}".format


@query(
    "label_domain_planted",
    _counts(
        CHECKS["label_variants"],
        label_is_binary=f"{_AT(1)} AND label IS NOT NULL",
        strict_not_above_label=f"{_AT(2)} AND label IS NOT NULL",
        label_not_above_recovered="hour(timestamp_utc) IN (1, 3) AND label IS NOT NULL",
        unknown_stays_unknown=f"{_AT(4)} AND n_reports = 0",
        flag_matches_label=f"{_AT(5)} AND n_reports_with_wx = 0",
    ),
)
def label_domain_planted(spark, path):
    known = F.col("label").isNotNull()
    faults = {
        "label": [(_at(1) & known, 2.0), (_at(2) & known, 0.0), (_at(3) & known, 1.0), (_at(4) & (F.col("n_reports") == 0), 0.0)],
        "label_strict": [(_at(2) & known, 1.0)],
        "label_recovered": [(_at(3) & known, 0.0)],
        "wx_field_observed": [(_at(5), 1)],
    }
    return Q.label_rules(_plant(L.label_variants(V.bodies(spark, path), V.spine(spark, path)), faults))


@query(
    "target_checks_planted",
    _counts(
        "FROM targets",
        targets_binary=f"{_AT(1)} AND target_1h IS NOT NULL",
        unknown_not_zero=f"{_AT(2)} AND target_1h = 0",
        flag_matches_value=f"{_AT(2)} AND target_1h = 0 OR {_AT(3)} AND target_2h IS NULL",
    ),
)
def target_checks_planted(spark, path):
    faults = {
        "target_1h": [(_at(1) & F.col("target_1h").isNotNull(), 0.5)],
        "target_1h_observed": [(_at(2) & (F.col("target_1h") == 0), 0)],
        "target_2h_observed": [(_at(3), 1)],
    }
    return Q.target_rules(_plant(targets_of(spark, path), faults), V.LEADS)


@query(
    "score_checks_planted",
    _counts(
        "FROM scored",
        probability_in_unit_interval=_AT(1),
        alert_follows_threshold=f"{_AT(1)} AND alert = 1 OR {_AT(2)}",
        unknown_target_not_scored=_AT(3),
        bins_cover_all=_AT(4),
    ),
)
def score_checks_planted(spark, path):
    """The outer bins are open, so only an unknown probability is in none."""
    faults = {
        "p": [(_at(1), -0.5), (_at(4), F.lit(None).cast("double"))],
        "alert": [(_at(2), 1 - F.col("alert"))],
        "y": [(_at(3), F.lit(None).cast("int"))],
    }
    scored = _plant(scored_of(spark, path), faults)
    return Q.score_rules(scored, E.THRESHOLD).unionByName(bins_cover(scored))


@query(
    "alignment_checks_planted",
    _counts(
        "FROM aligned",
        age_within_limit=f"{_AT(1)} AND sat_available = 1",
        end_not_after_hour=f"{_AT(2)} AND sat_available = 1",
        unmatched_is_empty=f"{_AT(3)} AND sat_available = 0",
        unique_key=_AT(4),
        source_in_inventory=f"{_AT(5)} AND sat_available = 1",
    ),
)
def alignment_checks_planted(spark, path):
    matched = F.col("sat_available") == 1
    faults = {
        "age_minutes": [(_at(1) & matched, F.lit(200.0)), (_at(3) & ~matched, F.lit(5.0))],
        "acq_end": [(_at(2) & matched, F.timestamp_add("hour", F.lit(1), F.col("timestamp_utc")))],
        "gid": [(_at(5) & matched, -1 - F.col("gid"))],
    }
    aligned = _plant(aligned_of(spark, path), faults)
    twice = aligned.withColumn("_n", F.explode(F.when(_at(4), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_n")
    return Q.alignment_rules(twice, V.scans(spark, path))


@query(
    "extraction_checks_planted",
    _counts(
        CHECKS["scan_station_features"],
        fractions_in_unit_interval="station_id = 'purchase' AND cloudy_fraction IS NOT NULL",
        fill_is_no_class="station_id = 'view'",
        unavailable_is_empty="station_id = 'click' AND cloud_mask IS NOT NULL",
        rows_are_scans_by_stations="station_id = 'signup'",
    ),
)
def extraction_checks_planted(spark, path):
    """Shares above 1, the fill value as a class, values without a valid pixel and lost rows, each at another station."""
    station = F.col("station_id")
    faults = {
        "cloudy_fraction": [(station == "purchase", F.col("cloudy_fraction") + 1.5)],
        "cloud_mask": [(station == "view", geo.FILL_CLASS)],
        "available": [(station == "click", 0)],
    }
    rows = _plant(scan_features_of(spark, path), faults).filter(station != "signup")
    return Q.extraction_rules(rows, geo.FILL_CLASS).unionByName(all_pairs_there(spark, path, rows))


@query(
    "context_fault_planted",
    _counts(
        "SELECT a.timestamp_utc, p.p_1h, a.sat_available FROM predictions p JOIN aligned a USING (station_id, timestamp_utc)",
        scores_lost=f"{_AT(2)} AND p_1h IS NOT NULL",
        scores_added=f"{_AT(1)} AND sat_available = 1 OR {_AT(2)} AND p_1h IS NOT NULL",
    ),
)
def context_fault_planted(spark, path):
    """Evidence that repeats a key adds scores, and a step that writes to a score changes it."""
    names = [*KEY, "p_1h", "p_2h", "p_3h"]
    plain = scores_only(spark, path).select(*names)
    aligned = aligned_of(spark, path)
    joined = J.attach_context(plain, aligned.unionByName(aligned.filter(_at(1))), ["gid", "cloudy"])
    return Q.same_rows(plain, _plant(joined, {"p_1h": [(_at(2), F.col("p_1h") + 1.0)]}).select(*names))


@query(
    "grid_checks_planted",
    _counts(
        f"""SELECT station_id, count(*) FILTER (step > 3600) AS gaps, count(*) FILTER (step < 3600) AS short, count(*) FILTER (s % 3600 <> 0) AS off,
          max(s) // 3600 - ceil(min(s) / 3600) + 1 - count(*) FILTER (s % 3600 = 0) AS lost FROM (SELECT *, s - lag(s) OVER (PARTITION BY station_id ORDER BY s) AS step FROM
          (SELECT station_id, epoch(timestamp_utc)::BIGINT AS s FROM labels WHERE NOT ({_AT(1)} AND target IS NULL)
            UNION ALL SELECT station_id, epoch(timestamp_utc)::BIGINT + 1800 FROM labels WHERE {_AT(5)} AND target = 1)) GROUP BY station_id""",
        no_gaps="=sum(gaps)",
        no_short_steps="=sum(short)",
        on_the_hour="=sum(off)",
        no_missing_hours="=sum(lost)",
    ),
)
def grid_checks_planted(spark, path):
    """Unknown hours are lost at one hour of the day, and positive ones come again half an hour late at another."""
    labels = labels_of(spark, path).select(*KEY, "target")
    late = labels.filter(_at(5) & (F.col("target") == 1)).withColumn("timestamp_utc", F.timestamp_add("minute", F.lit(30), F.col("timestamp_utc")))
    left = labels.filter(~(_at(1) & F.col("target").isNull()))
    return Q.grid_check(left.unionByName(late).select(*KEY))


@query(
    "split_order_planted",
    _counts(
        f"""SELECT max(timestamp_utc) FILTER (split = 'train') AS a, min(timestamp_utc) FILTER (split = 'validation') AS b,
          max(timestamp_utc) FILTER (split = 'validation') AS c, min(timestamp_utc) FILTER (split = 'test') AS d
          FROM (SELECT timestamp_utc, CASE WHEN {_AT(2)} AND target_1h = 1 THEN 'validation' ELSE split END AS split FROM ({_SPLIT}))""",
        train_before_validation="a >= b",
        validation_before_test="c >= d",
    ),
)
def split_order_planted(spark, path):
    """Positive rows of one hour of the day stand in the validation part wherever they lie."""
    rows = S.with_split(targets_of(spark, path).select(*KEY, "target_1h"))
    return Q.split_order(S.split_bounds(_plant(rows, {"split": [(_at(2) & (F.col("target_1h") == 1), "validation")]})))


@query(
    "two_inputs_planted",
    f"""SELECT 'precipitation' AS "column", count(*) AS compared, count(*) FILTER ({_AT(1)} AND precipitation IS NOT NULL) AS mismatches, 0.5::DOUBLE AS max_abs_difference FROM atmos
      UNION ALL SELECT 'temperature_2m', count(*), count(*) FILTER ({_AT(2)} AND temperature_2m IS NOT NULL), 0.0::DOUBLE FROM atmos""",
)
def two_inputs_planted(spark, path):
    """A changed and a lost value are mismatches; a value lost on one side has no difference."""
    hours = stage(hours_of(spark, path), "hours")
    changed = _plant(hours, {"precipitation": [(_at(1), F.col("precipitation") + 0.5)], "temperature_2m": [(_at(2), F.lit(None).cast("double"))]})
    out = Q.same_values(features_of(spark, path), changed, ["precipitation", "temperature_2m"], 1e-12)
    return out.withColumn("max_abs_difference", F.round("max_abs_difference", 9))
