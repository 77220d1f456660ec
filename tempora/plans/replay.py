"""Historical replay: every station and candidate hour in one job, targets read only after scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.values import alert, all_known, finite, first_failure
from tempora.operators import evaluate as E
from tempora.operators.features import full_history
from tempora.operators.joins import KEY
from tempora.operators.sampling import every_hours
from tempora.operators.status import model_faults


def candidates(spine: DataFrame, step: int, first, last) -> DataFrame:
    """Every station at every candidate hour."""
    hours = every_hours(spine, "timestamp_utc", step, first, last)
    return spine.join(hours, "timestamp_utc", "left_semi").select(*KEY)


def judge_candidates(
    wanted: DataFrame, hours: DataFrame, model: DataFrame, atmosphere: Sequence[str], model_columns: Sequence[str], history_hours: int = 24
) -> DataFrame:
    """Status of each candidate: full history, finite measurements at T, forecast-model values at T."""
    history = full_history(hours, all_known([F.col(c) for c in atmosphere]), history_hours)
    joined = wanted.join(history.withColumn("_seen", F.lit(True)), KEY, "left").join(model, KEY, "left")
    reason = first_failure(
        [
            (F.col("_seen").isNull(), "timestamp_outside_nwp_overlap"),
            (~F.col("history_ok"), "insufficient_history"),
            *[(~finite(F.col(c)), "missing_or_nonfinite_features") for c in atmosphere],
            *[(c, "missing_required_nwp") for c, _ in model_faults(model_columns, "")],
        ]
    )
    judged = joined.withColumn("unavailable_reason", reason).drop("_seen")
    complete = F.col("unavailable_reason").isNull()
    return judged.withColumn("data_status", F.when(complete, "COMPLETE").otherwise("UNAVAILABLE"))


def replay(judged: DataFrame, score: Callable[[DataFrame], DataFrame], targets: DataFrame, threshold: float = E.THRESHOLD) -> DataFrame:
    """Score complete candidates, then attach the targets and the alerts.

    ``score`` gets the judged rows and returns the keys, the status, the reason and one probability per lead.
    """
    scored = score(judged).select(*KEY, "data_status", "unavailable_reason", "p_1h", "p_2h", "p_3h")
    joined = scored.join(targets.select(*KEY, "target_1h", "target_2h", "target_3h"), KEY, "left")
    return joined.withColumns({f"alert_{k}h": alert(F.col(f"p_{k}h"), threshold) for k in (1, 2, 3)})


def evaluate(predictions: DataFrame) -> DataFrame:
    """Pooled and per-station metrics of all leads."""
    return E.metrics(E.labelled(E.long_scores(predictions.filter(F.col("data_status") == "COMPLETE"))), ["lead"])
