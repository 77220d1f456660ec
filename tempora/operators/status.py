"""Fail-closed availability: the first failing rule decides, and an incomplete input is never filled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.values import finite, first_failure, reason_group

KEY = ["station_id", "timestamp_utc"]


def model_faults(names: Sequence[str], prefix: str) -> list[tuple[Column, str]]:
    return [(~finite(F.col(n)), f"{prefix}:{n}") for n in names]


def judge_requests(requests: DataFrame, stations: DataFrame, hours: DataFrame, atmosphere: Sequence[str], model: Sequence[str]) -> DataFrame:
    """Status of each scoring request (text station, text time) against the hourly history.

    ``hours`` carries ``history_rows`` and ``history_ok``, the seven measurements and the forecast-model columns.
    """
    station = F.upper(F.trim("station_text"))
    parsed = requests.withColumns(
        {"_station": station, "timestamp_utc": F.try_to_timestamp(F.trim("time_text"), F.lit("yyyy-MM-dd HH:mm:ss"))}
    )
    known = stations.select(F.upper("station_id").alias("_station"), "station_id")
    placed = parsed.join(known, "_station", "left").drop("_station")
    joined = placed.join(hours.withColumn("_in_history", F.lit(True)), KEY, "left")
    rules = [
        (F.coalesce(F.trim("station_text"), F.lit("")) == "", "INVALID_STATION"),
        (F.col("station_id").isNull(), "INVALID_STATION"),
        (F.col("timestamp_utc").isNull(), "INVALID_TIMESTAMP"),
        (F.col("_in_history").isNull(), "timestamp_not_in_history"),
        (F.col("history_rows") < 1, "insufficient_history"),
        *model_faults(atmosphere, "missing_or_nonfinite_atmospheric"),
        (~F.col("history_ok"), "insufficient_history"),
        *model_faults(model, "missing_required_nwp"),
    ]
    reason = first_failure(rules)
    return joined.select(
        *requests.columns,
        "station_id",
        "timestamp_utc",
        reason.alias("reason"),
        F.when(reason.isNull(), "COMPLETE").otherwise("UNAVAILABLE").alias("data_status"),
    )


def availability(predictions: DataFrame, by: Sequence[str] = ("station_id",)) -> DataFrame:
    """Complete and unavailable rows per group of reasons."""
    group = F.when(F.col("data_status") == "COMPLETE", "complete").otherwise(reason_group(F.col("unavailable_reason")))
    return predictions.groupBy(*by, group.alias("reason_group")).agg(F.count("*").alias("n"))


def result_rows(predictions: DataFrame, threshold: float, leads: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Nested result: per lead a block of probability, threshold and alert; no block when the input was incomplete."""
    complete = F.col("data_status") == "COMPLETE"
    blocks = [
        F.when(
            complete,
            F.struct(
                F.col(f"p_{k}h").alias("probability"), F.lit(threshold).alias("threshold"), F.col(f"alert_{k}h").alias("alert")
            ),
        ).alias(f"lead_{k}h")
        for k in leads
    ]
    return predictions.select(*KEY, "data_status", *blocks)


def freshness(latest: DataFrame, now: Column, limit_minutes: int, observed: str) -> DataFrame:
    """Age of the newest usable hour; older than the limit is UNAVAILABLE, exactly at the limit is still live."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(observed))) / F.lit(60_000_000.0)
    return latest.withColumn("data_age_minutes", age).withColumn(
        "status", F.when(age <= limit_minutes, "LIVE").otherwise("UNAVAILABLE")
    )


def batch_status(rows: DataFrame) -> DataFrame:
    """Status of a batch of stations: LIVE when all are live, LIVE_PARTIAL when some are, otherwise UNAVAILABLE."""
    live, total = F.count_if(F.col("status") == "LIVE"), F.count("*")
    return rows.agg(total.alias("n_stations"), live.alias("n_live")).withColumn(
        "batch_status",
        F.when((F.col("n_live") == F.col("n_stations")) & (F.col("n_live") > 0), "LIVE")
        .when(F.col("n_live") > 0, "LIVE_PARTIAL")
        .otherwise("UNAVAILABLE"),
    )
