"""Labels moved to the hour from which they are to be predicted."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.clock import shift_hours
from tempora.operators.series import Chunked

KEY = ["station_id", "timestamp_utc"]


def lead_targets(labels: DataFrame, leads: Sequence[int] = (1, 2, 3), value: str = "target") -> DataFrame:
    """Per lead L: the hour T+L, its label (unknown stays unknown) and an observed flag."""
    series = Chunked(labels, ["station_id"], "timestamp_utc", back=0, ahead=max(leads))
    shifted = series.select(
        *labels.columns, *[series.at(F.col(value), lead).alias(f"target_{lead}h") for lead in leads]
    )
    extra = {}
    for lead in leads:
        extra[f"target_{lead}h_timestamp"] = shift_hours(F.col("timestamp_utc"), lead)
        extra[f"target_{lead}h_observed"] = F.col(f"target_{lead}h").isNotNull().cast("int")
    return shifted.withColumns(extra)


def unpivot_leads(df: DataFrame, ids: Sequence[str], leads: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """One row per lead: ``lead`` and ``y``."""
    return df.select(*ids, *[f"target_{lead}h" for lead in leads]).unpivot(
        list(ids), [f"target_{lead}h" for lead in leads], "lead", "y"
    )


def shift_check(targets: DataFrame, labels: DataFrame, lead: int) -> DataFrame:
    """Compare the shifted label with a self-join at T+L: counts of disagreements and of unknown written as 0."""
    future = labels.select("station_id", F.col("timestamp_utc").alias("_future"), F.col("target").alias("_want"))
    found = F.col(f"target_{lead}h")
    joined = targets.withColumn("_future", F.col(f"target_{lead}h_timestamp")).join(future, ["station_id", "_future"], "left")
    return joined.agg(
        F.lit(f"{lead}h").alias("lead"),
        F.count("*").alias("n_rows"),
        F.count_if(~found.eqNullSafe(F.col("_want"))).alias("disagreements"),
        F.count_if((F.col(f"target_{lead}h_observed") == 0) & (found == 0)).alias("unknown_as_zero"),
        F.count_if(found == F.col("target")).alias("same_as_now"),
        F.count_if(found != F.col("target")).alias("differs_from_now"),
    )


def missing_reasons(long: DataFrame, window_end: datetime) -> DataFrame:
    """Why future labels are missing: beyond the window, or inside it without an observation."""
    hours = F.regexp_extract("lead", r"(\d+)", 1).cast("int")
    future = F.unix_seconds("timestamp_utc") + hours * 3600
    beyond = future > F.unix_seconds(F.lit(window_end))
    reason = F.when(beyond, "outside_modelling_window").otherwise("hour_present_in_window_but_no_genuine_observation")
    return long.filter(F.col("y").isNull()).groupBy("lead", reason.alias("reason")).agg(F.count("*").alias("n"))
