"""Irregular reports to tri-state hourly labels: 1, 0 or unknown, and unknown is never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import codes
from tempora.functions.clock import hour_of
from tempora.operators.calendar import fill_on_spine

KEY = ["station_id", "timestamp_utc"]


def with_flags(reports: DataFrame) -> DataFrame:
    text = F.col("wxcodes")
    return reports.withColumns(
        {
            "decodable": codes.has_code(text),
            "ts_station": codes.station_event(text),
            "ts_vicinity": codes.vicinity_event(text),
        }
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the given total order. An aggregate, so copies of a hot key combine early."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def first_reports(reports: DataFrame) -> DataFrame:
    """Reports of one station and minute are duplicates; the earliest stays."""
    return keep_first(reports, ["station_id", "valid_minute"], ["valid_ts", "report_id"])


def hourly_counts(reports: DataFrame) -> DataFrame:
    """Per station and hour: reports, reports with a code, reports with the event, any event."""
    event = F.col("ts_station") | F.col("ts_vicinity")
    return reports.groupBy("station_id", hour_of(F.col("valid_ts")).alias("timestamp_utc")).agg(
        F.count("*").alias("n_reports"),
        F.count_if("decodable").alias("n_reports_with_wx"),
        F.count_if(event).alias("n_ts_reports"),
        F.count_if("ts_station").alias("n_station_reports"),
        F.bool_or(event).alias("any_event"),
    )


def tri_state(observed: Column, event: Column) -> Column:
    return F.when(observed, event.cast("double"))


def label_status(target: Column) -> Column:
    return (
        F.when(target == 1, "observed_thunderstorm").when(target == 0, "observed_non_thunderstorm").otherwise("unavailable")
    )


def hourly_labels(reports: DataFrame, spine: DataFrame, evidence: str = "codes") -> DataFrame:
    """Labels on every hour of the calendar.

    ``evidence`` says what makes an hour observed: ``codes`` needs a report with a decodable code, ``reports`` any report.
    """
    counts = ["n_reports", "n_reports_with_wx", "n_ts_reports", "n_station_reports"]
    facts = hourly_counts(first_reports(with_flags(reports).drop("wxcodes")))
    grid = fill_on_spine(spine, facts.drop("any_event"), KEY, counts)
    observed = F.col("n_reports_with_wx" if evidence == "codes" else "n_reports") > 0
    return grid.withColumn("target", tri_state(observed, F.col("n_ts_reports") > 0)).withColumns(
        {"target_observed": F.col("target").isNotNull().cast("int"), "label_status": label_status(F.col("target"))}
    )


def label_variants(bodies: DataFrame, spine: DataFrame) -> DataFrame:
    """Primary, strict and recovered labels with report quality counts; any report makes an hour observed."""
    body = F.col("metar")
    flagged = with_flags(bodies).withColumns(
        {
            "full": codes.full_decode(body),
            "non_observation": codes.forecast_product(body) & ~codes.full_decode(body),
            "recovered": codes.body_event(body),
        }
    )
    kept = keep_first(flagged.filter(~F.col("non_observation")), ["station_id", "valid_minute"], ["metar", "report_id"])
    event = F.col("ts_station") | F.col("ts_vicinity")
    hour = hour_of(F.col("valid_minute")).alias("timestamp_utc")
    # one row per code first: counts add up, and the distinct codes of an hour come from the same pass
    per_code = kept.groupBy("station_id", hour, "wxcodes").agg(
        F.count("*").alias("n_reports"),
        F.count_if("full").alias("n_reports_full_decode"),
        F.count_if("decodable").alias("n_reports_with_wx"),
        F.count_if(event).alias("n_ts_reports"),
        F.count_if("ts_station").alias("n_station_reports"),
        F.count_if(F.col("recovered") & ~event).alias("n_recovered"),
    )
    names = [c for c in per_code.columns if c not in (*KEY, "wxcodes")]
    facts = per_code.groupBy(*KEY).agg(*[F.sum(n).alias(n) for n in names], _joined_codes().alias("wxcodes_observed"))
    grid = fill_on_spine(spine, facts, KEY, names)
    observed = F.col("n_reports") > 0
    primary = tri_state(observed, F.col("n_ts_reports") > 0)
    return grid.select(
        *KEY,
        primary.alias("label"),
        tri_state(observed, F.col("n_station_reports") > 0).alias("label_strict"),
        F.when(F.col("n_recovered") > 0, 1.0).otherwise(primary).alias("label_recovered"),
        F.coalesce("wxcodes_observed", F.lit("")).alias("wxcodes_observed"),
        "n_reports",
        "n_reports_full_decode",
        "n_reports_with_wx",
        (F.col("n_reports_with_wx") > 0).cast("int").alias("wx_field_observed"),
        "n_ts_reports",
    )


def _joined_codes() -> Column:
    """Sorted codes of a group as one text, over rows in which each code comes once; empty and no-code texts are left out."""
    useful = F.when(~F.col("wxcodes").isin("", codes.NO_CODE), F.col("wxcodes"))
    return F.array_join(F.array_sort(F.collect_list(useful)), " | ")


def observed_codes(reports: DataFrame) -> DataFrame:
    """Sorted distinct codes of each hour that has any; repeats are removed by a first aggregate."""
    hour = hour_of(F.col("valid_minute")).alias("timestamp_utc")
    distinct = reports.select("station_id", hour, "wxcodes").distinct()
    return distinct.groupBy(*KEY).agg(_joined_codes().alias("wxcodes_observed")).filter(F.col("wxcodes_observed") != "")


def synchronize(predictors: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels attached to the predictor hours; hours without a label row are unavailable."""
    counts = ["n_reports", "n_reports_with_wx", "n_ts_reports", "target_observed"]
    wanted = labels.select(*KEY, "target", "label_status", *counts)
    return fill_on_spine(predictors, wanted, KEY, counts).withColumn(
        "label_status", F.coalesce("label_status", F.lit("unavailable"))
    )
