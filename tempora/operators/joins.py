"""Joins of station-hour tables, with the audits that go with them.

No join here names a strategy: Spark broadcasts a side whose size is known to be small and shuffles otherwise, and
adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.clock import from_hour_index, minutes_between
from tempora.functions.values import percent
from tempora.operators.profile import correlation, per_column

KEY = ["station_id", "timestamp_utc"]


def inside_window(df: DataFrame, other: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Rows whose time lies in the first-to-last range of the other table."""
    span = other.agg(F.struct(F.min(ts).alias("first"), F.max(ts).alias("last"))).scalar()
    return df.filter((F.col(ts) >= span["first"]) & (F.col(ts) <= span["last"]))


def overlap(features: DataFrame, targets: DataFrame, model: DataFrame) -> DataFrame:
    """Feature, target and forecast-model rows that exist on all three sides."""
    return features.join(targets, KEY).join(model, KEY)


def join_audit(left: DataFrame, right: DataFrame, keys: Sequence[str] = tuple(KEY), by: str = "station_id") -> DataFrame:
    """Matched, left-only and right-only keys per station, with the share of the left side that is kept."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    joined = a.join(b, list(keys), "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    counts = joined.groupBy(by).agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
    )
    return counts.withColumn("retention_pct", percent(F.col("matched"), F.col("matched") + F.col("left_only"), 4))


def equal_after_join(left: DataFrame, right: DataFrame, columns: Sequence[str], keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Rows on both sides and, per column, how many values differ (two unknowns are equal)."""
    joined = left.alias("l").join(right.alias("r"), list(keys))
    differs = [F.count_if(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(f"differs_{c}") for c in columns]
    return joined.agg(F.count("*").alias("n_rows"), *differs)


def asof_hourly(
    hours: DataFrame,
    scans: DataFrame,
    end: str,
    tie: str,
    fields: Sequence[str],
    tolerance_minutes: int = 90,
    by: str = "station_id",
    ts: str = "timestamp_utc",
) -> DataFrame:
    """For every hour T the latest scan with end <= T and age within the tolerance; the smaller tie id wins.

    A scan can serve only the few whole hours from its end to end + tolerance, so it is sent to those hours and reduced
    there by an aggregate. No station is ordered in one task, and many scans in one hour combine before the shuffle.
    """
    second = F.unix_micros(F.col(end)) / 1_000_000
    first = F.ceil(second / 3600)
    last = F.floor((second + tolerance_minutes * 60) / 3600)
    targets = F.when(last >= first, F.sequence(first, last))
    payload = F.struct(end, tie, *[f for f in fields if f not in (end, tie)])
    best = (
        scans.select(by, payload.alias("_scan"), F.explode(targets).alias("_hour"))
        .groupBy(by, "_hour")
        .agg(F.min_by("_scan", F.struct(-F.unix_micros(f"_scan.{end}"), F.isnull(f"_scan.{tie}"), f"_scan.{tie}")).alias("_scan"))
        .select(by, from_hour_index(F.col("_hour")).alias(ts), "_scan")
    )
    joined = hours.join(best, [by, ts], "left")
    found = F.col("_scan").isNotNull()
    names = [end, tie, *[f for f in fields if f not in (end, tie)]]
    return joined.select(
        *hours.columns,
        *[F.col(f"_scan.{n}").alias(n) for n in names],
        found.cast("int").alias("sat_available"),
        F.when(found, minutes_between(F.col(ts), F.col(f"_scan.{end}"))).alias("age_minutes"),
    )


def in_same_hour(hours: DataFrame, scans: DataFrame, start: str, ts: str = "timestamp_utc") -> DataFrame:
    """Scans whose time falls in [T, T + 1 h)."""
    return hours.join(scans.withColumn(ts, F.date_trunc("hour", start)), ["station_id", ts])


def within_windows(
    points: DataFrame, windows: DataFrame, ts: str, start: str, end: str, by: str = "station_id", bin_hours: int = 1
) -> DataFrame:
    """Every (point, window) pair of one station with start <= point <= end.

    Windows are cut into clock bins and joined on the bin; a point lies in one bin, so no pair comes twice.
    """
    size = bin_hours * 3600
    first = F.floor(F.unix_seconds(F.col(start)) / size)
    last = F.floor(F.unix_seconds(F.col(end)) / size)
    bins = windows.withColumn("_bin", F.explode(F.sequence(first, last)))
    placed = points.withColumn("_bin", F.floor(F.unix_seconds(F.col(ts)) / size))
    joined = placed.join(bins, [by, "_bin"])
    return joined.filter((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))).drop("_bin")


def expected_slots(windows: DataFrame, start: str, end: str, minutes: Sequence[int] = (15, 45)) -> DataFrame:
    """The times at which a scan is due inside each window."""
    quarter = 900
    first = F.ceil(F.unix_seconds(F.col(start)) / quarter)
    last = F.floor(F.unix_seconds(F.col(end)) / quarter)
    steps = windows.withColumn("_step", F.explode(F.when(last >= first, F.sequence(first, last))))
    slots = steps.withColumn("slot", F.timestamp_seconds(F.col("_step") * quarter)).drop("_step")
    return slots.filter(F.minute("slot").isin(*minutes))


def slot_audit(windows: DataFrame, scans: DataFrame, start: str, end: str, scan_slot: str, keys: Sequence[str]) -> DataFrame:
    """Per window: due slots, missing slots, scans present, and whether there is none at all."""
    due = expected_slots(windows.select("station_id", *keys, start, end), start, end)
    seen = scans.select("station_id", F.col(scan_slot).alias("slot")).distinct()
    missing = due.join(seen, ["station_id", "slot"], "left_anti")
    by = ["station_id", *keys]
    hits = within_windows(scans.select("station_id", scan_slot), windows, scan_slot, start, end)
    counted = due.groupBy(*by).agg(F.count("*").alias("due"))
    lost = missing.groupBy(*by).agg(F.count("*").alias("missing"))
    present = hits.groupBy(*by).agg(F.count("*").alias("scans"))
    out = windows.select(*by).join(counted, by, "left").join(lost, by, "left").join(present, by, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("due", "missing", "scans")}
    return out.withColumns(zero).withColumn("no_scans", F.col("scans") == 0)


def attach_context(predictions: DataFrame, aligned: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Satellite evidence at exactly T as one nested column; the scores are not touched."""
    evidence = aligned.filter(F.col("sat_available") == 1).select(*KEY, F.struct(*fields).alias("context"))
    return predictions.join(evidence, KEY, "left")


def snapshot(spine: DataFrame, predictions: DataFrame, values: Sequence[str]) -> DataFrame:
    """Every station at every hour; stations without a complete prediction are shown as UNAVAILABLE."""
    complete = predictions.filter(F.col("data_status") == "COMPLETE").select(*KEY, *values, "data_status")
    return spine.join(complete, KEY, "left").withColumn("data_status", F.coalesce("data_status", F.lit("UNAVAILABLE")))


def with_every(df: DataFrame, dimension: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row beside every row of a small dimension, which travels as one array value and is unrolled in place."""
    items = dimension.agg(F.collect_list(F.struct(*columns))).scalar()
    return df.withColumn("_item", F.explode(items)).select(*df.columns, "_item.*")


def guarded_dimension(df: DataFrame, dim: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Attach a dimension value, and report row growth, unknown values and non-constant values in one row."""
    joined = df.join(dim.select(key, value), key, "left")
    per_key = joined.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    report = per_key.agg(
        F.sum("n").alias("rows_after"),
        F.sum("nulls").alias("null_values"),
        F.count_if(~F.col("lo").eqNullSafe(F.col("hi"))).alias("non_constant_keys"),
    )
    return joined, report


def compare_sources(left: DataFrame, right: DataFrame, pairs: dict[str, tuple[str, str]], keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Mean and largest absolute difference and correlation of column pairs, one row per pair.

    The correlation is unknown when a side does not vary.
    """
    joined = left.join(right, list(keys))
    figures = {}
    for name, (a, b) in pairs.items():
        one, other = F.col(a), F.col(b)
        gap = F.abs(one - other)
        figures[name] = {
            "n": F.count_if(one.isNotNull() & other.isNotNull()),
            "mean_abs_diff": F.avg(gap),
            "max_abs_diff": F.max(gap),
            "correlation": correlation(one, other),
        }
    return per_column(joined, [], figures).filter(F.col("n") > 0)
