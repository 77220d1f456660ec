"""Event episodes, case selection, control windows and complete runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.clock import HOUR_SECONDS, season, shift_hours
from tempora.operators.series import islands

# Hours that may lie between two positives of one episode, longest case, cases per station,
# window margin, clear margin, and the day offsets tried for a control in this order.
GAP_HOURS = 2
MAX_CASE_HOURS = 24
CASES_PER_STATION = 5
WINDOW_MARGIN_HOURS = 2
CLEAR_MARGIN_HOURS = 6
CONTROL_OFFSETS_DAYS = (-14, 14, -21, 21, -7, 7, -28, 28)

STATION = ["station_id"]


def episodes(labels: DataFrame, gap_hours: int = GAP_HOURS) -> DataFrame:
    """Runs of positive hours with at most ``gap_hours`` between neighbours; a duration counts both end hours."""
    positive = labels.filter(F.col("target") == 1).select("station_id", "timestamp_utc")
    runs = islands(positive, STATION, "timestamp_utc", gap_hours)
    span = (F.unix_seconds("end") - F.unix_seconds("start")) / HOUR_SECONDS
    return runs.select(
        "station_id", F.col("start").alias("event_start"), F.col("end").alias("event_end"), F.col("n").alias("n_hours"), (span + 1.0).alias("duration_h")
    )


def select_cases(all_episodes: DataFrame, per_station: int = CASES_PER_STATION, max_hours: int = MAX_CASE_HOURS) -> DataFrame:
    """Up to five cases per station: the longest of each year and season first, then the longest of the rest.

    Ids number the chosen cases over all stations in station and time order.
    """
    order = [F.desc("n_hours"), F.desc("duration_h"), F.asc("event_start")]
    fit = all_episodes.filter(F.col("duration_h") <= max_hours).withColumns(
        {"year": F.year("event_start"), "season": season(F.col("event_start"))}
    )
    in_bin = Window.partitionBy("station_id", "year", "season").orderBy(*order)
    # only the first few of a bin can ever be chosen, so the station-wide ranking below sees few rows
    ranked = fit.withColumn("_rank", F.row_number().over(in_bin)).filter(F.col("_rank") <= per_station)
    phase = F.when(F.col("_rank") == 1, 0).otherwise(1)
    in_station = Window.partitionBy("station_id").orderBy(phase, *order)
    chosen = ranked.withColumn("_pick", F.row_number().over(in_station)).filter(F.col("_pick") <= per_station)
    return number_cases(chosen.drop("_rank", "_pick"))


def number_cases(cases: DataFrame) -> DataFrame:
    """Sequence numbers over all stations: the place in the station plus the cases of earlier stations."""
    per_station = cases.groupBy("station_id").agg(F.count("*").alias("_k"))
    ahead = Window.orderBy("station_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_station.select("station_id", F.coalesce(F.sum("_k").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("station_id").orderBy("event_start"))
    numbered = cases.withColumn("_place", place).join(offsets, "station_id")
    seq = (F.col("_place") + F.col("_before")).cast("int")
    stamp = F.date_format("event_start", "yyyyMMdd'T'HH")
    event_id = F.format_string("%s_TS_%02d_%s", F.col("station_id"), seq, stamp)
    return numbered.withColumn("event_id", event_id).drop("_place", "_before")


def with_window(cases: DataFrame, margin_hours: int = WINDOW_MARGIN_HOURS) -> DataFrame:
    return cases.withColumns(
        {
            "window_start": shift_hours(F.col("event_start"), -margin_hours),
            "window_end": shift_hours(F.col("event_end"), margin_hours),
        }
    )


def find_controls(cases: DataFrame, targets: DataFrame, first, last) -> DataFrame:
    """One control per case: the first day offset whose shifted window is observed throughout and free of the event.

    The window is widened by the clear margin; neither the label nor the one-hour target may be positive in it.
    """
    shifts = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(d).alias("days")) for i, d in enumerate(CONTROL_OFFSETS_DAYS)])
    tried = cases.select("station_id", "event_id", "event_start", "event_end", F.explode(shifts).alias("o")).select(
        "station_id",
        "event_id",
        F.col("o.place").alias("place"),
        F.col("o.days").alias("offset_days"),
        F.expr("event_start + make_dt_interval(o.days)").alias("control_start"),
        F.expr("event_end + make_dt_interval(o.days)").alias("control_end"),
    )
    tried = tried.filter((F.col("control_start") >= F.lit(first)) & (F.col("control_end") <= F.lit(last)))
    step = F.make_dt_interval(F.lit(0), F.lit(1))
    hours = F.sequence(
        shift_hours(F.col("control_start"), -CLEAR_MARGIN_HOURS), shift_hours(F.col("control_end"), CLEAR_MARGIN_HOURS), step
    )
    spread = tried.withColumn("timestamp_utc", F.explode(hours))
    facts = targets.select("station_id", "timestamp_utc", "target", "target_1h")
    seen = spread.join(facts, ["station_id", "timestamp_utc"])
    positive = (F.col("target") == 1) | F.coalesce(F.col("target_1h") == 1, F.lit(False))
    judged = seen.groupBy("station_id", "event_id", "place", "offset_days", "control_start", "control_end").agg(
        F.bool_and(F.col("target").isNotNull()).alias("observed"), F.bool_or(F.coalesce(positive, F.lit(False))).alias("positive")
    )
    clear = judged.filter(F.col("observed") & ~F.col("positive"))
    best = clear.groupBy("station_id", "event_id").agg(
        F.min_by(F.struct("offset_days", "control_start", "control_end"), "place").alias("_c")
    )
    return best.select(
        "station_id", F.replace(F.col("event_id"), F.lit("_TS_"), F.lit("_CTL_")).alias("control_id"), "event_id", "_c.*"
    )


def case_table(cases: DataFrame, controls: DataFrame) -> DataFrame:
    """Episodes and controls in one table of intervals with their windows."""
    episodes_part = cases.select(
        "station_id", "event_id", "event_start", "event_end", F.lit("thunderstorm_episode").alias("case_type"), F.lit("").alias("control_reference")
    )
    controls_part = controls.select(
        "station_id",
        F.col("control_id").alias("event_id"),
        F.col("control_start").alias("event_start"),
        F.col("control_end").alias("event_end"),
        F.lit("control").alias("case_type"),
        F.col("event_id").alias("control_reference"),
    )
    return with_window(episodes_part.unionByName(controls_part))


def latest_complete_run(hours: DataFrame, complete: Column, now: Column, preceding: int) -> DataFrame:
    """Per station the latest run of complete, consecutive hours with at least ``preceding`` hours before its end.

    Hours after ``now`` are not used and counted; hours after the run are skipped and counted; nothing is filled in.
    """
    past = hours.filter(F.col("timestamp_utc") <= now)
    runs = islands(past.filter(complete), STATION, "timestamp_utc", 1).filter(F.col("n") >= preceding + 1)
    best = runs.groupBy("station_id").agg(F.max_by(F.struct("start", "end", "n"), "end").alias("r"))
    counts = hours.groupBy("station_id").agg(F.count_if(F.col("timestamp_utc") > now).alias("future_hours"))
    after = (
        past.join(best.select("station_id", F.col("r.end").alias("_end")), "station_id")
        .groupBy("station_id")
        .agg(F.count_if(F.col("timestamp_utc") > F.col("_end")).alias("trailing_skipped"))
    )
    return (
        best.join(counts, "station_id")
        .join(after, "station_id")
        .select(
            "station_id",
            F.col("r.start").alias("run_start"),
            F.col("r.end").alias("feature_hour"),
            F.col("r.n").alias("run_hours"),
            "trailing_skipped",
            "future_hours",
        )
    )


def case_summary(cases: DataFrame, rows: DataFrame, ids: Sequence[str] = ("station_id", "event_id", "case_type")) -> DataFrame:
    """Per case: matched hours, cloudiness, risk range and target hours; ``rows`` are case hours with their evidence."""
    facts = rows.groupBy(*ids).agg(
        F.count("*").alias("n_hours"),
        F.count("cloudy").alias("n_satellite_hours"),
        F.avg("cloudy").alias("mean_cloudy"),
        F.min("cloudy").alias("min_cloudy"),
        F.max("cloudy").alias("max_cloudy"),
        F.min("p_1h").alias("risk_min"),
        F.max("p_1h").alias("risk_max"),
        F.count_if(F.col("target_1h") == 1).alias("positive_hours"),
        F.count_if(F.col("target_1h") == 0).alias("negative_hours"),
        F.count_if(F.col("target_1h").isNull()).alias("unknown_hours"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_hours", "n_satellite_hours", "positive_hours", "negative_hours", "unknown_hours")}
    return cases.select(*ids).join(facts, list(ids), "left").withColumns(zero)


def scan_summary(cases: DataFrame, hits: DataFrame, ids: Sequence[str] = ("station_id", "event_id", "case_type")) -> DataFrame:
    """Per case: scans before, during and after the event, mean cloudiness and the most frequent class (smallest on ties)."""
    t = F.col("acq_end")
    after_end = shift_hours(F.col("event_end"), 1)
    facts = hits.groupBy(*ids).agg(
        F.count("*").alias("n_scans"),
        F.count_if(t < F.col("event_start")).alias("n_before"),
        F.count_if((t >= F.col("event_start")) & (t < after_end)).alias("n_during"),
        F.count_if(t >= after_end).alias("n_after"),
        F.avg("cloudy").alias("mean_cloudy"),
    )
    classes = hits.groupBy(*ids, "cmk").agg(F.count("*").alias("k"))
    mode = classes.groupBy(*ids).agg(F.min_by("cmk", F.struct(-F.col("k"), F.col("cmk"))).alias("class_mode"))
    out = cases.select(*ids).join(facts, list(ids), "left").join(mode, list(ids), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_scans", "n_before", "n_during", "n_after")})
