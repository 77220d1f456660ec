"""Causal features: nothing after T reaches a feature, frames run on the clock, windows must be full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.contracts import guard_features
from tempora.functions import clock, wind
from tempora.functions.values import all_known
from tempora.operators.series import Chunked

# Source columns and the stems of derived names.
SOURCES = {
    "temperature": "temperature_2m",
    "humidity": "relative_humidity_2m",
    "pressure": "surface_pressure",
    "wind_speed": "wind_speed_10m",
    "precipitation": "precipitation",
    "cloud_cover": "cloud_cover",
}
LAG_HOURS = (1, 3, 6, 12, 24)
CHANGE_HOURS = (1, 3)
SUM_HOURS = (3, 6, 12, 24)
MEAN_HOURS = (3, 6)
MEAN_STEMS = ("humidity", "pressure", "temperature", "wind_speed", "cloud_cover")
HISTORY_HOURS = 24

CURRENT = list(SOURCES.values())
CYCLIC = ["hour_sin", "hour_cos", "month_sin", "month_cos"]
WIND = ["wind_direction_sin", "wind_direction_cos", "wind_u_10m", "wind_v_10m"]
LAGS = [f"{stem}_lag_{h}h" for stem in SOURCES for h in LAG_HOURS]
CHANGES = [f"{stem}_change_{h}h" for stem in SOURCES for h in CHANGE_HOURS]
ROLLS = [f"precipitation_roll_sum_{h}h" for h in SUM_HOURS] + [f"{s}_roll_mean_{h}h" for s in MEAN_STEMS for h in MEAN_HOURS]
LOCATION = ["latitude", "longitude", "elevation_m"]
FEATURES = CURRENT + CYCLIC + WIND + LAGS + CHANGES + ROLLS + LOCATION
HISTORY_FEATURES = LAGS + CHANGES + ROLLS

# The older single-station set: 28 columns, windows with T included.
COMPACT_STEMS = ("temperature", "humidity", "pressure", "wind_speed", "precipitation")
COMPACT_FEATURES = (
    CURRENT
    + CYCLIC
    + WIND[:2]
    + [f"{stem}_change_{h}h" for stem in COMPACT_STEMS for h in CHANGE_HOURS]
    + ["precipitation_roll_sum_3h", "precipitation_roll_sum_6h"]
    + [f"{stem}_roll_mean_3h" for stem in ("humidity", "pressure", "temperature", "wind_speed")]
)

# The oldest set: 24 columns, windows end before T.
PRIOR_FEATURES = (
    CURRENT
    + WIND[:2]
    + [f"{SOURCES[stem]}_change_{h}h" for stem in ("temperature", "humidity", "pressure", "wind_speed") for h in CHANGE_HOURS]
    + ["precip_roll_3h", "precip_roll_6h", "humidity_roll_3h", "pressure_roll_3h"]
    + CYCLIC
)


def _instant() -> dict[str, Column]:
    sine, cosine = wind.direction_parts(F.col("wind_direction_10m"))
    u, v = wind.uv(F.col("wind_speed_10m"), F.col("wind_direction_10m"))
    return {**clock.cyclic(F.col("timestamp_utc")), **dict(zip(WIND, (sine, cosine, u, v)))}


def _history(series: Chunked) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for stem, source in SOURCES.items():
        now = F.col(source)
        for h in LAG_HOURS:
            out[f"{stem}_lag_{h}h"] = series.at(now, -h)
        for h in CHANGE_HOURS:
            out[f"{stem}_change_{h}h"] = now - series.at(now, -h)
    for h in SUM_HOURS:
        out[f"precipitation_roll_sum_{h}h"] = series.full_sum(F.col("precipitation"), 1 - h, 0)
    for stem in MEAN_STEMS:
        for h in MEAN_HOURS:
            out[f"{stem}_roll_mean_{h}h"] = series.full_mean(F.col(SOURCES[stem]), 1 - h, 0)
    return out


def station_features(hours: DataFrame) -> DataFrame:
    """All 73 features beside the columns of an hourly table with location columns.

    Every frame has the same partitioning and order, so one shuffle and one sort serve all of them.
    """
    series = Chunked(hours, ["station_id"], "timestamp_utc", back=HISTORY_HOURS)
    derived = {**_instant(), **_history(series)}
    out = series.select(*hours.columns, *[c.alias(n) for n, c in derived.items()])
    return guard_features(out, FEATURES, 73)


def compact_features(hours: DataFrame) -> DataFrame:
    """The 28-column set."""
    series = Chunked(hours, ["station_id"], "timestamp_utc", back=6)
    derived = {**_instant(), **_history(series)}
    wanted = [n for n in COMPACT_FEATURES if n in derived]
    out = series.select(*hours.columns, *[derived[n].alias(n) for n in wanted])
    return guard_features(out, COMPACT_FEATURES, 28)


def prior_features(hours: DataFrame) -> DataFrame:
    """The 24-column set; its windows cover the hours strictly before T."""
    series = Chunked(hours, ["station_id"], "timestamp_utc", back=6)
    derived = _instant()
    for stem in ("temperature", "humidity", "pressure", "wind_speed"):
        source = F.col(SOURCES[stem])
        for h in CHANGE_HOURS:
            derived[f"{SOURCES[stem]}_change_{h}h"] = source - series.at(source, -h)
    rain = F.col("precipitation")
    derived["precip_roll_3h"] = series.full_sum(rain, -3, -1)
    derived["precip_roll_6h"] = series.full_sum(rain, -6, -1)
    derived["humidity_roll_3h"] = series.full_mean(F.col("relative_humidity_2m"), -3, -1)
    derived["pressure_roll_3h"] = series.full_mean(F.col("surface_pressure"), -3, -1)
    wanted = [n for n in PRIOR_FEATURES if n in derived]
    out = series.select(*hours.columns, *[derived[n].alias(n) for n in wanted])
    return guard_features(out, PRIOR_FEATURES, 24)


def drop_warm_up(features: DataFrame, names: list[str] = HISTORY_FEATURES) -> DataFrame:
    """Only rows whose whole history is known."""
    return features.filter(all_known([F.col(n) for n in names]))


def future_total(
    hours: DataFrame, value: str, steps: int, step: int, name: str, keys: tuple[str, ...] = ("station_id",)
) -> DataFrame:
    """Sum over the next ``steps`` steps, known only when each of them has a value."""
    series = Chunked(hours, keys, "timestamp_utc", back=0, ahead=steps, step=step)
    return series.select(*hours.columns, series.full_sum(F.col(value), 1, steps).alias(name))


def full_history(hours: DataFrame, present: Column, hours_back: int = HISTORY_HOURS) -> DataFrame:
    """Add ``history_rows``, the number of usable hours in T-back..T, and whether that history is complete."""
    series = Chunked(hours, ["station_id"], "timestamp_utc", back=hours_back)
    counted = series.rows_in(-hours_back, 0, present)
    out = series.select(*hours.columns, counted.alias("history_rows"))
    return out.withColumn("history_ok", F.col("history_rows") == hours_back + 1)
