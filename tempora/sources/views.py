"""The analytics tables as views on the given parquet files."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import clock
from tempora.operators.calendar import hourly_spine

# Parameters: the window that the feeds replay, and how long after the first hour the archive replay begins.
WINDOW_START = datetime(2024, 1, 1, 0)
WINDOW_END = datetime(2024, 1, 30, 23)
REPLAY_AFTER = "48 HOURS"
REPLAY_START_SQL = f"(SELECT date_trunc('hour', min(ts)) + INTERVAL {REPLAY_AFTER} FROM events)"

# Station, latitude, longitude, elevation in m, rank, name.
STATIONS = [
    ("view", 8.4667, 76.95, 8.0, 1, "Trivandrum"),
    ("purchase", 22.6547, 88.4467, 6.0, 2, "Kolkata"),
    ("click", 28.5667, 77.1167, 233.0, 3, "Delhi"),
    ("signup", 10.15, 76.4, 8.0, 4, "Kochi"),
    ("error", 19.1005, 72.8585, 8.0, 5, "Mumbai"),
]
STATION_COLUMNS = "station_id, latitude, longitude, elevation_m, ord, name"

ATMOSPHERE = [
    "temperature_2m",
    "relative_humidity_2m",
    "surface_pressure",
    "wind_speed_10m",
    "wind_direction_10m",
    "precipitation",
    "cloud_cover",
]
MODEL = [
    "nwp_cape",
    "nwp_convective_inhibition",
    "nwp_lifted_index",
    "nwp_temperature_2m",
    "nwp_relative_humidity_2m",
    "nwp_surface_pressure",
    "nwp_wind_speed_10m",
    "nwp_wind_direction_10m",
    "nwp_precipitation",
    "nwp_cloud_cover",
]
LEADS = (1, 2, 3)


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def stations(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{i}', {lat}D, {lon}D, {elev}D, {rank}, '{name}')" for i, lat, lon, elev, rank, name in STATIONS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({STATION_COLUMNS})")


def first_hour(spark: SparkSession, path: str) -> Column:
    """First hour of the calendar, a scalar subquery on the events."""
    return table(spark, path, "events").agg(F.date_trunc("hour", F.min("ts")).cast("timestamp")).scalar()


def replay_start(spark: SparkSession, path: str) -> Column:
    """First hour that the archive replay asks for."""
    return first_hour(spark, path) + F.expr(f"INTERVAL {REPLAY_AFTER}")


def last_hour(spark: SparkSession, path: str) -> Column:
    """Last hour of the calendar."""
    return table(spark, path, "events").agg(F.date_trunc("hour", F.max("ts")).cast("timestamp")).scalar()


def known_window(spark: SparkSession, path: str) -> tuple[Column, Column]:
    """First and last hour as literals: one small aggregate now, for plans that are built into many others."""
    ends = [F.date_trunc("hour", f("ts")).cast("string") for f in (F.min, F.max)]
    return tuple(F.lit(x).cast("timestamp") for x in table(spark, path, "events").agg(*ends).first())


def spine(spark: SparkSession, path: str, window: tuple[Column, Column] | None = None) -> DataFrame:
    """Every station and hour between the first and the last event; no hours where there are no events."""
    first, last = window or (first_hour(spark, path), last_hour(spark, path))
    return hourly_spine(stations(spark).select("station_id"), first, last)


def events(spark: SparkSession, path: str) -> DataFrame:
    df = table(spark, path, "events")
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


def wx_text(k: Column) -> Column:
    return (
        F.when(k < 8, "-TSRA BR").when(k < 12, "VCTS/HZ").when(k < 30, "M").when(k < 34, "").otherwise("HZ")
    )


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Irregular reports: one row per event, with its present-weather text."""
    return events(spark, path).select(
        F.col("event_id").alias("report_id"),
        F.col("event_type").alias("station_id"),
        F.col("ts").alias("valid_ts"),
        F.date_trunc("minute", "ts").alias("valid_minute"),
        wx_text(F.col("k")).alias("wxcodes"),
    )


# Report bodies, chosen by report id modulo 8.
BODIES = [
    "24005KT 5000TS FEW025CB 28/24 Q1008 TEMPO 3000",
    "24005KT 6000 28/24 Q1009 TEMPO TSRA",
    "VRB02KT 6000 RETS 27/24 Q1010 NOSIG",
    "00000KT 4000 +TSRA SCT020 M01/M02 Q1011",
    "010606 24010KT 6000 TSRA",
    "18003KT 8000 VCTS 29/25 Q1007 BECMG 5000",
    "AUTO 9999 30/22",
    "27008KT 9999 31/20 Q1006 RMK TS OVER HILLS",
]


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """The reports with a full report body."""
    df = reports(spark, path)
    body = F.element_at(F.array(*[F.lit(b) for b in BODIES]), (F.col("report_id") % 8 + 1).cast("int"))
    stamp = F.date_format("valid_ts", "ddHHmm")
    return df.withColumn("metar", F.concat(F.upper("station_id"), F.lit(" "), stamp, F.lit("Z "), body))


def hourly_sums(df: DataFrame, **parts: Column) -> DataFrame:
    """Whole-number sums per station and hour and per named part of the events, all from one pass.

    Whole numbers make the result independent of the order of addition.
    """
    cents = F.round(F.col("value") * 100).cast("bigint")
    columns = []
    for name, part in parts.items():
        columns += [
            F.count_if(part).alias(f"{name}n"),
            F.sum(F.when(part, cents)).alias(f"{name}s"),
            F.min(F.when(part, cents)).alias(f"{name}lo"),
            F.max(F.when(part, cents)).alias(f"{name}hi"),
            F.sum(F.when(part, F.col("k").cast("bigint"))).alias(f"{name}sk"),
            F.sum(F.when(part, F.col("user_id"))).alias(f"{name}su"),
        ]
    return df.groupBy(F.col("event_type").alias("station_id"), clock.hour_of(F.col("ts")).alias("timestamp_utc")).agg(*columns)


def _weather(prefix: str = "") -> list[Column]:
    n, s, lo, hi, sk, su = (F.col(c) for c in ("n", "s", "lo", "hi", "sk", "su"))
    return [
        (s / n / 100.0).alias(f"{prefix}temperature_2m"),
        (sk / n).alias(f"{prefix}relative_humidity_2m"),
        (hi + 90000).cast("double").alias(f"{prefix}surface_pressure"),
        (lo / 100.0).alias(f"{prefix}wind_speed_10m"),
        (su * 7 % 360).cast("double").alias(f"{prefix}wind_direction_10m"),
        (s / 100.0).alias(f"{prefix}precipitation"),
        F.least(F.lit(100), n * 20).cast("double").alias(f"{prefix}cloud_cover"),
    ]


def atmos(spark: SparkSession, path: str) -> DataFrame:
    """Hourly predictors on the full calendar; hours without a measurement are unknown."""
    values = hourly_sums(events(spark, path), **{"": F.lit(True)}).select("station_id", "timestamp_utc", *_weather())
    return spine(spark, path).join(values, ["station_id", "timestamp_utc"], "left")


def nwp(spark: SparkSession, path: str) -> DataFrame:
    """Forecast-model table: only hours that the model covers have a row."""
    n, s, lo = F.col("n"), F.col("s"), F.col("lo")
    indices = [
        F.when(s % 11 != 0, s / 10.0).alias("nwp_cape"),
        F.when(s % 13 != 0, lo / -100.0).alias("nwp_convective_inhibition"),
        ((5000 - s / n) / 1000.0).alias("nwp_lifted_index"),
    ]
    return hourly_sums(events(spark, path), **{"": F.lit(True)}).select("station_id", "timestamp_utc", *indices, *_weather("nwp_"))


def scans(spark: SparkSession, path: str) -> DataFrame:
    """Satellite scans: one per event, with an acquisition time and a cloudy share."""
    share = F.least(F.round(F.col("value") * 100), F.lit(60000.0)) / 60000.0
    return (
        events(spark, path)
        .select(
            F.col("event_type").alias("station_id"),
            F.col("event_id").alias("gid"),
            F.col("ts").alias("acq_end"),
            share.alias("cloudy"),
            (F.col("k") % 4).alias("cmk"),
        )
    )


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """Flattened scan pixels: class 9 is fill."""
    key = F.col("c_custkey")
    return table(spark, path, "customer").select(
        F.col("c_mktsegment").alias("scan_id"),
        key.alias("row"),
        (key % 100).alias("col"),
        (F.lit(5) + (key * 37 % 2600) / 100.0).alias("lat"),
        (F.lit(70) + (key * 53 % 2000) / 100.0).alias("lon"),
        F.when(key % 5 == 4, 9).otherwise(key % 5).cast("int").alias("cls"),
    )


def strikes(spark: SparkSession, path: str) -> DataFrame:
    """Lightning point records of three types."""
    key = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("event"), F.lit("group"), F.lit("flash")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, path, "part").select(
        key.alias("point_id"),
        kind.alias("lightning_type"),
        (key * 3600).cast("double").alias("tai93"),
        F.when(key % 97 == 0, 0.0).otherwise(F.lit(5) + (key * 41 % 2600) / 100.0).alias("lat"),
        F.when(key % 97 == 0, 0.0).otherwise(F.lit(70) + (key * 59 % 2000) / 100.0).alias("lon"),
        F.col("p_brand").alias("granule"),
    )


def climate_grid(spark: SparkSession, path: str) -> DataFrame:
    """Regular-grid climatology cells; some cells are empty."""
    key = F.col("s_suppkey")
    return table(spark, path, "supplier").select(
        key.alias("cell_id"),
        (F.lit(5) + (key * 37 % 104) / 4.0).alias("grid_lat"),
        (F.lit(70) + (key * 53 % 80) / 4.0).alias("grid_lon"),
        F.when(key % 7 != 0, F.col("s_acctbal")).alias("annual_hours"),
    )


def series_day(spark: SparkSession, path: str) -> DataFrame:
    """Long daily series: one row per priority and day that has orders."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        table(spark, path, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("station_id"),
            F.col("o_orderdate").cast("timestamp").alias("timestamp_utc"),
        )
        .agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))
    )


def all_known(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
