"""Deterministic samples, first and latest rows, representative cases and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.values import all_known


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """The n rows with the smallest hash of key and seed: the same rows whatever the partitioning."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.withColumn("_digest", digest).orderBy("_digest", *keys).limit(n).drop("_digest")


def every_hours(df: DataFrame, ts: str, step: int, first, last) -> DataFrame:
    """Distinct hours inside a closed period whose hour of day is a multiple of ``step``."""
    inside = F.col(ts).between(F.lit(first), F.lit(last))
    return df.filter(inside & (F.hour(ts) % step == 0)).select(ts).distinct()


def latest_complete(df: DataFrame, key: str, ts: str, columns: Sequence[str], until: Column) -> DataFrame:
    """Newest row per key, at or before a time, in which every column is known."""
    rows = df.filter((F.col(ts) <= until) & all_known([F.col(c) for c in columns]))
    return rows.groupBy(key).agg(F.max_by(F.struct(ts, *columns), ts).alias("_r")).select(key, "_r.*")


def first_complete(df: DataFrame, key: str, ts: str, columns: Sequence[str]) -> DataFrame:
    rows = df.filter(all_known([F.col(c) for c in columns]))
    return rows.groupBy(key).agg(F.min_by(F.struct(ts, *columns), ts).alias("_r")).select(key, "_r.*")


def representative_cases(scores: DataFrame, threshold: float, leads: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """One case per lead and verdict: for errors the one nearest to the threshold, else the first; a filler when none."""
    spark = scores.sparkSession
    error = F.col("verdict").isin("FP", "FN")
    near = F.when(error, F.abs(F.col("p") - threshold)).otherwise(F.lit(0.0))
    found = scores.groupBy("lead", "verdict").agg(
        F.min_by(F.struct("station_id", "timestamp_utc", "p", "alert", "y"), F.struct(near, "station_id", "timestamp_utc")).alias("_c")
    )
    rows = ", ".join(f"('{k}h', '{v}')" for k in leads for v in ("TP", "FP", "FN", "TN"))
    dim = spark.sql(f"SELECT * FROM VALUES {rows} AS t(lead, verdict)")
    out = dim.join(found, ["lead", "verdict"], "left")
    return out.select(
        "lead",
        "verdict",
        "_c.station_id",
        "_c.timestamp_utc",
        F.col("_c.p").alias("p"),
        F.when(error, F.col("_c.p") - threshold).alias("distance"),
        F.when(F.col("_c").isNull(), "unavailable").otherwise("ok").alias("status"),
    )


def rank_stations(predictions: DataFrame, stations: DataFrame, p: str = "p_1h") -> DataFrame:
    """Per hour: stations by falling probability, unavailable ones last, fixed order on ties; the first available is the focus."""
    ordered = predictions.join(stations.select("station_id", "ord"), "station_id")
    place = F.row_number().over(Window.partitionBy("timestamp_utc").orderBy(F.desc_nulls_last(p), F.asc("ord")))
    return ordered.withColumn("place", place).withColumn("is_focus", ((F.col("place") == 1) & F.col(p).isNotNull()).cast("int"))


def ranked(df: DataFrame, value: str, name: str, keys: Sequence[str]) -> DataFrame:
    """Min-method rank, largest first: equal values share the smallest rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value))
    return df.withColumn(name, F.rank().over(order))
