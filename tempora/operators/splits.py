"""Chronological splits: the same cutoff hours for every station, never a random draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.ordered import positions

# Shares of the unique hours.
TRAIN_SHARE = 0.70
VALIDATION_SHARE = 0.15


def hour_cutoffs(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """One row: last train hour, last validation hour and the number of hours in each part, from unique hours."""
    marked = df.select(F.lit(1).alias("_all"), F.unix_seconds(ts).alias("_s"))
    ranked = positions(marked, ["_all"], "_s")
    train = F.floor(F.col("n_values") * F.lit(TRAIN_SHARE))
    upto = train + F.floor(F.col("n_values") * F.lit(VALIDATION_SHARE))
    at, second = F.col("position"), F.timestamp_seconds("_s")
    return ranked.agg(
        F.max(F.when(at <= train, second)).alias("train_end"),
        F.max(F.when(at <= upto, second)).alias("validation_end"),
        F.count_if(at <= train).alias("train_hours"),
        F.count_if((at > train) & (at <= upto)).alias("validation_hours"),
        F.count_if(at > upto).alias("test_hours"),
    )


def assign_split(ts: Column, train_end: Column, validation_end: Column) -> Column:
    return F.when(ts <= train_end, "train").when(ts <= validation_end, "validation").otherwise("test")


def with_split(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Add ``split`` from the cutoffs of the table itself."""
    cuts = hour_cutoffs(df, ts).select(F.struct("train_end", "validation_end").alias("c")).scalar()
    return df.withColumn("split", assign_split(F.col(ts), cuts["train_end"], cuts["validation_end"]))


def split_by_rows(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Split each series by its own rows: the first 70 % train, the next 15 % validation."""
    ranked = positions(df.withColumn("_s", F.unix_seconds(ts)), keys, "_s")
    train = F.floor(F.col("n_values") * F.lit(TRAIN_SHARE))
    upto = train + F.floor(F.col("n_values") * F.lit(VALIDATION_SHARE))
    named = F.when(F.col("position") <= train, "train").when(F.col("position") <= upto, "validation").otherwise("test")
    return (
        df.withColumn("_s", F.unix_seconds(ts))
        .join(ranked.select(*keys, "_s", named.alias("split")), [*keys, "_s"])
        .drop("_s")
    )


def split_bounds(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def boundary_overlap(df: DataFrame, leads: tuple[int, ...] = (1, 2, 3), ts: str = "timestamp_utc") -> DataFrame:
    """Rows whose future label lies in the next split, per lead."""
    starts = df.groupBy("split").agg(F.min(ts).alias("first"))
    pairs = F.create_map(F.lit("train"), F.lit("validation"), F.lit("validation"), F.lit("test"))
    bounded = df.withColumn("next_split", F.element_at(pairs, F.col("split"))).join(
        starts.select(F.col("split").alias("next_split"), F.col("first").alias("_next")), "next_split"
    )
    future = F.unix_seconds(ts) + F.col("lead") * 3600
    return (
        bounded.withColumn("lead", F.explode(F.array(*[F.lit(k) for k in leads])))
        .groupBy("split", "lead")
        .agg(F.count_if(future >= F.unix_seconds("_next")).alias("rows_reaching_next"))
    )
