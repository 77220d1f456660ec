"""Window work on long keyed series, cut into clock chunks so that one key never is one task.

A table here has one row per key and hour, so a chunk holds at most ``chunk_hours`` rows per key. Range frames that
reach over a chunk border are served by a halo: rows near a border are copied into the neighbour chunk, used there
as context, and dropped after the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.clock import HOUR_SECONDS

CHUNK_HOURS = 24 * 31

STEP_HOUR = HOUR_SECONDS
STEP_DAY = 24 * HOUR_SECONDS


class Chunked:
    """Frames over a series with a halo; steps are clock steps, never row counts."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        ts: str,
        back: int,
        ahead: int = 0,
        step: int = STEP_HOUR,
        chunk: int = CHUNK_HOURS,
    ):
        self.keys = list(keys)
        index = F.floor(F.unix_seconds(F.col(ts)) / step)
        rows = df.withColumn("_i", index)
        first = F.floor((F.col("_i") - ahead) / chunk)
        last = F.floor((F.col("_i") + back) / chunk)
        self.rows = rows.withColumn("_chunk", F.explode(F.sequence(first, last)))
        self.own = F.floor(F.col("_i") / chunk) == F.col("_chunk")
        self.window = Window.partitionBy(*self.keys, "_chunk").orderBy("_i")

    def span(self, low: int, high: int):
        return self.window.rangeBetween(low, high)

    def at(self, value: Column, offset: int) -> Column:
        """Value exactly ``offset`` steps away; unknown when that step has no row or no value."""
        return F.max(value).over(self.span(offset, offset))

    def full_sum(self, value: Column, low: int, high: int) -> Column:
        """Sum over the frame, unknown unless every step of it has a value."""
        frame = self.span(low, high)
        return F.when(F.count(value).over(frame) == high - low + 1, F.sum(value).over(frame))

    def full_mean(self, value: Column, low: int, high: int) -> Column:
        frame = self.span(low, high)
        return F.when(F.count(value).over(frame) == high - low + 1, F.avg(value).over(frame))

    def rows_in(self, low: int, high: int, condition: Column | None = None) -> Column:
        counted = F.lit(1) if condition is None else F.when(condition, 1)
        return F.count(counted).over(self.span(low, high))

    def select(self, *columns: str | Column) -> DataFrame:
        """Evaluate, then keep each row once: in its own chunk."""
        out = self.rows.select(*columns, self.own.alias("_own"))
        return out.filter("_own").drop("_own")


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, name: str, chunk: int = CHUNK_HOURS) -> DataFrame:
    """Add the time of the preceding row of the series, however far back it lies.

    Within a chunk this is ``lag``; the first row of a chunk takes the last time of the nearest earlier chunk, which
    is found on one summary row per chunk.
    """
    cut = F.floor(F.unix_seconds(F.col(ts)) / (chunk * HOUR_SECONDS))
    rows = df.withColumn("_chunk", cut)
    series = Window.partitionBy(*keys).orderBy("_chunk")
    edges = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.max(ts).alias("_last"))
        .select(*keys, "_chunk", F.lag("_last").over(series).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    lagged = rows.withColumn(name, F.lag(ts).over(inside))
    joined = lagged.join(edges, [*keys, "_chunk"])
    return joined.withColumn(name, F.coalesce(name, "_carry")).drop("_chunk", "_carry")


def islands(
    df: DataFrame, keys: Sequence[str], ts: str, gap_hours: int, chunk: int = CHUNK_HOURS
) -> DataFrame:
    """Runs of rows whose steps are at most ``gap_hours``: key, start, end, number of rows.

    Islands are built inside each chunk first. Only the first and the last island of a chunk can go on in a
    neighbour chunk, so just those are ordered per key and merged.
    """
    gap = gap_hours * HOUR_SECONDS
    second = F.unix_seconds(F.col(ts))
    rows = df.select(*keys, F.col(ts).alias("_ts"), second.alias("_s"), F.floor(second / (chunk * HOUR_SECONDS)).alias("_chunk"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_s")
    fresh = (F.coalesce(F.col("_s") - F.lag("_s").over(inside) > gap, F.lit(True))).cast("int")
    local = (
        rows.withColumn("_fresh", fresh)
        .withColumn("_island", F.sum("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_chunk", "_island")
        .agg(F.min("_ts").alias("start"), F.max("_ts").alias("end"), F.count("*").alias("n"))
        .withColumn("_last", F.max("_island").over(Window.partitionBy(*keys, "_chunk")))
        .withColumn("_edge", (F.col("_island") == 1) | (F.col("_island") == F.col("_last")))
    )
    # an inner island gets a group of its own; edge islands are grouped by the merged run they belong to
    series = Window.partitionBy(*keys, "_edge").orderBy("start")
    step = F.unix_seconds("start") - F.unix_seconds(F.lag("end").over(series))
    starts = F.when(F.col("_edge"), F.coalesce(step > gap, F.lit(True)).cast("int"))
    edges = local.filter("_edge").withColumn("_fresh", starts)
    merged = (
        edges.withColumn("_run", F.sum("_fresh").over(series.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
        .drop("_run")
    )
    inner = local.filter(~F.col("_edge")).select(*keys, "start", "end", "n")
    return inner.unionByName(merged.select(*keys, "start", "end", "n"))
