"""Finished tables as feeds, so that the streaming queries have something that arrives."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.session import scratch_path, stage
from tempora.streaming import live as S


def deliver(table: DataFrame, name: str, deliveries: list[Column]) -> str:
    """The folder to which the rows of each condition were added, one file after the other."""
    spark = table.sparkSession
    source, rows = scratch_path(spark, f"{name}-feed"), stage(table, f"{name}-source")
    for inside in deliveries:
        # one file is one micro-batch, in the order of arrival
        rows.filter(inside).coalesce(1).write.mode("append").parquet(source)
    return source


def ranges(parts: int, first: datetime, last: datetime, ts: str = "timestamp_utc") -> list[Column]:
    """Conditions of equal time ranges, the outer ones open, so that every row with a time is delivered."""
    width, out = (last - first) / parts, []
    for i in range(parts):
        inside = F.col(ts).isNotNull()
        if i > 0:
            inside = inside & (F.col(ts) >= F.lit(first + i * width))
        if i < parts - 1:
            inside = inside & (F.col(ts) < F.lit(first + (i + 1) * width))
        out.append(inside)
    return out


def run_feed(
    table: DataFrame,
    name: str,
    parts: int,
    first: datetime,
    last: datetime,
    plan: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    each: S.Each | None = None,
    ts: str = "timestamp_utc",
) -> DataFrame:
    """Deliver a table time range by time range and let a query take one delivery per micro-batch."""
    source = deliver(table, name, ranges(parts, first, last, ts))
    return S.run_to_table(plan(S.read_files(table.sparkSession, source, table.schema, files=1)), name, mode, each)
