"""Calendar spines: every hour of a window, present in the data or not."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hourly_spine(keys: DataFrame, start: datetime | Column, end: datetime | Column, hours: int = 1) -> DataFrame:
    """One row per key and hour, generated beside each key: no join and no shuffle."""
    first = start if isinstance(start, Column) else F.lit(start)
    last = end if isinstance(end, Column) else F.lit(end)
    step = F.make_dt_interval(F.lit(0), F.lit(hours))
    return keys.select("*", F.explode(F.sequence(first.cast("timestamp"), last.cast("timestamp"), step)).alias("timestamp_utc"))


def fill_on_spine(spine: DataFrame, facts: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Left join onto the calendar; only counts are zero-filled, measurements stay unknown."""
    joined = spine.join(facts, keys, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
    return joined.withColumns(zero)
