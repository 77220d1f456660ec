"""Hours, calendars and instrument clocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_SECONDS = 3600


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp")


def hour_index(ts: Column) -> Column:
    """Whole hours since the epoch; the integer ruler of every range frame."""
    return F.floor(F.unix_seconds(ts) / HOUR_SECONDS)


def from_hour_index(index: Column) -> Column:
    return F.timestamp_seconds(index * HOUR_SECONDS)


def shift_hours(ts: Column, hours: int) -> Column:
    return ts + F.make_interval(hours=F.lit(hours))


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


def cyclic(ts: Column) -> dict[str, Column]:
    """Hour of day and month of year on the unit circle."""
    turn = F.lit(2.0) * F.pi()
    hour = turn * F.hour(ts) / F.lit(24.0)
    month = turn * (F.month(ts) - 1) / F.lit(12.0)
    return {
        "hour_sin": F.sin(hour),
        "hour_cos": F.cos(hour),
        "month_sin": F.sin(month),
        "month_cos": F.cos(month),
    }


def season(ts: Column) -> Column:
    month = F.month(ts)
    return (
        F.when(month.between(3, 5), "pre_monsoon")
        .when(month.between(6, 9), "monsoon")
        .when(month >= 10, "post_monsoon")
        .otherwise("winter")
    )


def parse_text(text: Column, fmt: str) -> Column:
    """Coercing parse: text that does not match gives NULL."""
    return F.try_to_timestamp(text, F.lit(fmt))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normal_stamp(text: Column) -> Column:
    """Complete ``yyyy-MM-ddTHH:mm[:ss]`` to the ``Z`` form; an empty text gives NULL."""
    raw = F.trim(text)
    t_form = F.substring(raw, 11, 1) == "T"
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None).cast("string"))
        .when(raw.endswith("Z"), raw)
        .when((F.length(raw) == 16) & t_form, F.concat(raw, F.lit(":00Z")))
        .when((F.length(raw) == 19) & t_form, F.concat(raw, F.lit("Z")))
        .otherwise(raw)
    )


def file_stamp(name: Column) -> Column:
    """Time from a name of the form ``X_DDMMMYYYY_HHMM_...``."""
    day = F.regexp_extract(name, r"^[^_]*_(\d{2}[A-Za-z]{3}\d{4})_(\d{4})(?:_|$)", 1)
    clock = F.regexp_extract(name, r"^[^_]*_(\d{2}[A-Za-z]{3}\d{4})_(\d{4})(?:_|$)", 2)
    return F.try_to_timestamp(F.concat(F.initcap(day), clock), F.lit("ddMMMyyyyHHmm"))


def clock_slot(name: Column) -> Column:
    """The HHMM slot of a file name, NULL when the name has none."""
    return F.nullif(F.regexp_extract(name, r"^[^_]*_[^_]*_(\d{4})(?:_|$)", 1), F.lit(""))


def acquisition_stamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("dd-MMM-yyyy'T'HH:mm:ss"))


# Atomic clock origin and the offset to UTC in seconds.
TAI93_ORIGIN = "1993-01-01 00:00:00"
TAI93_OFFSET_SECONDS = 35


def tai93_to_utc(seconds: Column) -> Column:
    origin = F.unix_micros(F.lit(TAI93_ORIGIN).cast("timestamp"))
    return F.timestamp_micros((origin + (seconds - TAI93_OFFSET_SECONDS) * 1_000_000).cast("bigint"))


def minutes_since(minutes: Column, origin: str) -> Column:
    start = F.unix_micros(F.lit(origin).cast("timestamp"))
    return F.timestamp_micros((start + minutes * 60_000_000).cast("bigint"))


def expected_hours(year: Column) -> Column:
    """Hours of a calendar year, leap years included."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    after = F.make_date(year + 1, F.lit(1), F.lit(1))
    return F.datediff(after, first) * 24
