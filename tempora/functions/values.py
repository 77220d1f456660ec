"""Null discipline, tolerant comparison, verdicts and display texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known(value: Column) -> Column:
    """NaN becomes NULL, so that unknown has one form."""
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    x = value.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def all_known(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def to_number(text: Column) -> Column:
    """Coercing cast: unreadable text and NaN give NULL."""
    return known(text.try_cast("double"))


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within an absolute tolerance; two unknowns are equal, one unknown is not."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.lit(tolerance), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, NULL on a zero denominator."""
    return F.when(whole != 0, part / whole)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(ratio(part * F.lit(100.0), whole), digits)


def alert(p: Column, threshold: Column | float) -> Column:
    """1 when p reaches the threshold, NULL when p is unknown."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(known(p).isNotNull(), (p >= limit).cast("int"))


def hit(alert_flag: Column, target: Column) -> Column:
    return F.when(alert_flag.isNotNull() & target.isNotNull(), (alert_flag == target).cast("int"))


def verdict(alert_flag: Column, target: Column) -> Column:
    """TP, FP, FN or TN; NULL when either side is unknown."""
    return (
        F.when((alert_flag == 1) & (target == 1), "TP")
        .when((alert_flag == 1) & (target == 0), "FP")
        .when((alert_flag == 0) & (target == 1), "FN")
        .when((alert_flag == 0) & (target == 0), "TN")
    )


def completeness(columns: list[Column]) -> Column:
    """Share of finite values."""
    total = reduce(lambda a, b: a + b, [finite(c).cast("int") for c in columns])
    return total / F.lit(float(len(columns)))


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """Code of the first rule that fires, in order; NULL means complete."""
    return F.coalesce(*[F.when(condition, F.lit(code)) for condition, code in rules])


# Reason code to message, then the text parts that decide a group.
REASON_MESSAGES = {
    "unknown_station": "Unsupported station",
    "invalid_timestamp": "Invalid timestamp",
    "timestamp_outside_nwp_overlap": "Timestamp outside validated overlap",
    "insufficient_history": "Insufficient causal history",
    "missing_nwp": "Missing required NWP input",
    "nwp_incomplete": "Missing required NWP input",
    "feature_build_unavailable": "Insufficient causal history",
}
OTHER_REASON = "Required historical inputs were unavailable for this timestamp."


def reason_message(code: Column) -> Column:
    key = F.trim(code)
    low = F.lower(key)
    out = F.when(F.coalesce(key, F.lit("")) == "", OTHER_REASON)
    for known_code, message in REASON_MESSAGES.items():
        out = out.when(key == known_code, message)
    return (
        out.when(low.contains("nwp"), "Missing required NWP input")
        .when(low.rlike("history|causal|insufficient"), "Insufficient causal history")
        .when(low.contains("invalid_timestamp"), "Invalid timestamp")
        .when(low.rlike("overlap|outside"), "Timestamp outside validated overlap")
        .otherwise(OTHER_REASON)
    )


def reason_group(code: Column) -> Column:
    low = F.lower(F.coalesce(code, F.lit("")))
    return (
        F.when(low.rlike("insufficient_history|timestamp_not_in_history"), "missing_history")
        .when(low.contains("nwp"), "missing_nwp")
        .when(low.rlike("invalid|duplicate|non_hourly|unknown_station|outside"), "invalid_input")
        .otherwise("other")
    )


def one_decimal(value: Column) -> Column:
    """One decimal, rounded on the exact binary value and to even on a true tie.

    Twenty times the value is taken without error as a rounded sum and its remainder; an odd whole sum is a half of a
    tenth, and the remainder then says on which side of it the value lies.
    """
    high, low = value * 16.0, value * 4.0
    total = high + low
    part = total - high
    rest = (high - (total - part)) + (low - part)
    tenths = F.floor((total + 1.0) / 2.0).cast("double")
    half = total == 2.0 * tenths - 1.0
    down = half & ((rest < 0) | ((rest == 0) & (F.pmod(tenths, F.lit(2.0)) == 1.0)))
    return F.format_string("%.1f", F.when(down, tenths - 1.0).otherwise(tenths) / 10.0)


def alert_label(flag: Column) -> Column:
    return F.when(flag == 1, "ALERT").when(flag.isNotNull(), "NO ALERT")


def hit_label(flag: Column) -> Column:
    return F.when(flag == 1, "MATCH").when(flag.isNotNull(), "MISS")


def target_label(flag: Column) -> Column:
    return (
        F.when(flag == 1, "Thunderstorm observed")
        .when(flag.isNotNull(), "No thunderstorm observed")
        .otherwise("unavailable")
    )


def threshold_state(p: Column, threshold: float) -> Column:
    return F.when(p >= threshold, "ABOVE THRESHOLD").when(p.isNotNull(), "BELOW THRESHOLD")


def percent_text(p: Column) -> Column:
    return F.when(p.isNotNull(), one_decimal(p * 100.0))


def pressure_hpa(value: Column) -> Column:
    """Values above 2000 are taken as Pa."""
    return F.when(value > 2000, value / 100.0).otherwise(value)


def display_value(value: Column) -> Column:
    """One decimal below 1000, none from there on, ``N/A`` for unknown."""
    text = F.when(F.abs(value) < 1000, one_decimal(value)).otherwise(F.format_string("%.0f", F.rint(value)))
    return F.when(known(value).isNull(), "N/A").otherwise(text)


def canonical(name: str, kind: T.DataType) -> Column:
    """A value as text that any engine can write: times as microseconds, its length in front, null as a text of its own."""
    value = F.unix_micros(F.col(name)) if isinstance(kind, T.TimestampType) else F.col(name)
    text = value.cast("string")
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("null"))


def fingerprint(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Per part of the table (all of it by default) the number of rows and a 128-bit hash of its multiset of rows.

    Every row's md5 is added up in two halves modulo 2**64, so order and partitioning don't matter, repeated rows count as often as they
    stand there, and parts can be added up to the whole. Sums are combined where the rows are read.
    """
    names = list(columns or df.columns)
    digest = F.md5(F.concat_ws("|", *[canonical(n, df.schema[n].dataType) for n in names]))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(28,0)")
    rows = df.select(*by, half(1).alias("_high"), half(17).alias("_low"))
    total = lambda c: F.coalesce(F.sum(c) % F.lit(str(2**64)).cast("decimal(28,0)"), F.lit(0)).cast("decimal(20,0)").cast("string")
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), total("_high").alias("hash_high"), total("_low").alias("hash_low"))


def changed_parts(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys of the parts that differ between two tables of fingerprints, those that only one has included."""
    marks = ["n_rows", "hash_high", "hash_low"]
    pack = lambda df, name: df.select(*by, F.struct(*marks).alias(name))
    both = pack(before, "_b").unionByName(pack(after, "_a"), allowMissingColumns=True)
    return both.groupBy(*by).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a")).filter(~F.col("_b").eqNullSafe(F.col("_a"))).select(*by)
