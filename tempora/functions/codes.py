"""Weather-code text as native column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers after which a report body is a forecast or a remark.
TREND_MARKERS = ("TEMPO", "BECMG", "NOSIG", "RMK", r"PROB\d{2}", "EMPO", "TMPO")
PRESSURE_GROUP = r"\bQ\d{4}\b"
TEMPERATURE_GROUP = r"\bM?\d{2}/M?\d{2}\b"
FORECAST_PRODUCT = r"^\S+\s+\d{6}Z\s+\d{6}\s"
SEPARATOR = r"[/\s]"
SEPARATORS = r"[/\s]+"
TOKEN_CHARACTER = r"[^/\s]"
EVENT = "[+-]*TS"
VICINITY = "[+-]*VC[+-]*TS"
STATION_EVENT = f"^{EVENT}"
VICINITY_EVENT = f"^{VICINITY}"
NO_CODE = "M"


def tokens(codes: Column) -> Column:
    """Codes split on ``/`` and blanks; null, empty and the no-code mark give no tokens."""
    text = F.trim(codes)
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | (F.upper(text) == NO_CODE), empty).otherwise(
        F.filter(F.split(text, SEPARATORS), lambda t: t != "")
    )


def has_code(codes: Column) -> Column:
    """At least one token; one pattern on the text instead of building the tokens."""
    return F.coalesce(codes.rlike(TOKEN_CHARACTER) & (F.upper(F.trim(codes)) != NO_CODE), F.lit(False))


def token_class(token: Column) -> Column:
    """``ts`` at the station, ``vcts`` in the vicinity, otherwise ``other``."""
    text = F.upper(F.trim(token))
    return (
        F.when(text.rlike(VICINITY_EVENT), "vcts").when(text.rlike(STATION_EVENT), "ts").otherwise("other")
    )


def _has_token(codes: Column, *starts: str) -> Column:
    """Some token begins with one of the patterns."""
    return F.coalesce(codes.rlike(rf"(?i)(?:^|{SEPARATOR})(?:{'|'.join(starts)})"), F.lit(False))


def station_event(codes: Column) -> Column:
    return _has_token(codes, EVENT)


def vicinity_event(codes: Column) -> Column:
    return _has_token(codes, VICINITY)


def any_event(codes: Column) -> Column:
    return _has_token(codes, EVENT, VICINITY)


def observed_part(body: Column) -> Column:
    """The body up to its first trend or remark marker."""
    markers = "|".join(TREND_MARKERS)
    return F.regexp_extract(F.coalesce(body, F.lit("")), rf"(?s)^(.*?)(?:\b(?:{markers})\b|$)", 1)


def body_event(body: Column) -> Column:
    """An event seen in the observed part: leading digits are dropped, recent weather is skipped."""
    return _has_token(observed_part(body), rf"\d*{EVENT}", rf"\d*{VICINITY}")


def has_pressure(body: Column) -> Column:
    return F.coalesce(body.rlike(PRESSURE_GROUP), F.lit(False))


def has_temperature(body: Column) -> Column:
    return F.coalesce(body.rlike(TEMPERATURE_GROUP), F.lit(False))


def full_decode(body: Column) -> Column:
    return has_pressure(body) & has_temperature(body)


def forecast_product(body: Column) -> Column:
    return F.coalesce(body.rlike(FORECAST_PRODUCT), F.lit(False))
