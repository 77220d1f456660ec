"""Wind encodings; the direction is where the wind comes from, in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def direction_parts(direction: Column) -> tuple[Column, Column]:
    angle = F.radians(direction)
    return F.sin(angle), F.cos(angle)


def uv(speed: Column, direction: Column) -> tuple[Column, Column]:
    """Eastward and northward parts."""
    sine, cosine = direction_parts(direction)
    return -speed * sine, -speed * cosine


def direction_from_parts(sine: Column, cosine: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(sine, cosine)), F.lit(360.0))
