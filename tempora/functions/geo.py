"""Distances, stored-integer decoding and pixel classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# Pixel classes of the cloud mask.
CLASS_NAMES = {0: "Clear", 1: "Cloudy", 2: "Probably_Clear", 3: "Probably_Cloudy"}
CLOUDY_CLASSES = (1, 3)
CLEAR_CLASSES = (0, 2)
FILL_CLASS = 9


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def decode_scaled(stored: Column, scale: float, offset: float, fill: int) -> Column:
    """Stored integer to physical value; the fill value is unknown."""
    return F.when(stored != fill, stored * F.lit(scale) + F.lit(offset))


def class_name(cls: Column) -> Column:
    pairs = [F.lit(x) for item in CLASS_NAMES.items() for x in item]
    return F.element_at(F.create_map(*pairs), cls.cast("int"))


def is_valid_class(cls: Column) -> Column:
    return cls.isin(*CLASS_NAMES)


def is_cloudy(cls: Column) -> Column:
    return cls.isin(*CLOUDY_CLASSES)


def is_clear(cls: Column) -> Column:
    return cls.isin(*CLEAR_CLASSES)


def valid_position(lat: Column, lon: Column) -> Column:
    """In range, finite and not the 0/0 placeholder."""
    finite = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return finite & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
